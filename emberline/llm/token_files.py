"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Part p of a corpus is three files: `.ids` holds the ids of its documents one after another, as
little-endian unsigned integers of 16 bits, or 32 for larger vocabularies; `.off` holds, as
little-endian signed 64-bit integers, where each document starts within the part, and the number of
ids at its end; `.doc` holds the document ids as 64-bit integers. The manifest, one row a part, holds
the counts and `base`, the number of ids of all parts before, so that an offset within the corpus is
base + offset. Local files are mapped into memory, others are read by ranges.

A part is written by one task under a name of its own attempt; only files of attempts that Spark
counts are in the manifest. Null text counts as empty and has the end id alone. Repeated rows and
documents with equal ids are all written; null document ids come first and are read back as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.encoding import SpacedUnits, encoder, tokenizer
from emberline.llm.store import Workspace, file_system, task_file
from emberline.llm.words import blocks

END_ID = 2
MANIFEST = "part long, path string, n_docs long, n_tokens long, width int"
#: Stands for a null document id in the files.
NO_ID = -(1 << 63)
#: Documents handed back by the reader at once.
READ_DOCS = 5_000


def _write_part(folder: str, path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        engine = encoder(SpacedUnits, path)
        width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4
        fs, root = file_system(task_file(folder, f"part-{TaskContext.get().partitionId():06d}"))
        starts, docs, total = [], [], 0
        fs.create_dir(root.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{root}.ids") as out:
            for batch in batches:
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                docs += [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
                for _, some in blocks(texts):
                    for ids in engine.texts(some):
                        starts.append(total)
                        total += len(ids) + 1
                        out.write(np.append(ids, end_id).astype(f"<u{width}").tobytes())
        for end, values in ((".off", [*starts, total]), (".doc", docs)):
            with fs.open_output_stream(root + end) as out:
                out.write(np.array(values, "<i8").tobytes())
        name = root if "://" not in folder or folder.startswith("file:") else f"{folder}/{root.rpartition('/')[2]}"
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [name],
            "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([total], pa.int64()),
            "width": pa.array([width], pa.int32())})
    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents in ascending order of doc_id; gives the manifest with `base`.

    The order comes from a range partitioning on the id, sampled before any text is encoded. The
    manifest has a row a part and is the only thing that the driver sees.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(ordered.mapInArrow(_write_part(folder, path, end_id), MANIFEST).collect())
    bases = np.cumsum([0, *[p["n_tokens"] for p in parts]]).tolist()
    return spark.createDataFrame([(*p, b) for p, b in zip(parts, bases[:-1], strict=True)], MANIFEST + ", base long")


def _mapped(uri: str, kind: str, count: int) -> np.ndarray:
    """The integers of a file: mapped if it is local, else read."""
    from pyarrow import fs

    system, path = file_system(uri)
    if not count:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", shape=(count,))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(count * np.dtype(kind).itemsize), kind)


def _read_part(batches):
    for batch in batches:
        for part in batch.to_pylist():
            n, base = part["n_docs"], part["base"]
            offsets, docs = _mapped(f"{part['path']}.off", "<i8", n + 1), _mapped(f"{part['path']}.doc", "<i8", n)
            ids = _mapped(f"{part['path']}.ids", f"<u{part['width']}", part["n_tokens"])
            for a in range(0, n, READ_DOCS):
                at = np.asarray(offsets[a:a + READ_DOCS + 1])
                own = np.asarray(docs[a:a + READ_DOCS])
                sums = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(own, pa.int64(), mask=own == NO_ID), "start": pa.array(at[:-1] + base, pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})


def read(manifest: DataFrame) -> DataFrame:
    """Every document of a manifest: doc_id, start, n_tokens and ids_crc32 from the files.

    The parts are dealt out by a number of partitions of their own, which Spark does not merge again.
    """
    return manifest.repartition(max(1, manifest.count()), F.col("part")).mapInArrow(
        _read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents to files of the shared folder, read them back and delete them."""
    with Workspace(docs.sparkSession) as work:
        return work.result(read(write(docs, work.folder("tokens"), path)))
