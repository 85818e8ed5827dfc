"""WARC archives of pages and a globally ordered index of their captures.

Each task writes one archive of gzip members, one a record, in the order of URL key and time, and with it a
locally sorted capture run. The runs are merged by key ranges: a task takes its range of every run
and merges the runs with a loser tree, so that the whole index comes out in order and each URL's captures
form its history. Of records with equal payloads of at least MIN_REVISIT bytes the one of the largest
page_id is the response; the others are revisits that refer to it and hold no payload.

Null html counts as an empty payload, a null URL as an empty one. A null page_id is archived as a response
that nothing refers to. Repeated rows are records of their own; of equal rows all are responses if they
have the largest page_id. Other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import Workspace, file_system, task_file

MIN_REVISIT = 1000
#: Time of capture of page 0; every page is a second later than the one before it.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
READ_BYTES = 1 << 20
CAPTURES = "run long, seq long, url_key string, ts long, page_id long, path string, offset long, length long"
RECORDS = "run long, seq long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key() -> F.Column:
    """Host labels in reverse order, then the path: com,example,www)/path."""
    bare = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^([^/:?#]*)", 1)
    rest = F.regexp_replace(bare, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str):
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url: str, ts: int, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC 1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id),
            "WARC-Date": (EPOCH + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "WARC-Target-URI": " ".join(url.split()), "WARC-Payload-Digest": f"sha1:{digest}",
            "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 "WARC-Refers-To": _record_id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, record type, refers_to) of a record; a response's payload is hashed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page_id, kind = _page_of(field["WARC-Record-ID"]), field["WARC-Type"]
    if kind == "revisit":
        length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
        return page_id, length, field["WARC-Payload-Digest"].removeprefix("sha1:"), kind, _page_of(field["WARC-Refers-To"])
    return page_id, len(payload), hashlib.sha1(payload).hexdigest(), kind, None


def _packed(data: bytes) -> bytes:
    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_pydict({n: pa.array(columns[n], kinds[k]) for n, k in (c.split() for c in schema.split(", "))})


def _write_archive(folder: str):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        fs, path = file_system(task_file(folder, f"pages-{number:06d}") + ".warc.gz")
        out, offset, seq = None, 0, 0
        for batch in batches:
            if out is None and len(batch):
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            rows = {n: [] for n in ("run", "seq", "url_key", "ts", "page_id", "path", "offset", "length")}
            for row in batch.to_pylist():
                data = _packed(record(row["page_id"], row["url"], row["ts"], row["payload"].encode(), row["digest"], row["refers_to"]))
                out.write(data)
                for name, value in (("run", number), ("seq", seq), ("url_key", row["url_key"]), ("ts", row["ts"]), ("page_id", row["page_id"]),
                                    ("path", f"{folder}/{path.rpartition('/')[2]}"), ("offset", offset), ("length", len(data))):
                    rows[name].append(value)
                offset, seq = offset + len(data), seq + 1
            yield _batch(rows, CAPTURES)
        if out is not None:
            out.close()
    return run


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, url_key, ts, payload, digest and refers_to, which is null for responses."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("url_key", url_key())
    base = base.withColumn("ts", F.coalesce("page_id", F.lit(0)) % 10**9).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    large = base.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    return base.join(last.drop("n"), "digest", "left").withColumn("refers_to", refers).drop("last")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive a task; gives the captures, in locally sorted runs. Collect or store them at once."""
    return with_revisits(pages).sortWithinPartitions("url_key", "ts", "page_id").mapInArrow(_write_archive(folder), CAPTURES)


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, the root the overall winner."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = max(1, len(runs))
        self.loser = [-1] * self.size
        for k in range(len(runs) - 1, -1, -1):
            self._play(k)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before b's; an ended run comes last, ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            if self.loser[node] == -1:  # the first to arrive waits for its opponent
                self.loser[node] = winner
                return
            if self._less(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        while self.heads and self.heads[self.loser[0]] is not None:
            k = self.loser[0]
            yield self.heads[k]
            self.heads[k] = next(self.runs[k], None)
            self._play(k)


def _merge(batches):
    from pyspark import TaskContext

    number, runs = TaskContext.get().partitionId(), {}
    for batch in batches:
        for run, seq, key, ts, page in zip(*(batch.column(c).to_pylist() for c in ("run", "seq", "url_key", "ts", "page_id")), strict=True):
            runs.setdefault(run, []).append(((key, ts, page is not None, page or 0), run, seq))
    rank, rows = 0, []
    for (key, _, _, _), run, seq in LoserTree(list(runs.values())):
        rows.append((number, rank, run, seq, key))
        rank += 1
        if len(rows) == 10_000:
            yield _merged(rows)
            rows = []
    yield _merged(rows)


def _merged(rows):
    names = ("range", "at", "run", "seq", "url_key")
    return _batch({n: [r[i] for r in rows] for i, n in enumerate(names)}, MERGED)


MERGED = "range long, at long, run long, seq long, url_key string"


def history(work: Workspace, captures: DataFrame) -> DataFrame:
    """run, seq, url_key and capture_rank, the place of each capture in the global order from 0."""
    ordered = captures.select("run", "seq", "url_key", "ts", "page_id").repartitionByRange("url_key", "ts", "page_id", "run", "seq")
    # each run's part of the range in the order in which the run was written
    merged = work.table(ordered.sortWithinPartitions("run", "seq").mapInArrow(_merge, MERGED), "merged")
    sizes = sorted((r["range"], r["n"]) for r in merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    bases = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    base = captures.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sizes, bases[:-1], strict=True)], "range long, base long")
    return merged.join(F.broadcast(base), "range").select("run", "seq", "url_key", (F.col("base") + F.col("at")).alias("capture_rank"))


def _read_archives(batches):
    for batch in batches:
        for run, path in zip(batch.column("run").to_pylist(), batch.column("path").to_pylist(), strict=True):
            fs, name = file_system(path)
            tool, data, seq, rows = zlib.decompressobj(31), [], 0, []
            with fs.open_input_stream(name, compression=None) as f:
                left = f.read(READ_BYTES)
                while left:
                    data.append(tool.decompress(left))
                    left = tool.unused_data if tool.eof else b""
                    if tool.eof:
                        rows.append((run, seq, *parse(b"".join(data))))
                        tool, data, seq = zlib.decompressobj(31), [], seq + 1
                    if len(rows) == 5_000:
                        yield _records(rows)
                        rows = []
                    left = left or f.read(READ_BYTES)
            if data and any(data):
                raise ValueError(f"{path} ends within a record")
            yield _records(rows)


def _records(rows):
    return _batch({n.split()[0]: [r[i] for r in rows] for i, n in enumerate(RECORDS.split(", "))}, RECORDS)


def read(files: DataFrame) -> DataFrame:
    """Every record of the archives of `files` (run, path), dealt out over as many tasks as there are archives."""
    return files.repartition(max(1, files.count()), F.col("run")).mapInArrow(_read_archives, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages, merge the capture runs, read the archives back and delete them."""
    with Workspace(pages.sparkSession) as work:
        captures = work.table(write(pages, work.folder("archives")), "captures")
        order = history(work, captures)
        found = read(captures.select("run", "path").distinct())
        return work.result(found.join(order, ["run", "seq"]).drop("run", "seq"))
