"""Near-duplicates of embeddings by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the nearest code of either half names a cell of
the product grid. A vector visits cells in the order of its distance to them (the multi-sequence order
of two sorted lists) until the distance exceeds that of its own cell by a margin. The margin is the one
that reaches the target recall on sampled vectors and partners made for them at exactly the threshold.
A pair is compared when the one in the smaller cell visits the cell of the other; every pair that is
compared is verified by its cosine in double precision, in blocks of the rows of one cell.

Equal vectors are one class in the index. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing; a null vec_id counts as an id of its own kind and gives a null component.
Vectors of different length are in different indexes. Rows of one vec_id and equal vector count once. Other
columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import components
from emberline.llm.groups import by_key
from emberline.llm.params import BLOCK_ROWS, CODEBOOK_ROWS, COSINE
from emberline.llm.store import Workspace

CELL_ROWS = 512
CODES_MOST = 1000
TARGET_RECALL = 0.999
VECTORS = "vec_id long, width int, digest binary, vector binary"


def _vectors(batches):
    """Usable vectors as doubles; others have no digest."""
    for batch in batches:
        digests, packed, widths = [], [], []
        for values in batch.column("embedding"):
            row = None
            if values.is_valid and len(values.values) and not values.values.null_count:
                row = np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64)
                norm = np.linalg.norm(row) if np.isfinite(row).all() else 0.0
                row = row / norm if norm > 0 and np.isfinite(norm) else None
            widths.append(0 if row is None else len(row))
            packed.append(None if row is None else row.tobytes())
            digests.append(None if row is None else hashlib.blake2b(packed[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id"), "width": pa.array(widths, pa.int32()),
            "digest": pa.array(digests, pa.binary()), "vector": pa.array(packed, pa.binary())})


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances to the codes, without the part that is equal for all."""
    return (codes * codes).sum(axis=1) - 2 * x @ codes.T


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; codes that lose all their vectors start anew at the vectors farthest from theirs."""
    draw = np.random.default_rng(5)
    codes = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        distance = _nearest(x, codes)
        own = distance.argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(counts)
        codes[full] = np.add.reduceat(x[order], np.cumsum(counts)[full] - counts[full]) / counts[full, None]
        lost = np.flatnonzero(counts == 0)
        codes[lost] = x[np.argsort(-(distance.min(axis=1) + (x * x).sum(axis=1)))[:len(lost)]]
    return codes


class Index:
    """Two codebooks and the margin up to which cells are visited."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = TARGET_RECALL):
        self.half = sample.shape[1] // 2
        k = min(max(1, math.ceil(math.sqrt(rows / CELL_ROWS))), CODES_MOST, len(sample))
        self.codes = codebook(sample[:, :self.half], k), codebook(sample[:, self.half:], k)
        draw = np.random.default_rng(6)
        noise = draw.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        partner = cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * noise / np.maximum(length, 1e-12)
        first, second = self.distances(sample)
        other = [d.argmin(axis=1) for d in self.distances(partner)]
        at = np.arange(len(sample))
        excess = first[at, other[0]] - first.min(axis=1) + second[at, other[1]] - second.min(axis=1)
        self.margin = float(np.quantile(excess, recall, method="higher"))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, :self.half], self.codes[0]), _nearest(x[:, self.half:], self.codes[1])

    def visits(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Cells of one vector from its distances to the codes, nearest first, up to the margin."""
        k = len(second)
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a] - first[a[0]], second[b] - second[b[0]]
        queue, seen, cells = [(0.0, 0, 0)], {(0, 0)}, []
        while queue:
            excess, i, j = heapq.heappop(queue)
            if excess > self.margin:
                break
            cells.append(int(a[i]) * k + int(b[j]))
            for n, m in ((i + 1, j), (i, j + 1)):
                if n < len(x) and m < k and (n, m) not in seen:
                    seen.add((n, m))
                    heapq.heappush(queue, (float(x[n] + y[m]), n, m))
        return cells


def _cells(index):
    """The row of each vector in its cell (probe false) and a row for each cell that it looks into."""
    def run(batches):
        grid = index.value
        for batch in batches:
            first, second = grid.distances(_matrix(batch.column("vector")))
            own = first.argmin(axis=1) * second.shape[1] + second.argmin(axis=1)
            row, cell = list(range(len(own))), own.tolist()
            for i in range(len(own)):
                looked = [c for c in grid.visits(first[i], second[i]) if c >= own[i]]
                row += [i] * len(looked)
                cell += looked
            out = batch.select(["id", "copies", "vector"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(cell, pa.int64()), pa.array(own[row], pa.int64()),
                 pa.array(np.arange(len(row)) >= len(own))], ["id", "copies", "vector", "cell", "own", "probe"])
    return run


def _links(cosine: float):
    """For the vectors of a block: how many rows they link with there, and the least id they reach."""
    def run(batches):
        for (cell, _, _), rows in by_key(batches, ("cell", "index_block", "probe_block")):
            probe = np.asarray(rows["probe"].to_numpy(zero_copy_only=False), bool)
            ids, copies, own = (rows[c].to_numpy() for c in ("id", "copies", "own"))
            vectors = _matrix(rows["vector"])
            hit = vectors[probe] @ vectors[~probe].T >= cosine
            # within one cell both would find each other
            hit &= (own[probe] != cell)[:, None] | (ids[probe][:, None] < ids[~probe])
            of_probe, of_index = hit.any(axis=1), hit.any(axis=0)
            if not of_probe.any():
                continue
            hit = hit[of_probe][:, of_index]
            left, right = ids[probe][of_probe], ids[~probe][of_index]
            n_left, n_right = hit @ copies[~probe][of_index], copies[probe][of_probe] @ hit
            least, other, none = left.copy(), right.copy(), np.iinfo(np.int64).max
            while True:
                other_now = np.minimum(other, np.where(hit, least[:, None], none).min(axis=0))
                least_now = np.minimum(least, np.where(hit, other_now, none).min(axis=1))
                if (other_now == other).all() and (least_now == least).all():
                    break
                least, other = least_now, other_now
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(np.concatenate((left, right))), "linked": pa.array(np.concatenate((n_left, n_right)), pa.int64()),
                "reached": pa.array(np.concatenate((least, other)))})
    return run


def _linked(work: Workspace, classes: DataFrame, cosine: float) -> DataFrame:
    """(id, linked, reached) rows of the classes of one vector length."""
    spark = classes.sparkSession
    sample = _matrix(classes.orderBy(F.xxhash64("id"), "id").limit(CODEBOOK_ROWS).select("vector").toArrow()["vector"])
    index = spark.sparkContext.broadcast(Index(sample, classes.count(), cosine))
    spread = work.table(classes.mapInArrow(
        _cells(index), "id long, copies long, vector binary, cell long, own long, probe boolean"), "cells")
    size = f"int((n + {BLOCK_ROWS - 1}) div {BLOCK_ROWS})"
    counts = spread.groupBy("cell").agg(F.count_if(~F.col("probe")).alias("n_index"), F.count_if("probe").alias("n_probe"))
    counts = counts.where("n_index > 0 and n_probe > 0").select(
        "cell", F.expr(size.replace("n +", "n_index +")).alias("index_blocks"),
        F.expr(size.replace("n +", "n_probe +")).alias("probe_blocks"))
    own = F.when(F.col("probe"), F.pmod(F.xxhash64("id"), "probe_blocks")).otherwise(
        F.pmod(F.xxhash64("id"), "index_blocks")).cast("int")
    against = F.when(F.col("probe"), F.col("index_blocks")).otherwise(F.col("probe_blocks"))
    placed = spread.join(counts, "cell").withColumn("block", own).withColumn(
        "against", F.explode(F.sequence(F.lit(0), against - 1))).select(
        "cell", F.when(F.col("probe"), F.col("against")).otherwise(F.col("block")).alias("index_block"),
        F.when(F.col("probe"), F.col("block")).otherwise(F.col("against")).alias("probe_block"),
        "id", "copies", "own", "probe", "vector")
    key = ("cell", "index_block", "probe_block")
    return placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        _links(cosine), "id long, linked long, reached long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    with Workspace(embeddings.sparkSession) as work:
        vectors = work.table(rows.mapInArrow(_vectors, VECTORS), "vectors")
        usable = vectors.where("digest is not null and vec_id is not null")
        classes = usable.select("vec_id", "digest").distinct().groupBy("digest").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        classes = work.table(classes, "classes")
        first = usable.withColumnRenamed("vec_id", "id").dropDuplicates(["id", "digest"])
        first = work.table(first.join(classes, ["id", "digest"]), "first")
        widths = [r["width"] for r in first.select("width").distinct().collect()]
        found = None
        for width in widths:
            part = _linked(work, first.where(F.col("width") == width), cosine)
            found = part if found is None else found.union(part)
        if found is None:
            found = embeddings.sparkSession.createDataFrame([], "id long, linked long, reached long")
        found = work.table(found, "links")
        groups = components(found, "id", "reached", work)
        linked = found.groupBy("id").agg(F.sum("linked").alias("linked")).join(groups, "id", "left")
        of_class = classes.join(linked, "id", "left").select(
            "digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component"))
        joined = vectors.drop("vector").join(of_class, "digest", "left")
        usable_id = F.col("vec_id").isNotNull()
        component = F.when(usable_id, F.coalesce("component", "vec_id"))
        return work.result(joined.select(
            "vec_id", F.when(usable_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))
