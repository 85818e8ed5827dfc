"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal sets of shingles form a class, represented by its smallest id. Signatures of the
classes are cut into bands; documents that share a band are in one bucket. Pairs of a bucket have their
signatures compared batch by batch: a pair is dropped once the posterior probability that its
similarity reaches the threshold is below a chosen miss probability. What survives is verified on
the full sets. The bands follow from the threshold, so that they too miss a pair that reaches it with that
probability at most. Only components are asked for, so not every pair of a bucket is compared:

1. In some rounds each bucket names one member, chosen anew, and each document is compared with the
   one that most of its buckets name, unless both are already in one component.
2. Then the members of different components within a bucket are compared by their signatures, in
   blocks. Components with members that survive together form clusters, each component in one.
3. Within a cluster, again in blocks, every pair of different components that survives is verified,
   unless links found in the block have joined the two meanwhile. It holds all members that share a bucket
   with another component of the cluster, as a pair that fails here says nothing of the other pairs of
   its components. Nothing is capped.

Null or blank text has no shingles and links with nothing. Other rows of one doc_id count as one document,
which all its texts link, with a row each in the result; a null doc_id links with nothing, its component is null and it is kept.
Other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import sketch
from emberline.llm.components import components
from emberline.llm.groups import by_key
from emberline.llm.params import (
    BLOCK_ROWS, JACCARD_PERCENT, MISS_PROBABILITY, SIGNATURE, SIGNATURE_BATCH, STAR_ROUNDS, TEXT_BLOCK_ROWS)
from emberline.llm.store import Workspace
from emberline.llm.words import Runs, blocks, mix, shingles

FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def banding(percent: int, miss: float) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that miss a pair at the threshold with probability `miss` at most.

    Where none fit into SIGNATURE values the signature becomes as long as bands of one row need.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"a threshold is more than 0 and at most 100 percent: {percent}")
    for rows in range(8, 0, -1):
        same = (percent / 100) ** rows
        bands = 1 if same == 1 else math.ceil(math.log(miss) / math.log1p(-same))
        if bands * rows <= SIGNATURE or rows == 1:
            return bands, rows


def signatures(sets: np.ndarray, bounds: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """Minima of `size` hash functions over each non-empty set: rows of unsigned 32-bit numbers."""
    a, b = np.random.default_rng(1729).integers(1, 2**63, (2, size), dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(bounds) - 1, size), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(size):
            out[:, k] = np.minimum.reduceat((sets * a[k] + b[k]) >> np.uint64(32), bounds[:-1])
    return out


def _features(signature):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            size, key, signs = [], [], []
            for _, some in blocks(texts):
                sets, bounds = shingles(Runs(some))
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                rows = iter(signatures(sets, np.concatenate((bounds[:-1][full], bounds[-1:])), signature)) if len(full) else iter(())
                mixed = mix(sets)
                for i, n in enumerate(counts.tolist()):
                    part = slice(bounds[i], bounds[i + 1])
                    size.append(n)
                    key.append((mixed[part].sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(mixed[part]))))
                    signs.append(next(rows).tobytes() if n else None)
            keys = np.array(key, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(size, pa.int64()),
                "set_a": pa.array(keys[:, 0]), "set_b": pa.array(keys[:, 1]), "signature": pa.array(signs, pa.binary())})
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint32)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _bands(bands: int, rows: int):
    weights = np.random.default_rng(99).integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            signs = _matrix(batch.column("signature"))
            if not len(signs):
                continue
            with np.errstate(over="ignore"):
                cut = signs[:, :bands * rows].reshape(-1, bands, rows).astype(np.uint64)
                keys = mix((cut * weights).sum(axis=2, dtype=np.uint64) * np.uint64(1 << 16) + np.arange(bands, dtype=np.uint64))
            ids = np.repeat(batch.column("id").to_numpy(), bands)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "key": pa.array(keys.ravel().view(np.int64)),
                "band": pa.array(np.tile(np.arange(bands, dtype=np.int32), len(batch)))})
    return run


def least_matches(percent: int, miss: float, size: int = SIGNATURE) -> dict[int, int]:
    """For each number n of compared values the least number of matches with which a pair goes on.

    With a uniform prior the posterior of the similarity is a beta distribution; its mass above the
    threshold t equals the probability of at most m successes in n + 1 trials of probability t.
    """
    t, needed = percent / 100, {}
    for n in range(SIGNATURE_BATCH, size + 1, SIGNATURE_BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        needed[n] = m
    return needed


def _survive(left: np.ndarray, right: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Rows whose signatures stay above the bound in every batch."""
    alive, matches, done = np.arange(len(right)), np.zeros(len(right), np.int64), 0
    for n, least in needed.items():
        one = left[done:n] if left.ndim == 1 else left[alive, done:n]
        matches = matches + (one == right[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _compare(needed):
    def run(batches):
        for batch in batches:
            keep = _survive(_matrix(batch.column("sign_a")), _matrix(batch.column("sign_b")), needed)
            yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            texts = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b")]
            sets = {}
            own = list(dict.fromkeys(t or b"" for given in texts for t in given))  # by text: rows of one id may differ
            for first, some in blocks(own):
                values, bounds = shingles(Runs(some))
                for k in range(len(some)):
                    sets[own[first + k]] = values[bounds[k]:bounds[k + 1]]
            keep = [_linked(sets[a or b""], sets[b or b""], percent) for a, b in zip(*texts, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


class _Joined:
    """Components of a block, joined by the links found in it."""

    def __init__(self, labels: np.ndarray):
        places: dict[int, list[int]] = {}
        for place, label in enumerate(labels.tolist()):
            places.setdefault(label, []).append(place)
        self.labels, self.places = labels.copy(), places

    def join(self, a: int, b: int) -> None:
        low, high = sorted((int(self.labels[a]), int(self.labels[b])))
        moved = self.places.pop(high)
        self.labels[moved] = low
        self.places[low] += moved


def _survivors(rows: pa.Table, left: int, right: int):
    """(place, places) of each document of the left block and those of other components in the right one.

    `joined` may grow while the pairs are gone through; a component met once is not offered again
    after it was joined.
    """
    signs, block = _matrix(rows["signature"]), rows["block"].to_numpy()
    joined = _Joined(rows["component"].to_numpy())
    first, second = np.flatnonzero(block == left), np.flatnonzero(block == right)

    def pairs(needed):
        for i in first.tolist():
            other = second[joined.labels[second] != joined.labels[i]]
            other = other[other > i] if left == right else other
            if len(other):
                yield i, other[_survive(signs[i], signs[other], needed)]

    return joined, pairs


def _gather(needed):
    """Pairs of components of a bucket with members that survive together, as many as connect them."""
    def run(batches):
        for (_, left, right), rows in by_key(batches, ("key", "left_block", "right_block")):
            joined, pairs = _survivors(rows, left, right)
            named, links = rows["component"].to_numpy(), []
            for i, others in pairs(needed):
                for j in others.tolist():
                    if joined.labels[i] != joined.labels[j]:
                        links.append((named[i], named[j]))
                        joined.join(i, j)
            yield _pair_batch(links)
    return run


def _close(percent, needed):
    """Verified links that join different components of a cluster."""
    def run(batches):
        for (_, left, right), rows in by_key(batches, ("cluster", "left_block", "right_block")):
            joined, pairs = _survivors(rows, left, right)
            ids, texts = rows["id"].to_numpy(), rows["text"]
            links, sets = [], {}

            def shingled(i, sets=sets, texts=texts):
                if i not in sets:
                    sets[i] = shingles(Runs([(texts[i].as_py() or "").encode()]))[0]
                return sets[i]

            for i, others in pairs(needed):
                for j in others.tolist():
                    if joined.labels[i] != joined.labels[j] and _linked(shingled(i), shingled(j), percent):
                        links.append((ids[i], ids[j]))
                        joined.join(i, j)
            yield _pair_batch(links)
    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _pair_batch(pairs):
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """A row of each document for each pair of blocks of its group that its own block is in; `n` counts the group."""
    count = F.expr(f"int((n + {size - 1}) div {size})")
    spread = rows.withColumn("block", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), count - 1)))
    placed = spread.withColumn("left_block", F.least("block", "with")).withColumn("right_block", F.greatest("block", "with"))
    names = (key, "left_block", "right_block")
    return placed.drop("n", "with").repartition(*names).sortWithinPartitions(*names)


def _held(bits):
    def run(batches):
        for batch in batches:
            ids = batch.column("h").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(sketch.may_hold(bits.value, ids)))
    return run


def near_duplicates(docs: DataFrame, percent: int = JACCARD_PERCENT, miss: float = MISS_PROBABILITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, for links at `percent` similarity."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands, rows = banding(percent, miss)
    size = max(SIGNATURE, bands * rows)
    needed, spark = least_matches(percent, miss, size), docs.sparkSession
    with Workspace(spark) as work:
        features = work.table(docs.mapInArrow(_features(size), FEATURES), "features")
        filled = features.where("n_shingles > 0 and doc_id is not null")
        classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"))
        classes = work.table(classes, "classes")
        reps = filled.withColumnRenamed("doc_id", "id").join(
            classes, ["id", "set_a", "set_b", "n_shingles"], "left_semi").select("id", "signature")
        reps = work.table(reps, "signatures")

        keyed = reps.mapInArrow(_bands(bands, rows), "id long, key long, band int")
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = work.table(keyed.join(shared, "key"), "members")
        wanted = members.select("id").distinct()
        bits = spark.sparkContext.broadcast(sketch.build(wanted.select(F.xxhash64("id").alias("h")), "h"))
        hashed = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("h"))
        near = hashed.mapInArrow(_held(bits), "id long, text string, h long").drop("h")
        texts = work.table(near.join(wanted, "id", "left_semi"), "texts")

        def verified(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
            pairs = work.table(pairs.distinct(), name)
            both = pairs.join(reps.select(F.col("id").alias("a"), F.col("signature").alias("sign_a")), "a").join(
                reps.select(F.col("id").alias("b"), F.col("signature").alias("sign_b")), "b")
            alive = work.table(both.mapInArrow(_compare(needed), "a long, b long"), name)
            whole = alive.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
                texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            return pairs, work.table(whole.mapInArrow(_verify(percent), "a long, b long"), name)

        tested = links = None
        for turn in range(STAR_ROUNDS):
            open_ = members if links is None else _open(members, components(links, work=work))
            named = open_ if links is not None else open_.withColumn("component", F.col("id"))
            star = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("b"), F.col("component").alias("other"))
            chosen = named.groupBy("key").agg(F.min(star).alias("star")).select("key", "star.b", "star.other")
            named = named.join(chosen, "key").where("component <> other").groupBy("id", "b").agg(F.count(F.lit(1)).alias("n"))
            best = named.groupBy("id").agg(F.max(F.struct("n", "b")).alias("best"))
            pairs = best.select(F.least("id", "best.b").alias("a"), F.greatest("id", "best.b").alias("b"))
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs, found = verified(pairs, f"star{turn}")
            tested, links = (pairs, found) if tested is None else (tested.union(pairs), links.union(found))

        open_ = work.table(_open(members, components(links, work=work)), "open")
        rest = _blocks(open_.join(reps, "id"), "key", BLOCK_ROWS).mapInArrow(_gather(needed), "a long, b long")
        clusters = components(work.table(rest, "rest"), work=work).toDF("component", "cluster")
        placed = open_.select("id", "key", "component").join(clusters, "component")
        several = placed.groupBy("key", "cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        inside = placed.join(several.select("key", "cluster"), ["key", "cluster"], "left_semi").select("id", "component", "cluster").distinct()
        sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        inside = inside.join(sizes, "cluster").join(reps, "id").join(texts, "id")
        found = work.table(_blocks(inside, "cluster", TEXT_BLOCK_ROWS).mapInArrow(
            _close(percent, needed), "a long, b long"), "closed")
        groups = components(links.union(found).union(_own_links(filled, classes)), work=work).withColumnRenamed("component", "component_id")

        of_class = classes.join(groups, "id", "left").select(
            "set_a", "set_b", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        found = features.drop("signature").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
        alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
        component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
        return work.result(found.select(
            "doc_id", "n_shingles", component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their components."""
    named = members.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return named.join(several.select("key"), "key", "left_semi")


def _own_links(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): ids whose rows are of several classes, with the representative of each of these."""
    key = F.struct("set_a", "set_b", "n_shingles")
    several = filled.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x <> y").select("doc_id")
    rows = filled.drop("signature").join(several, "doc_id", "left_semi")
    return rows.join(classes, ["set_a", "set_b", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
