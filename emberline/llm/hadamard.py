"""Vectors as codes of integer codebooks, found by an integer Walsh-Hadamard transform.

A vector becomes integers, floor(256 * x), and is cut into equal consecutive parts; each part position has a
codebook, and a part's code is the index of its nearest entry. Parts and entries are padded with zeros to a
power of two and transformed. The transform keeps squared distances but for the factor of the padded length,
so squared differences are added coefficient by coefficient, in the order of sign changes, where the sum so
far is a lower bound: an entry whose sum exceeds the distance of a known entry is left. Everything is integer
arithmetic, so results are exact and the same for every partitioning.

Vectors that are null or hold null, NaN or infinite components are left out. Shorter vectors are padded with
zeros to the longest one, and all to a multiple of the number of parts. Integers are limited to 2**50 either
way; sums of errors beyond the range of a long come out as its largest value. Null ids come after all others
and repeated ids are coded row by row; among equal ids the smaller vector comes first. With fewer rows than
entries a codebook is as small as the table; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.groups import join_by_key
from emberline.llm.params import CODE_ENTRIES, CODE_PARTS, CODE_ROUNDS, CODE_SCALE

#: Integers beyond this are taken as this, so that the sums of a batch fit into 64 bits.
LIMIT = 1 << 50
LONGEST = (1 << 63) - 1
SUMS = "part int, entry int, n long, sums array<decimal(38,0)>"


def _order(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def transform(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order."""
    n, width = parts.shape
    size = 1 << max(0, (width - 1).bit_length())
    out = np.zeros((n, size), parts.dtype)
    out[:, :width] = parts
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        step *= 2
    return out[:, _order(size)]


def _exact(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if no sum of squares can overflow, else as integers of any length."""
    largest = max((int(np.abs(a).max()) for a in (parts, entries) if a.size), default=0)
    width = parts.shape[1]
    small = 2 * width * (2 * width * largest) ** 2 < 1 << 62
    return (parts, entries) if small else (parts.astype(object), entries.astype(object))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each part; of equally near entries the first."""
    points, centres = map(transform, _exact(parts, entries))
    n, size = points.shape
    lead = centres[:, 0]
    order = np.argsort(lead, kind="stable")
    guess = order[np.minimum(np.searchsorted(lead[order], points[:, 0]), len(order) - 1)]
    bound = ((points - centres[guess]) ** 2).sum(axis=1)
    value = (points[:, :1] - lead[None, :]) ** 2
    row, entry = np.nonzero(value <= bound[:, None])
    value = value[row, entry]
    for j in range(1, size):
        value = value + (points[row, j] - centres[entry, j]) ** 2
        if j == 1 and size > 2:  # the most promising entry so far gives a better bound
            best = entry[_first_smallest(row, value, n)]
            bound = np.minimum(bound, ((points - centres[best]) ** 2).sum(axis=1))
        left = (value <= bound[row]).astype(bool)
        row, entry, value = row[left], entry[left], value[left]
    found = _first_smallest(row, value, n)
    return entry[found], value[found] // size


def _first_smallest(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Place of the first smallest value of each of the rows 0 to n - 1; `row` ascends and has all of them."""
    start = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(value, start)
    place = np.flatnonzero(value == least[row])
    return place[np.searchsorted(row[place], np.arange(n))]


def _matrix(column, width: int) -> np.ndarray:
    """The vectors of a batch as rows of one width, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple]:
    """(batch, parts, codes, errors) of each batch; parts by row, part and place."""
    n_parts, _, width = books.shape
    for batch in batches:
        if not len(batch):
            continue
        parts = _matrix(batch.column("vector"), n_parts * width).reshape(len(batch), n_parts, width)
        found = [nearest(parts[:, p], books[p]) for p in range(n_parts)]
        yield batch, parts, np.stack([f[0] for f in found], axis=1), sum(f[1].astype(object) for f in found)


def _sums(books: np.ndarray):
    """What each entry's parts of a task add up to: at most one row for each entry."""
    n_parts, n_entries, width = books.shape

    def run(batches):
        total = np.zeros((n_parts, n_entries, width), object)
        count = np.zeros((n_parts, n_entries), np.int64)
        for _, parts, codes, _ in _coded(batches, books):
            for p in range(n_parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, start = np.unique(codes[order, p], return_index=True)
                total[p, used] += np.add.reduceat(parts[order, p], start, axis=0).astype(object)
                count[p] += np.bincount(codes[:, p], minlength=n_entries)
        part, entry = np.nonzero(count)
        sums = [[Decimal(int(x)) for x in total[p, e]] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry], pa.int64()),
            "sums": pa.array(sums, pa.list_(pa.decimal128(38, 0)))})
    return run


def _codes(books: np.ndarray, label: pa.DataType):
    def run(batches):
        for batch, _, codes, errors in _coded(batches, books):
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label").cast(label), pa.array(text, pa.string()),
                 pa.array([min(int(e), LONGEST) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])
    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and the integer vector of every row whose vector has finite components only."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(x.cast("double") * CODE_SCALE).cast("long"))))
    return embeddings.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: finite(x.cast("double")))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("vector"))


def codebooks(vectors: DataFrame, n_parts: int = CODE_PARTS, n_entries: int = CODE_ENTRIES, rounds: int = CODE_ROUNDS) -> np.ndarray:
    """Entries by part, index and place. They start as the parts of the first rows by id.

    A round is one pass over the vectors; tasks send one row for each entry in use, so that what
    is shuffled and what the driver sees depends on the codebooks' size alone.
    """
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    width = -(-(longest or 0) // n_parts) or 1
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(n_entries).select("vector").collect()
    books = np.zeros((n_parts, len(first), width), np.int64)
    for e, row in enumerate(first):
        books[:, e] = np.array([*row.vector, *[0] * (n_parts * width - len(row.vector))], np.int64).reshape(n_parts, width)
    for _ in range(rounds if first else 0):
        sums = vectors.select("vector").mapInArrow(_sums(books), SUMS).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        for row in sums.collect():
            books[row.part, row.entry] = [int(s) // row.n for s in row.sums]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(embeddings: DataFrame, n_parts: int = CODE_PARTS, n_entries: int = CODE_ENTRIES,
            rounds: int = CODE_ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every usable row, and the codebooks.

    A code has two hex digits for each part, hence at most 256 entries. The rows are written once
    to a checkpoint, from which the errors of equal labels are added up.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("a code digit pair holds 1 to 256 entries")
    vectors = usable(embeddings)
    books = codebooks(vectors, n_parts, n_entries, rounds)
    kind = vectors.schema["label"].dataType
    schema = f"vec_id long, label {kind.simpleString()}, code string, error long"
    if not books.shape[1]:
        return embeddings.sparkSession.createDataFrame([], f"{schema}, label_error long"), books
    from pyspark.sql.pandas.types import to_arrow_type

    rows = vectors.mapInArrow(_codes(books, to_arrow_type(kind)), schema).checkpoint()
    totals = rows.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LONGEST))).cast("long").alias("label_error"),
        F.count(F.lit(1)).alias("n")).checkpoint()
    return join_by_key(rows, totals, "label", "n"), books


def sql(n_parts: int = CODE_PARTS, n_entries: int = CODE_ENTRIES, rounds: int = CODE_ROUNDS) -> str:
    """The same result by comparing every part with every entry, for vectors of one length that parts divide."""
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({CODE_SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS (SELECT vec_id, label, p, v[1 + p * len(v) // {n_parts}:(p + 1) * len(v) // {n_parts}] AS part FROM kept, range({n_parts}) t(p)),
  book0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INT) AS e, part AS entry
    FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {n_entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (SELECT vec_id, label, p, part, min(struct_pack(d := list_sum(list_transform(list_zip(part, entry),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best FROM parts JOIN book{r} USING (p) GROUP BY vec_id, label, p, part)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (SELECT p, best.e AS e, i, CAST(sum(part[i]) AS BIGINT) AS s, count(*) AS n
      FROM near{r}, range(1, CAST((SELECT max(len(part)) FROM parts) AS BIGINT) + 1) t(i) GROUP BY ALL),
  book{r + 1} AS (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book{r} b LEFT JOIN
    (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM sums{r} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {", ".join(steps)},
  coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, label,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""
