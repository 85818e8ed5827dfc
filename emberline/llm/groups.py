"""Groups of sorted rows that stream through a task, and joins on keys of any share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.params import HOT_KEYS


def by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each stretch of rows that agree in the integer columns `names`."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[a].tolist())
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def join_by_key(rows: DataFrame, unique: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `unique`, which has one row for each key and its number of rows in `count`.

    A key may hold any share of the rows: fewer than HOT_KEYS keys can each hold more than their HOT_KEYSth part, so
    the table of those is broadcast; all others meet in a shuffle. Null matches null; rows without a match are
    left out. Both tables are read several times and should be written ones.
    """
    total = unique.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS > total
    added = [c for c in unique.columns if c not in (key, count)]

    def side(part: DataFrame) -> DataFrame:
        return part.select(F.col(key).alias("_key"), *added)

    common, rare = F.broadcast(side(unique.where(hot))), side(unique.where(~hot))
    met = rows.join(common, rows[key].eqNullSafe(common["_key"])).drop("_key")
    rest = rows.join(common.select("_key"), rows[key].eqNullSafe(common["_key"]), "left_anti")
    return met.unionByName(rest.join(rare, rest[key].eqNullSafe(rare["_key"])).drop("_key"))
