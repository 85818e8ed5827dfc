"""Positions in a sorted result without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_position(df: DataFrame, order: list[Column], name: str,
                  within: list[str] | None = None) -> DataFrame:
    """Add the 1-based position of each row, overall or within the `within` columns.

    The rows are range-partitioned on the whole sort key, so a group holding most of the
    rows is spread over many partitions. The sorted rows are checkpointed once: from then
    on a row's partition and offset are fixed, and only one count per partition has to be
    added up. Group starts are one row per group.
    """
    within = within or []
    ordered = df.orderBy(*[F.col(c) for c in within], *order).checkpoint()
    tagged = (ordered.withColumn("_tag", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_tag", _ROW_BITS))
              .withColumn("_row", F.col("_tag").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    # One row per partition: its size is bounded by the number of partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (tagged.groupBy("_part").agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    indexed = (tagged.join(F.broadcast(starts), "_part")
               .withColumn("_index", F.col("_start") + F.col("_row"))
               .drop("_tag", "_part", "_row", "_start"))
    if not within:
        return indexed.withColumn(name, F.col("_index") + 1).drop("_index")
    first = indexed.groupBy(*within).agg(F.min("_index").alias("_first"))
    return (indexed.join(first, within)
            .withColumn(name, F.col("_index") - F.col("_first") + 1).drop("_index", "_first"))


def with_read_position(df: DataFrame, split: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of rows as they stand in files: splits in the order of `split`, each in reading order.

    For rows that come straight from a reader. They are read twice, but neither sorted, shuffled nor stored: the rows
    of a split are counted and the counts added up.
    """
    keys = [f"_split{i}" for i in range(len(split))]
    tagged = df.select("*", *[c.alias(k) for c, k in zip(split, keys, strict=True)], F.monotonically_increasing_id().alias("_tag"))
    # One row per split.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = (tagged.groupBy(*keys).agg(F.min("_tag").alias("_first"), F.count("*").alias("_n"))
              .select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset")))
    return (tagged.join(F.broadcast(starts), keys)
            .withColumn(name, F.col("_tag") + F.col("_offset")).drop(*keys, "_tag", "_offset"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key; Spark limits each group before the shuffle too."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
