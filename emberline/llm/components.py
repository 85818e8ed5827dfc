"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import Workspace


def components(links: DataFrame, left: str = "a", right: str = "b", work: Workspace | None = None) -> DataFrame:
    """(id, component): for every linked id the smallest id it can reach.

    Each round maps every id to one of itself and its neighbours and replaces the links by those between
    the ids mapped to. Two rounds of three take the smallest id, which ends stars at once; the third takes the
    smallest hash, drawn anew, which takes a fixed share of the ids of any graph away, chains included, so
    the rounds grow with the logarithm of the size. An id with very many links only meets aggregations
    that combine before the shuffle and joins on a unique key, whose large partitions Spark splits.
    Null ends are ignored.

    A round's tables are written to a few files, by the number of links before it, and dropped as soon as they are
    used. The result is a table of `work`, or else a checkpoint.
    """
    if work is None:
        with Workspace(links.sparkSession) as own:
            return own.result(components(links, left, right, own))

    def tidy(df: DataFrame, rows: int | None) -> DataFrame:
        ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return work.table(df.where("a <> b").select(*ends).distinct(), "edges", rows)

    edges = tidy(links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")), None)
    layers, sizes = [], []
    while n := edges.count():
        both = edges.select(F.inline(F.array(
            *(F.struct(F.col(x).alias("id"), F.col(y).alias("near")) for x, y in ("ab", "ba", "aa", "bb")))))
        order = F.xxhash64("near", F.lit(len(layers))) if len(layers) % 3 == 2 else F.col("near")
        parent = work.table(both.groupBy("id").agg(F.min_by("near", order).alias("parent")), "parents", 2 * n)
        layers.append(parent)
        sizes.append(2 * n)
        of_a = parent.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        of_b = parent.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        fewer = tidy(edges.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")), n)
        work.drop(edges)
        edges = fewer
    work.drop(edges)
    if not layers:
        return links.sparkSession.createDataFrame([], "id long, component long")
    last = layers.pop()
    found, used = last.withColumnRenamed("parent", "root"), [last]
    while layers:
        below = layers.pop()
        above = found.withColumnRenamed("id", "parent")
        found = below.join(above, "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
        used.append(below)
    if len(used) > 1:
        found = work.table(found, "roots", sizes[0])
        work.drop(*used)
        used = [found]
    smallest = found.groupBy("root").agg(F.min("id").alias("component"))
    named = work.table(found.join(smallest, "root").select("id", "component"), "components", sizes[0])
    work.drop(*used)
    return named
