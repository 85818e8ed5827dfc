"""Life cycle of run blocks: merging newer versions and the latest status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.categories import has_valid_prefix

# Fixed order of the states; a run only moves to the right, and `error` replaces only
# `pending`, so any analysed state outranks it.
STATUS_RANK = {"pending": 0, "error": 1, "classified": 2, "done": 3}


def status_rank(status: Column) -> Column:
    rank = F.lit(-1)
    for name, value in STATUS_RANK.items():
        rank = F.when(status == name, value).otherwise(rank)
    return rank


def with_status(runs: DataFrame, status: str) -> DataFrame:
    return runs.where(F.col("status") == status)


def latest_versions(updates: DataFrame, columns: list[str]) -> DataFrame:
    """Newest version of each run; versions are combined map-side before the shuffle."""
    return (updates.groupBy("run_id").agg(F.max(F.struct("version", *columns)).alias("new"))
            .select("run_id", "new.*"))


def merge_runs(base: DataFrame, updates: DataFrame, expected: str = "done") -> DataFrame:
    """Replace each run by its newest version; unknown runs are ignored.

    `verified` tells whether the stored status is the expected one after the merge.
    """
    new = latest_versions(updates, ["status"]).select("run_id", F.col("status").alias("new_status"))
    status = F.coalesce("new_status", "status")
    return base.join(new, "run_id", "left").select(
        "run_id", status.alias("status"),
        F.col("new_status").isNotNull().alias("merged"), (status == expected).alias("verified"))


def latest_status(updates: DataFrame) -> DataFrame:
    """The furthest state each run has reached, whatever order the updates come in."""
    return (updates.groupBy("run_id")
            .agg(F.max(F.struct(status_rank(F.col("status")).alias("rank"), "status")).alias("s"),
                 F.count("*").alias("updates"))
            .select("run_id", "s.status", "updates"))


def mark_error(runs: DataFrame, failed: DataFrame) -> DataFrame:
    """Runs named in `failed` become `error`, but only from `pending`."""
    hit = failed.select("run_id").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit") & (F.col("status") == "pending"), "error").otherwise(F.col("status"))
    return runs.join(hit, "run_id", "left").withColumn("status", status).drop("_hit")


def promote(runs: DataFrame, from_status: str, to_status: str) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == from_status, to_status)
                           .otherwise(F.col("status")))


def missing(all_runs: DataFrame, merged: DataFrame) -> DataFrame:
    return all_runs.join(merged.select("run_id"), "run_id", "left_anti")


def has_categories(listed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether a document has categories: listed ones with a description, or valid ones filled in at a job (one row)."""
    # each side is one aggregated row
    some = listed.agg((F.count("*") > 0).alias("listed"))
    filled = jobs.agg((F.count_if(has_valid_prefix(F.col("category"))) > 0).alias("filled"))
    return some.crossJoin(filled).withColumn("has_categories", F.col("listed") | F.col("filled"))
