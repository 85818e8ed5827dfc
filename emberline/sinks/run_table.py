"""A stored table of runs, updated in place by newer versions and read back to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.status import latest_versions

#: Folders of a table; an update rewrites those of the runs that it changes. More for larger tables.
BUCKETS = 64


def _bucket(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def create(runs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store (run_id, status, version), one row a run, in folders by a hash of the id."""
    _write(runs.select("run_id", "status", "version", _bucket(F.col("run_id"), buckets).alias("bucket")), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("run_id", "status", "version")


def upsert(spark: SparkSession, path: str, updates: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Replace stored runs by newer versions; gives run_id, status and verified of every run named in `updates`.

    Runs that the table does not hold are ignored, and a version that is not newer than the stored one changes
    nothing, so an update may be repeated, also after it was cut short. Only folders with a changed run
    are written. `verified` tells whether the status read back from the table is that of the newest version
    offered; it is false for unknown runs and for versions older than the stored one.
    """
    new = latest_versions(updates, ["status"]).withColumn("bucket", _bucket(F.col("run_id"), buckets)).checkpoint()
    stored = spark.read.parquet(path)
    ahead = new.select("bucket", "run_id", F.col("version").alias("new_version"), F.col("status").alias("new_status"))
    both = stored.join(ahead, ["bucket", "run_id"], "left").withColumn(
        "newer", F.coalesce(F.col("new_version") > F.col("version"), F.lit(False)))
    changed = [r["bucket"] for r in both.where("newer").select("bucket").distinct().collect()]  # `buckets` values at most
    if changed:
        rows = both.where(F.col("bucket").isin(changed)).select(
            "run_id", F.when(F.col("newer"), F.col("new_status")).otherwise(F.col("status")).alias("status"),
            F.when(F.col("newer"), F.col("new_version")).otherwise(F.col("version")).alias("version"), "bucket")
        _write(rows.checkpoint(), path)
        spark.catalog.refreshByPath(path)
    found = read(spark, path).select("run_id", "status")
    wanted = new.select("run_id", F.col("status").alias("offered"))
    return wanted.join(found, "run_id", "left").select(
        "run_id", "status", F.coalesce(F.col("status") == F.col("offered"), F.lit(False)).alias("verified"))
