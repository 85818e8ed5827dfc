"""One run or category holding a third of all rows must not become one task."""

import contextlib
import io
from datetime import datetime

from pyspark.sql import functions as F

from emberline.operators import history, rollup


def test_hot_run_is_split_in_the_fact_join(spark):
    keep = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        runs = spark.range(500).select(
            F.col("id").alias("run_id"), F.lit("u").alias("run_url"), F.lit("main").alias("branch"), F.lit("push").alias("event"),
            F.lit("s").alias("commit_sha"), F.lit(datetime(2026, 2, 1)).alias("created_at"), F.lit(1).alias("run_attempt"))
        jobs = spark.range(0, 90000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("run_id"), F.col("id").alias("job_id"),
            F.lit(1).alias("job_seq"), F.sha2(F.col("id").cast("string"), 512).alias("job_name"), F.lit("failure").alias("conclusion"),
            F.lit(None).cast("timestamp").alias("completed_at"),
            F.array(F.struct(F.lit("t").alias("name"), F.lit("failure").alias("conclusion"), F.lit(1).alias("number"))).alias("steps"))
        grouped = history.run_groups(history.failed_jobs(runs, jobs))
        hot = {r.run_id: r.jobs for r in grouped.collect()}
        assert sum(hot.values()) == 90000 and hot[7] > 30000
        # The plan that ran, with its final stages.
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in keep.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_category_is_combined_before_the_shuffle(spark):
    rows = spark.range(0, 30000, 1, 8).select(
        (F.col("id") % 900).alias("run_id"), F.when(F.col("id") % 3 == 0, "bug/hot").otherwise(F.concat(F.lit("bug/c"), (F.col("id") % 50).cast("string"))).alias("category"),
        F.lit("yes").alias("is_flake"), F.lit("").alias("error_message"), F.lit("").alias("summary"), F.lit("u").alias("run_url"),
        F.lit("main").alias("branch"), F.lit("2026-02-01T00:00:00Z").alias("run_started_at"),
        F.struct(F.lit(0).cast("long").alias("age"), F.col("id").alias("run"), F.lit(0).cast("long").alias("seq"), F.col("id").alias("job")).alias("pos"))
    frame = rollup.rollup(rollup.category_runs(rows))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    assert "partial_count" in text.getvalue() and "partial_sum" in text.getvalue()
    got = {r.category: (r.runs, r.jobs) for r in frame.collect()}
    assert got["bug/hot"] == (300, 10000)
