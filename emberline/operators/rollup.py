"""Category roll-ups, verdicts and totals over the classified fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import categories as cat
from emberline.functions.dates import utc_epoch
from emberline.functions.text import clip, strip


def done_rows(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status") == "done")


def valid_rows(classified: DataFrame) -> DataFrame:
    """Report input: done rows with a known category type, split into report category and
    subcategory."""
    return (done_rows(classified).where(cat.has_valid_prefix(F.col("category")))
            .withColumnRenamed("category", "full_category")
            .withColumn("category", cat.report_category(F.col("full_category")))
            .withColumn("subcategory", cat.subcategory(F.col("full_category"))))


def category_runs(rows: DataFrame) -> DataFrame:
    """The finest grain of the report: one row per (category, run).

    Every category figure is derived from it, so no distinct count is needed. Each
    "first in document order" value is the minimum of a struct led by the position.
    """
    def first(column: str, condition=None):
        value = F.struct(F.col("pos"), F.col(column).alias("value"))
        return F.min(value if condition is None else F.when(condition, value))

    run = F.struct("pos", "run_url", "branch", "run_started_at")
    return rows.groupBy("category", "run_id").agg(
        F.count("*").alias("jobs"),
        F.min(run).alias("run"),
        F.bool_and(F.col("is_flake") == "yes").alias("all_yes"),
        F.bool_and(F.col("is_flake") == "no").alias("all_no"),
        first("error_message", F.col("error_message") != "").alias("error"),
        first("summary", F.col("summary") != "").alias("summary"))


def rollup(grain: DataFrame) -> DataFrame:
    """One row per category: counts, flake status, examples and last occurrence."""
    return (grain.groupBy("category").agg(
        F.count("*").alias("runs"), F.sum("jobs").alias("jobs"),
        F.bool_and("all_yes").alias("all_yes"), F.bool_and("all_no").alias("all_no"),
        F.min(F.col("run.pos")).alias("first_pos"),
        F.min("error").alias("error"), F.min("summary").alias("summary"),
        F.max(F.when(F.col("run.run_started_at") != "", F.struct(
            utc_epoch(F.col("run.run_started_at")).alias("epoch"), F.col("run.run_started_at").alias("text"))))
         .alias("last"),
        F.min(F.when(F.col("run.run_started_at") != "", F.struct(
            utc_epoch(F.col("run.run_started_at")).alias("epoch"), F.col("run.run_started_at").alias("text"))))
         .alias("first_seen"))
        .select("category", "runs", "jobs",
                F.when(F.col("all_yes"), "yes").when(F.col("all_no"), "no").otherwise("mixed").alias("flake"),
                F.coalesce("error.value", F.lit("")).alias("example_error"),
                F.coalesce("summary.value", F.lit("")).alias("example_summary"),
                F.coalesce("last.text", F.lit("")).alias("last_started_at"),
                F.coalesce("first_seen.text", F.lit("")).alias("first_started_at"),
                "first_pos"))


def affected_runs(grain: DataFrame) -> DataFrame:
    """(category, run) rows of the report with their sort key `epoch`, newest first."""
    started = F.coalesce(F.col("run.run_started_at"), F.lit(""))
    return grain.select(
        "category", F.col("run_id").cast("string").alias("run_id"),
        F.col("run.run_url").alias("run_url"), F.col("run.branch").alias("branch"),
        F.substring(started, 1, 10).alias("date"), started.alias("run_started_at"),
        F.col("jobs").alias("jobs_failed"), utc_epoch(started).alias("epoch"))


def listed_test_ids(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per listed test id: comma lists split, blanks and field markers dropped."""
    return (rows.select(*keys, F.explode(F.split("test_id", ",")).alias("raw"))
            .select(*keys, strip(F.col("raw")).alias("test_id"))
            .where((F.col("test_id") != "") & ~F.col("test_id").startswith("- **")))


def category_values(rows: DataFrame) -> DataFrame:
    """Distinct (category, kind, value): its test ids and its subcategories, in one pass."""
    def entry(kind: str, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    listed = F.transform(F.split("test_id", ","), lambda t: entry("test_id", strip(t)))
    return (rows.select("category", F.inline(F.concat(listed, F.array(entry("subcategory", F.col("subcategory"))))))
            .where((F.col("value") != "") & ~F.col("value").startswith("- **")).distinct())


def category_test_ids(rows: DataFrame) -> DataFrame:
    return listed_test_ids(rows, "category").distinct()


def category_subcategories(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("subcategory") != "").select("category", "subcategory").distinct()


def value_counts(values: DataFrame) -> DataFrame:
    """Number of test ids and subcategories of each category."""
    return values.groupBy("category").agg(
        F.count_if(F.col("kind") == "test_id").alias("n_test_ids"),
        F.count_if(F.col("kind") == "subcategory").alias("n_subcategories"))


def run_verdict_rows(done: DataFrame) -> DataFrame:
    """Per run: any `no` is a real failure, else any `yes` a flake, else unclear."""
    return (done.groupBy("run_id")
            .agg(F.bool_or(F.col("is_flake") == "no").alias("any_no"),
                 F.bool_or(F.col("is_flake") == "yes").alias("any_yes"),
                 F.count("*").alias("jobs"))
            .select("run_id", "jobs",
                    F.when(F.col("any_no"), "real").when(F.col("any_yes"), "flake")
                     .otherwise("unclear").alias("verdict")))


def totals(verdicts: DataFrame) -> DataFrame:
    """Report totals from one row per run, so runs are counted without a distinct."""
    return verdicts.agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("verdict") == "flake").alias("flake_runs"),
        F.count_if(F.col("verdict") == "real").alias("real_failure_runs"),
        F.count_if(F.col("verdict") == "unclear").alias("unclear_runs"),
        F.coalesce(F.sum("jobs"), F.lit(0)).cast("bigint").alias("total_jobs"))


def category_list(classified: DataFrame) -> DataFrame:
    """The shared category list over classified and done runs.

    Its key is the first two segments, and the first summary counts even when it is empty.
    """
    listed = classified.where(F.col("status").isin("done", "classified")
                              & cat.has_valid_prefix(F.col("category")))
    return (listed.groupBy(cat.list_category(F.col("category")).alias("category"))
            .agg(F.min(F.struct("pos", "summary")).alias("first"))
            .select("category", clip(F.col("first.summary"), 120, 117).alias("description")))


def describe(categories: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Add `description`: exact name, else the first full name whose category it is."""
    exact = descriptions.select(F.col("full_category").alias("category"),
                                F.col("description").alias("_exact"))
    nearest = (descriptions.groupBy(cat.report_category(F.col("full_category")).alias("category"))
               .agg(F.min_by("description", "pos").alias("_near")))
    return (categories.join(exact, "category", "left").join(nearest, "category", "left")
            .withColumn("description", F.coalesce("_exact", "_near", F.lit("")))
            .drop("_exact", "_near"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def unfinished(runs: DataFrame) -> DataFrame:
    """Pending runs first, then failed analyses."""
    return (runs.where(F.col("status").isin("pending", "error"))
            .withColumn("status_rank", F.when(F.col("status") == "pending", 0).otherwise(1)))
