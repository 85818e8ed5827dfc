"""Category report figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import params
from emberline.functions import categories as cat
from emberline.functions.dates import relative_date, utc_epoch
from emberline.functions.text import clip
from emberline.operators import correlate, report, rollup
from emberline.operators.ordering import with_position
from emberline.plans import inputs
from emberline.plans.inputs import categories, done, valid
from emberline.sources import adapter


def _reference():
    return F.lit(params.REFERENCE_DATE).cast("date")


def category_rollup(spark, sf):
    """One report row per category; its test ids and subcategories are rows of their own queries."""
    rows = valid(spark, sf)
    counts = rollup.value_counts(rollup.category_values(rows))
    return (rollup.rollup(rollup.category_runs(rows)).join(counts, "category", "left")
            .select("category", "flake", "runs", "jobs", "example_error", "example_summary",
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_test_ids", "n_subcategories")],
                    relative_date(F.col("last_started_at"), _reference()).alias("last_occurred")))


def flake_status(spark, sf):
    return categories(spark, sf).select("category", "flake")


def run_verdicts(spark, sf):
    return inputs.verdicts(spark, sf)


def report_totals(spark, sf):
    return rollup.totals(inputs.verdicts(spark, sf))


def examples(spark, sf):
    return categories(spark, sf).select("category", "example_error", "example_summary")


def last_occurred(spark, sf):
    return categories(spark, sf).select("category", "last_started_at")


def category_first_seen(spark, sf):
    return categories(spark, sf).select("category", "first_started_at")


def affected_runs(spark, sf):
    rows = rollup.affected_runs(rollup.category_runs(valid(spark, sf)))
    return with_position(rows, [F.desc("epoch"), F.col("run_id")], "position", ["category"])


def test_ids(spark, sf):
    return rollup.listed_test_ids(done(spark, sf), "run_id", "job_id")


def category_test_ids(spark, sf):
    return rollup.category_test_ids(valid(spark, sf))


def category_subcategories(spark, sf):
    return rollup.category_subcategories(valid(spark, sf))


def split_category(spark, sf):
    c = F.col("category")
    return adapter.classified(spark, sf).select(
        "run_id", "job_id", cat.report_category(c).alias("report_category"),
        cat.subcategory(c).alias("subcategory"), cat.list_category(c).alias("list_category"))


def valid_categories(spark, sf):
    return valid(spark, sf).select("run_id", "job_id", "full_category")


def classified_done(spark, sf):
    return done(spark, sf).select("run_id", "job_id", "category", "is_flake")


def utc_epoch_query(spark, sf):
    stamp = _mixed_stamps()
    return adapter.runs(spark, sf).select("run_id", stamp.alias("stamp"), utc_epoch(stamp).alias("epoch"))


def _mixed_stamps():
    """ISO stamps in the accepted forms: Z, offset, date only, missing, unreadable."""
    key = F.col("run_id")
    local = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return (F.when(key % 5 == 0, F.concat(local, F.lit("Z"))).when(key % 5 == 1, F.concat(local, F.lit("-05:00")))
            .when(key % 5 == 2, F.date_format("created_at", "yyyy-MM-dd")).when(key % 5 == 3, "")
            .otherwise("not-a-date"))


def relative_dates(spark, sf):
    stamp = _mixed_stamps()
    return adapter.runs(spark, sf).select("run_id", relative_date(stamp, _reference()).alias("relative"))


def truncate_fields(spark, sf):
    """Real free text of every length: the documents table."""
    text = F.col("text")
    return adapter.table(spark, sf, "documents").select(
        "doc_id", clip(text, 200, 200).alias("error_text"), clip(text, 600, 600).alias("summary_text"),
        clip(text, 40, 37).alias("branch_text"), clip(text, 120, 117).alias("description_text"),
        F.substring(text, 1, 7).alias("short_sha"))


def ranked_categories(spark, sf):
    return report.numbered(categories(spark, sf)).select("category", "runs", "number")


def numbered_categories(spark, sf):
    rows = report.numbered(categories(spark, sf))
    return rows.select("number", "category", F.when(F.col("flake") == "yes", "flakes").otherwise("real").alias("in_table"))


def _descriptions(rows):
    """First summary of each full category, where it has one."""
    return (rows.groupBy("full_category").agg(F.min(F.struct("pos", "summary")).alias("first"))
            .select("full_category", F.col("first.pos").alias("pos"), F.col("first.summary").alias("description"))
            .where(F.col("description") != ""))


def describe_categories(spark, sf):
    rows = valid(spark, sf)
    names = rows.select("category").distinct()
    return rollup.describe(names, _descriptions(rows)).select("category", "description")


def categories_with_fixes(spark, sf):
    counts = correlate.item_counts(inputs.fix_items(spark, sf))
    names = valid(spark, sf).select("category").distinct()
    return names.join(counts, "category", "left").select(
        "category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fixes", "matches", "possible")])


def category_fix_items(spark, sf):
    """Every category with its fixes attached, here written as one text."""
    names = valid(spark, sf).select("category").distinct()
    attached = correlate.with_items(names, inputs.fix_items(spark, sf))
    parts = F.transform("fixes", lambda f: F.concat_ws(" ", f["type"], F.coalesce(f["sha"], f["id"].cast("string")), f["confidence"], f["title"]))
    return attached.select("category", F.size("fixes").cast("bigint").alias("n_fixes"), F.array_join(parts, "; ").alias("fixes"))


QUERIES = {
    "category_fix_items": category_fix_items,
    "category_rollup": category_rollup, "flake_status": flake_status, "run_verdicts": run_verdicts,
    "report_totals": report_totals, "examples": examples, "last_occurred": last_occurred,
    "category_first_seen": category_first_seen, "affected_runs": affected_runs, "test_ids": test_ids,
    "category_test_ids": category_test_ids, "category_subcategories": category_subcategories,
    "split_category": split_category, "valid_categories": valid_categories,
    "classified_done": classified_done, "utc_epoch": utc_epoch_query, "relative_dates": relative_dates,
    "truncate_fields": truncate_fields, "ranked_categories": ranked_categories,
    "numbered_categories": numbered_categories, "describe_categories": describe_categories,
    "categories_with_fixes": categories_with_fixes,
}
