"""Run documents: rendering, parsing and the run life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import categories as cat
from emberline.operators import rollup, status
from emberline.operators.ordering import with_read_position
from emberline.params import FAILED_JOB_COLUMNS
from emberline.plans.inputs import FAILED, failed_jobs, failed_runs
from emberline.session import staging, staging_path
from emberline.sinks import run_table, writers
from emberline.sources import adapter, documents, readers
from emberline.streaming import status_table


def _block_input(spark, sf):
    """Document rows of every failed run, whatever its status."""
    return adapter.classified(spark, sf).select(
        "run_id", "status", "run_url", "branch", "event", "run_started_at", "run_attempt", "commit_sha",
        "created_at", "job_seq", "job_id", "job_name", "job_conclusion", F.col("failed_step").alias("step"),
        "category", "is_flake", "test_id", F.col("job_name").alias("failed_test"), "error_message", "summary", "pos")


def render_run_blocks(spark, sf):
    return writers.block_pieces(_block_input(spark, sf)).select("run_id", "part", "job_seq", "job_key", "text")


def _written_blocks(spark, sf):
    path = staging_path(spark, "progress")
    writers.write_run_document(writers.block_pieces(_block_input(spark, sf)), path, writers.STAGED)
    return readers.read_run_document(spark, path)


def progress_run_blocks(spark, sf):
    return documents.run_fields(_written_blocks(spark, sf)).drop("pos")


def progress_jobs(spark, sf):
    return documents.job_rows(_written_blocks(spark, sf)).select(
        "run_id", "job_id", "job_name", "job_conclusion", "step", "category", "is_flake", "test_id",
        "failed_test", "error_message", "summary")


def _write_new_document(spark, sf, path):
    """The failed-job file of all rows, and the new document made from it."""
    with staging(spark, "failed-jobs") as csv:
        writers.write_failed_jobs(failed_jobs(spark, sf).withColumn("pos", F.struct("run_id", "job_seq", "job_id")), csv, writers.STAGED)
        writers.write_pending_document(writers.pending_document(readers.read_failed_jobs(spark, csv)), path, writers.STAGED)


def pending_document_jobs(spark, sf):
    """Every job section of the new document with its place in it and the fields of its run.

    The document stays in the shared folder, as the result reads it.
    """
    path = staging_path(spark, "pending")
    _write_new_document(spark, sf, path)
    rows = documents.job_rows(readers.read_run_document(spark, path))
    return with_read_position(rows, [F.col("pos.block.file"), F.col("pos.block.block")], "position").drop("pos")


def pending_document_head(spark, sf):
    """What stands before the first block, and how many runs follow."""
    def read(path):
        records = spark.read.text(path, lineSep=readers.BLOCK_START).select("value", F.struct(
            F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("record")).alias("pos"))
        blocks = readers.parse_run_records(records).agg(F.count_distinct("run_id").alias("runs"))
        return records.agg(F.min_by("value", "pos").alias("head")).crossJoin(blocks)  # one row each
    with staging(spark, "pending") as path:
        _write_new_document(spark, sf, path)
        return read(path).checkpoint()


def category_list(spark, sf):
    return rollup.category_list(adapter.classified(spark, sf))


def category_descriptions(spark, sf):
    path = staging_path(spark, "categories")
    writers.write_category_section(category_list(spark, sf), path)
    return readers.parse_descriptions(readers.read_category_section(spark, path)).drop("pos")


def has_categories(spark, sf):
    """One row per status: whether any of its jobs carries a known category."""
    return (adapter.classified(spark, sf).groupBy("status")
            .agg(F.bool_or(cat.has_valid_prefix(F.col("category"))).alias("has_categories")))


def document_has_categories(spark, sf):
    """Of the new document, of one with filled-in jobs and of one with its category list: whether it has categories."""
    def state(name, listed, jobs):
        return status.has_categories(listed, jobs).withColumn("document", F.lit(name))

    with staging(spark, "pending") as new, staging(spark, "filled") as filled, staging(spark, "listed") as listed:
        rows = failed_jobs(spark, sf).withColumn("pos", F.struct("run_started_at", "run_id", "job_seq", "job_id"))
        # the id keeps its type: the rows are already partitioned by it
        rows = rows.select("pos", "run_id", *[F.col(c).cast("string").alias(c) for c in FAILED_JOB_COLUMNS if c != "run_id"])
        writers.write_pending_document(writers.pending_document(rows), new, writers.STAGED)
        writers.write_run_document(writers.block_pieces(_block_input(spark, sf)), filled, writers.STAGED)
        writers.write_category_section(category_list(spark, sf), listed)
        jobs = {path: documents.job_rows(readers.read_run_document(spark, path)) for path in (new, filled)}
        lists = {path: readers.parse_descriptions(readers.read_category_section(spark, path)) for path in (new, listed)}
        return state("new", lists[new], jobs[new]).unionByName(state("filled", lists[new], jobs[filled])).unionByName(
            state("listed", lists[listed], jobs[new])).checkpoint()


def failing_branches(spark, sf):
    return failed_runs(spark, sf).where(F.col("branch") != "").select("branch").distinct()


def runs_by_status(spark, sf):
    return status.with_status(failed_runs(spark, sf), "pending").select("run_id", "status")


def run_shas(spark, sf):
    return failed_runs(spark, sf).where(F.col("commit_sha") != "").select("commit_sha").distinct()


def _updates(spark, sf):
    """Block versions of runs: each job record is one later version of its run's block."""
    return adapter.jobs(spark, sf).select(
        "run_id", F.struct(F.col("job_seq").alias("no"), F.col("job_id").alias("id")).alias("version"),
        F.when(F.col("conclusion") == "failure", "done").when(F.col("conclusion") == "cancelled", "classified")
         .otherwise("error").alias("status"))


def merge_runs(spark, sf):
    base = failed_runs(spark, sf).select("run_id", F.lit("pending").alias("status"))
    return status.merge_runs(base, _updates(spark, sf))


def stored_runs(spark, sf):
    """A stored table of pending runs after two updates, the second one repeated, as read back."""
    with staging(spark, "runs") as path:
        first = F.struct(F.lit(0).cast("bigint").alias("no"), F.lit(0).cast("bigint").alias("id")).alias("version")
        run_table.create(failed_runs(spark, sf).select("run_id", F.lit("pending").alias("status"), first), path)
        for early in (True, False, False):
            checks = run_table.upsert(spark, path, _updates(spark, sf).where((F.col("version.no") <= 3) == early))
        offered = checks.select("run_id", "verified")
        return run_table.read(spark, path).join(offered, "run_id", "left").select(
            "run_id", "status", (F.col("version.no") > 0).alias("merged"), F.coalesce("verified", F.lit(False)).alias("verified")).checkpoint()


def streamed_status(spark, sf):
    """The run-status table after a stream over documents, one file a batch, with its folders folded on the way."""
    block = F.concat(F.lit("<!-- BEGIN RUN "), F.col("run_id").cast("string"), F.lit(" -->\n- **status**: "), "status",
                     F.lit("\n\n#### job: `a`\n<!-- END RUN "), F.col("run_id").cast("string"), F.lit(" -->\n"))
    with staging(spark, "documents") as source, staging(spark, "status") as target, staging(spark, "stream") as state:
        _updates(spark, sf).select(block.alias("value")).repartition(6).write.text(source)
        query = status_table.start(status_table.document_stream(spark, source, 1), target, state, compact_every=4)
        query.awaitTermination()
        return status_table.read(spark, target).withColumn("run_id", F.col("run_id").cast("bigint")).checkpoint()


def run_status_latest(spark, sf):
    return status.latest_status(_updates(spark, sf))


def unfinished_runs(spark, sf):
    """Failed runs none of whose versions reached `done`."""
    finished = _updates(spark, sf).where(F.col("status") == "done")
    return status.missing(failed_runs(spark, sf).select("run_id"), finished)


def unmerged_runs(spark, sf):
    """Done or classified runs minus those already merged."""
    updates = _updates(spark, sf)
    ready = updates.where(F.col("status") == "done").select("run_id").union(
        updates.where(F.col("status") == "classified").select("run_id")).distinct()
    merged = failed_runs(spark, sf).where(F.col("status") == "done")
    return status.missing(ready, merged)


def status_counts(spark, sf):
    return rollup.status_counts(failed_runs(spark, sf))


def report_unfinished(spark, sf):
    return rollup.unfinished(failed_runs(spark, sf)).select("run_id", "status", "run_url", "status_rank")


def promoted_runs(spark, sf):
    """Left-over classified runs become done, missing ones become error if still pending."""
    latest = run_status_latest(spark, sf).select("run_id", "status")
    base = failed_runs(spark, sf).select("run_id").join(latest, "run_id", "left") \
        .withColumn("status", F.coalesce("status", F.lit("pending")))
    missing = status.missing(base, _updates(spark, sf))
    return status.mark_error(status.promote(base, "classified", "done"), missing)


QUERIES = {
    "render_run_blocks": render_run_blocks, "progress_run_blocks": progress_run_blocks,
    "pending_document_jobs": pending_document_jobs, "pending_document_head": pending_document_head,
    "progress_jobs": progress_jobs, "category_list": category_list,
    "category_descriptions": category_descriptions, "has_categories": has_categories, "document_has_categories": document_has_categories,
    "failing_branches": failing_branches, "runs_by_status": runs_by_status, "run_shas": run_shas,
    "merge_runs": merge_runs, "stored_runs": stored_runs, "streamed_status": streamed_status, "run_status_latest": run_status_latest, "unfinished_runs": unfinished_runs,
    "unmerged_runs": unmerged_runs, "status_counts": status_counts, "report_unfinished": report_unfinished,
    "promoted_runs": promoted_runs,
}
