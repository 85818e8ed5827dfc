"""Run selection and the failed-job fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import params
from emberline.operators import history
from emberline.operators.ordering import with_position, with_read_position
from emberline.plans.inputs import FAILED, failed_jobs, failed_runs, lookback_start, with_iso
from emberline.session import staging, staging_path
from emberline.sinks.writers import STAGED, write_failed_jobs, write_lines
from emberline.sources import adapter, readers
from emberline.sources.readers import read_failed_jobs

BRANCHES, WORKFLOWS = params.BRANCHES, params.WORKFLOWS


def scan_runs(spark, sf):
    runs = adapter.runs(spark, sf, ("failure",))
    return with_iso(history.select_runs(runs, "failure", branch="main", event="push", workflow="ci.yaml"))


def scan_failed_jobs(spark, sf):
    jobs = history.failed(adapter.jobs(spark, sf, FAILED))
    return jobs.select("run_id", "job_id", "job_name", "conclusion",
                       F.coalesce(adapter.iso(F.col("completed_at")), F.lit("")).alias("completed_at"),
                       F.size("steps").cast("bigint").alias("steps"),
                       F.element_at("steps", -1)["conclusion"].alias("last_step"))


def failed_runs_query(spark, sf):
    return with_iso(failed_runs(spark, sf))


def lookback_filter(spark, sf):
    recent = history.lookback(failed_runs(spark, sf), params.REFERENCE_DATE, params.LOOKBACK_DAYS)
    return with_iso(recent.select("run_id", "branch", "created_at"))


def workflow_filter(spark, sf):
    return with_iso(history.on_workflows(failed_runs(spark, sf), WORKFLOWS).select("run_id", "workflow", "created_at"))


def branch_filter(spark, sf):
    return with_iso(history.on_branches(failed_runs(spark, sf), BRANCHES).select("run_id", "branch", "created_at"))


def merge_queue_filter(spark, sf):
    return with_iso(history.merge_queue(failed_runs(spark, sf), ["main"]).select("run_id", "branch", "event", "created_at"))


def runs_by_id(spark, sf):
    return with_iso(history.by_ids(adapter.runs(spark, sf, FAILED), params.RUN_IDS)
                    .select("run_id", "conclusion", "created_at"))


def first_failed_step(spark, sf):
    return adapter.jobs(spark, sf).select("run_id", "job_id", history.first_failed_step(F.col("steps")).alias("failure_step"))


def failed_jobs_query(spark, sf):
    return failed_jobs(spark, sf).select(*params.FAILED_JOB_COLUMNS)


def skip_jobs(spark, sf):
    rows = history.without_jobs(failed_jobs(spark, sf), params.SKIP_JOBS)
    return rows.groupBy("run_id").agg(F.count("*").alias("jobs"))


def capped_runs(spark, sf):
    runs = history.on_branches(failed_runs(spark, sf), BRANCHES)
    kept = history.capped(runs, ["conclusion", "workflow", "branch"], params.RUN_CAP)
    return with_iso(kept.select("run_id", "conclusion", "workflow", "branch", "created_at"))


def dedup_runs(spark, sf):
    runs = history.collect_runs(adapter.runs(spark, sf, FAILED), WORKFLOWS, BRANCHES)
    listed = runs.select("run_id", "branch", "workflow", "conclusion", "created_at",
                         F.col("source_rank.list").cast("bigint").alias("list_no"))
    return with_iso(with_position(listed, [F.desc("created_at"), F.col("run_id")], "position"))


def runs_union_ids(spark, sf):
    listed = history.lookback(
        history.collect_runs(adapter.runs(spark, sf, FAILED), None, BRANCHES).drop("source_rank"),
        params.REFERENCE_DATE, params.LOOKBACK_DAYS)
    named = history.by_ids(adapter.runs(spark, sf, FAILED), params.RUN_IDS)
    return with_iso(history.union_first(listed, named).select("run_id", "branch", "created_at"))


def run_groups(spark, sf):
    return history.run_groups(failed_jobs(spark, sf))


def csv_roundtrip(spark, sf):
    path = staging_path(spark, "failed-jobs")
    rows = failed_jobs(spark, sf).withColumn("pos", F.struct("run_id", "job_seq", "job_id"))
    write_failed_jobs(rows, path, STAGED)
    return with_read_position(read_failed_jobs(spark, path), [F.col("pos.file")], "position").drop("pos")


def _through_files(spark, name, lines, read):
    """Rows read from text files that are deleted again. `read` should leave only what the result needs."""
    with staging(spark, name) as path:
        write_lines(lines, path)
        return read(spark, path).checkpoint()


def json_runs(spark, sf):
    return with_iso(_through_files(spark, "runs", adapter.run_records(spark, sf), lambda s, p: history.select_runs(
        readers.good_records(readers.read_runs_json(s, p)), "failure", branch="main", event="push", workflow="ci.yaml")))


def json_jobs(spark, sf):
    def read(spark, path):
        return history.failed(readers.good_records(readers.read_jobs_json(spark, path))).select(
            "run_id", "job_id", "job_name", "conclusion", F.coalesce(adapter.iso(F.col("completed_at")), F.lit("")).alias("completed_at"),
            history.first_failed_step(F.col("steps")).alias("failure_step"))
    return _through_files(spark, "jobs", adapter.job_records(spark, sf), read)


def json_quarantine(spark, sf):
    """Records of both sources that cannot be used, by reason, beside the good ones."""
    def counted(name, lines, read):
        state = F.coalesce("problem", F.lit("good")).alias("state")
        return _through_files(spark, name, lines, lambda s, p: read(s, p).groupBy(F.lit(name).alias("source"), state).agg(
            F.count("*").alias("records")))
    return counted("runs", adapter.run_records(spark, sf), readers.read_runs_json).unionByName(
        counted("jobs", adapter.job_records(spark, sf), readers.read_jobs_json))


def commits_tsv(spark, sf):
    return _through_files(spark, "commits", adapter.commit_lines(spark, sf), lambda s, p: readers.read_commits_tsv(s, p, lookback_start()))


def pull_requests_tsv(spark, sf):
    return _through_files(spark, "pull-requests", adapter.pull_request_lines(spark, sf), readers.read_pull_requests_tsv)


def tsv_malformed(spark, sf):
    commits = _through_files(spark, "commits", adapter.commit_lines(spark, sf), lambda s, p: readers.malformed_tsv(s, p, readers.COMMITS_TSV))
    pulls = _through_files(spark, "pull-requests", adapter.pull_request_lines(spark, sf),
                           lambda s, p: readers.malformed_tsv(s, p, readers.PULL_REQUESTS_TSV))
    return commits.select("raw", "problem").unionByName(pulls.select("raw", "problem"))


QUERIES = {
    "json_runs": json_runs, "json_jobs": json_jobs, "json_quarantine": json_quarantine, "commits_tsv": commits_tsv,
    "pull_requests_tsv": pull_requests_tsv, "tsv_malformed": tsv_malformed,
    "scan_runs": scan_runs, "scan_failed_jobs": scan_failed_jobs, "failed_runs": failed_runs_query,
    "lookback_filter": lookback_filter, "workflow_filter": workflow_filter, "branch_filter": branch_filter,
    "merge_queue_filter": merge_queue_filter, "runs_by_id": runs_by_id, "first_failed_step": first_failed_step,
    "failed_jobs": failed_jobs_query, "skip_jobs": skip_jobs, "capped_runs": capped_runs,
    "dedup_runs": dedup_runs, "runs_union_ids": runs_union_ids, "run_groups": run_groups,
    "csv_roundtrip": csv_roundtrip,
}
