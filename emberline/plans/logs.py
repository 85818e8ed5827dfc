"""Log signals, verdicts and convergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import params
from emberline.functions import categories as cat
from emberline.functions.text import clean_log, mask_digits
from emberline.operators import convergence, correlate, hunks, rollup, rules, signals, verdicts
from emberline.plans.inputs import FAILED, categories, failed_runs, signal_jobs
from emberline.sources import adapter, readers

SIMILAR_PERCENT = 70


def log_lines(spark, sf):
    return adapter.log_lines(spark, sf)


def log_line_counts(spark, sf):
    return signals.line_counts(adapter.log_lines(spark, sf))


def failure_markers(spark, sf):
    return signals.marker_hits(adapter.log_lines(spark, sf)).select("run_id", "job_id", "line_no", "framework", "kind")


def normalize_errors(spark, sf):
    return adapter.log_lines(spark, sf).select("run_id", "job_id", "line_no", clean_log(F.col("text")).alias("error_text"))


def extract_test_ids(spark, sf):
    return signals.failing_tests(adapter.log_lines(spark, sf))


def grep_context(spark, sf):
    return signals.grep(adapter.log_lines(spark, sf), r"--- FAIL:|timed out")


def drop_aggregation_jobs(spark, sf):
    found = signals.job_signals(adapter.log_lines(spark, sf))
    return signals.own_failures(adapter.jobs(spark, sf, FAILED), found).select("run_id", "job_id", "conclusion")


def compose_category(spark, sf):
    """Category of each log signature when nothing but the log is known."""
    found = signals.job_signals(adapter.log_lines(spark, sf))
    kind = F.when(F.col("build"), "build-error").when(~F.col("ran_test"), "infra-flake").otherwise("test-flake")
    return found.select("run_id", "job_id", cat.compose(
        kind, cat.slug(F.col("signature")), F.lit(False), F.col("test_id")).alias("category"))


def intermittent_same_commit(spark, sf):
    return verdicts.same_commit(adapter.runs(spark, sf), adapter.jobs(spark, sf))


def branch_history(spark, sf):
    return verdicts.branch_history(adapter.runs(spark, sf), adapter.jobs(spark, sf))


def branch_history_short(spark, sf):
    return verdicts.branch_history(adapter.runs(spark, sf), adapter.jobs(spark, sf), last=2)


def cascade_cancel(spark, sf):
    jobs = adapter.jobs(spark, sf, FAILED)
    return verdicts.cascade_cancelled(jobs).select("run_id", "job_id", "job_name")


def commit_touches_test(spark, sf):
    found = signals.job_signals(adapter.log_lines(spark, sf))
    return verdicts.touched_tests(found, adapter.runs(spark, sf), adapter.commit_files(spark, sf))


def systemic_failures(spark, sf):
    found = signals.job_signals(adapter.log_lines(spark, sf))
    return verdicts.systemic_signatures(signal_jobs(spark, sf), found)


def _kept_signals(found):
    """The signals of each job in a checkpoint, but for the signature, which the error gives again."""
    return found.drop("signature").checkpoint().withColumn("signature", mask_digits(F.col("error_message")))


def _classify(spark, sf):
    """The logs are read once: what they say is evidence in several ways. The jobs are a table, read with the few columns
    that each kind of evidence needs, which is less than a copy of them."""
    found = _kept_signals(signals.job_signals(adapter.log_lines(spark, sf)))
    return verdicts.classify(adapter.runs(spark, sf), adapter.jobs(spark, sf), found, adapter.commit_files(spark, sf))


def classify_failures(spark, sf):
    return _classify(spark, sf).drop("job_seq")


def _from_logs(spark, sf, judge=_classify):
    """Runs, jobs and logs through signals, verdicts and convergence: done rows under the winning names."""
    run_side = failed_runs(spark, sf).select("run_id", "run_url", "branch", "created_at")
    test = F.when(F.col("test_id") != "", F.concat(F.lit(" in "), F.col("test_id"))).otherwise("")
    judged = judge(spark, sf)
    # what other columns give again is left out of the checkpoint
    rows = (judged.join(run_side, "run_id").checkpoint()
            .withColumn("run_started_at", adapter.iso(F.col("created_at"))).withColumn("pos", adapter.position())
            .withColumn("failed_test", F.col("failed_test" if "failed_test" in judged.columns else "test_id"))
            .withColumn("summary", F.concat(F.col("job_name"), test, F.lit(": "), F.col("reason"))))
    named = rows.withColumn("category", cat.list_category(F.col("category")))
    errors = rollup.rollup(rollup.category_runs(named)).select(
        F.col("category").alias("name"), "runs", F.col("example_error").alias("error")).checkpoint()
    clustered = convergence.clusters(errors.select("name", "error"), int(params.CLUSTER_JACCARD * 100))
    return convergence.renamed(rows, convergence.winners(errors.select("name", "runs"), clustered))


def renamed_categories(spark, sf):
    return _from_logs(spark, sf).select("run_id", "job_id", "category", "is_flake", "failed_test", "summary", "status")


def pipeline_report(spark, sf):
    """Report rows that start from the logs: one per winning name."""
    rows = _from_logs(spark, sf).withColumn("full_category", F.col("category")).withColumn(
        "category", cat.list_category(F.col("category")))
    subs = rows.where(F.length("full_category") > F.length("category")).select("category", "full_category").distinct()
    counted = subs.groupBy("category").agg(F.count("*").alias("n_subcategories"))
    return rollup.rollup(rollup.category_runs(rows)).join(counted, "category", "left").select(
        "category", "flake", "runs", "jobs", "example_error", "example_summary", "first_started_at", "last_started_at",
        F.coalesce("n_subcategories", F.lit(0)).alias("n_subcategories"))


def _rule_hits(spark, sf):
    """Lines of the long logs on which built-in or user rules fire."""
    table = rules.with_user_rules(rules.builtin_rules(spark), adapter.user_rules(spark, sf))
    return rules.hit_lines(adapter.long_log_lines(spark, sf), table)


def rule_hits(spark, sf):
    return rules.marker_rows(_rule_hits(spark, sf))


def rule_categories(spark, sf):
    found = rules.log_category(rules.job_signals(_rule_hits(spark, sf)))
    return found.select("run_id", "job_id", "category", "failed_test", "error_message")


def failing_test_lists(spark, sf):
    return rules.test_lists(rules.named_tests(_rule_hits(spark, sf)))


def _classify_all(spark, sf):
    found = _kept_signals(rules.job_signals(_rule_hits(spark, sf)))
    tests = found.select("run_id", "job_id", F.explode("test_files").alias("test_file"))
    return verdicts.classify(adapter.runs(spark, sf), adapter.jobs(spark, sf), found.drop("test_files"),
                             adapter.commit_files(spark, sf), tests=tests)


def classify_all_tests(spark, sf):
    """Verdicts from the long logs, each with every failed test of its job."""
    return _classify_all(spark, sf).drop("job_seq")


def log_fix_report(spark, sf):
    """From the long logs to the flat rows of the report: each converged category with its fixes, one row a fix."""
    rows = _from_logs(spark, sf, _classify_all).withColumn("category", cat.list_category(F.col("category"))).withColumn(
        "test_id", F.col("failed_test"))
    cats = rollup.rollup(rollup.category_runs(rows)).select("category", "runs", "jobs", "example_error", "first_started_at").checkpoint()
    terms = correlate.search_terms(cats, rollup.category_test_ids(rows)).checkpoint()
    found = correlate.commit_candidates(readers.commit_candidates(adapter.log_commits(spark, sf), "1900-01-01"), params.GIT_BASE, params.REPOSITORY)
    items = correlate.fix_items(correlate.match(terms, cats, found))
    return cats.select("category", "runs", "jobs").join(items.select("category", "type", "sha", "date", "title", "confidence"), "category", "left")


def context_hunks(spark, sf):
    return hunks.context_hunks(adapter.long_log_lines(spark, sf), r"--- FAIL:|FAILED|heartbeat lost|timed out|panic:")


def _errors(spark, sf):
    return categories(spark, sf).select(F.col("category").alias("name"), "runs",
                                        F.col("example_error").alias("error")).checkpoint()


def similar_errors(spark, sf):
    """Similar pairs among the distinct messages of all failed jobs."""
    rows = adapter.classified(spark, sf).where(F.col("error_message") != "")
    sets = convergence.word_sets(rows, "job_id", "error_message").select("set_key", "words")
    return convergence.similar_sets(sets, SIMILAR_PERCENT)


def converge_categories(spark, sf):
    errors = _errors(spark, sf)
    clustered = convergence.clusters(errors.select("name", "error"), int(params.CLUSTER_JACCARD * 100))
    return convergence.winners(errors.select("name", "runs"), clustered)


QUERIES = {
    "log_lines": log_lines, "log_line_counts": log_line_counts, "failure_markers": failure_markers,
    "normalize_errors": normalize_errors, "extract_test_ids": extract_test_ids, "grep_context": grep_context,
    "drop_aggregation_jobs": drop_aggregation_jobs, "compose_category": compose_category,
    "intermittent_same_commit": intermittent_same_commit, "branch_history": branch_history,
    "branch_history_short": branch_history_short, "cascade_cancel": cascade_cancel,
    "commit_touches_test": commit_touches_test, "systemic_failures": systemic_failures,
    "classify_failures": classify_failures, "similar_errors": similar_errors,
    "rule_hits": rule_hits, "rule_categories": rule_categories, "failing_test_lists": failing_test_lists,
    "classify_all_tests": classify_all_tests, "log_fix_report": log_fix_report, "context_hunks": context_hunks,
    "converge_categories": converge_categories, "renamed_categories": renamed_categories, "pipeline_report": pipeline_report,
}
