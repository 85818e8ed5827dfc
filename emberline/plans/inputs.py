"""Inputs shared by several plans, derived from the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params
from emberline.operators import correlate, history, rollup, stats
from emberline.sources import adapter
from emberline.sources import readers

FAILED = params.FAILED_CONCLUSIONS


def failed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.runs(spark, sf, FAILED)


def failed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return history.failed_jobs(failed_runs(spark, sf), adapter.jobs(spark, sf, FAILED))


def with_iso(df: DataFrame) -> DataFrame:
    """created_at as ISO text, the form every result carries."""
    return df.withColumn("created_at", adapter.iso(F.col("created_at")))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.valid_rows(adapter.classified(spark, sf))


def done(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.done_rows(adapter.classified(spark, sf))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.rollup(rollup.category_runs(valid(spark, sf)))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.run_verdict_rows(done(spark, sf))


def signal_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Failed jobs of failed runs, the rows whose logs are classified."""
    return adapter.jobs(spark, sf, FAILED).join(
        failed_runs(spark, sf).select("run_id"), "run_id", "left_semi")


def lookback_start() -> str:
    from datetime import date, timedelta

    return str(date.fromisoformat(params.REFERENCE_DATE) - timedelta(days=params.LOOKBACK_DAYS))


def commit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return readers.commit_candidates(adapter.commits(spark, sf), lookback_start())


def pull_requests(spark: SparkSession, sf: str) -> DataFrame:
    return readers.pull_request_candidates(adapter.pull_requests(spark, sf))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.commit_candidates(commit_candidates(spark, sf), params.GIT_BASE, params.REPOSITORY).unionByName(
        correlate.pull_request_candidates(pull_requests(spark, sf)))


def search_terms(spark: SparkSession, sf: str, cats: DataFrame | None = None) -> DataFrame:
    cats = categories(spark, sf) if cats is None else cats
    return correlate.search_terms(cats, rollup.category_test_ids(valid(spark, sf)))


def matches(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    """The rolled-up categories and their terms are read several times: computed once."""
    cats = categories(spark, sf).select("category", "example_error", "first_started_at").checkpoint()
    terms = search_terms(spark, sf, cats).checkpoint()
    return correlate.match(terms, cats, found)


def fix_items(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.fix_items(matches(spark, sf, candidates(spark, sf)))


def phases(spark: SparkSession, sf: str) -> DataFrame:
    return stats.phase_stats(adapter.phase_events(spark, sf))
