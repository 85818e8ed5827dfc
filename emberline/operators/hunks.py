"""Stretches of log lines around hits, as numbered hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.ordering import with_position
from emberline.params import GREP_CONTEXT


def context_hunks(lines: DataFrame, pattern: str, context: int = GREP_CONTEXT) -> DataFrame:
    """Per job the hunks of lines within `context` lines of a hit; overlapping and touching frames are one hunk.

    Frames touch when their hits are at most 2 * context + 1 lines apart. Lines are cut into buckets of that
    width: hits of one bucket always belong together, and those of two buckets only if these are neighbours, so a
    bucket is reduced to its first and last hit before the shuffle. A bucket that no neighbour continues begins or ends
    a hunk, found by a join on the bucket number. The n-th begin and the n-th end of a log are one hunk: both are
    numbered by a range sort, so no task holds the hits of a whole log. Lines are numbered from 1. The lines are read
    once: those without a hit are one more bucket of their log, without a number, which only tells its length.
    """
    reach = 2 * context + 1
    key = ["run_id", "job_id"]
    bucket = F.when(F.col("text").rlike(pattern), F.floor(F.col("line_no") / reach).cast("bigint"))
    logs = (lines.groupBy(*key, bucket.alias("bucket"))
            .agg(F.min("line_no").alias("first_hit"), F.max("line_no").alias("last_hit"))).checkpoint()
    buckets = logs.where("bucket is not null")
    earlier = buckets.select(*key, (F.col("bucket") + 1).alias("bucket"), F.col("last_hit").alias("hit_before"))
    later = buckets.select(*key, (F.col("bucket") - 1).alias("bucket"), F.col("first_hit").alias("hit_after"))
    near = buckets.join(earlier, [*key, "bucket"], "left").join(later, [*key, "bucket"], "left")

    def apart(distance):
        return F.coalesce(distance > reach, F.lit(True))

    begins = near.where(apart(F.col("first_hit") - F.col("hit_before"))).select(*key, "bucket", "first_hit")
    ends = near.where(apart(F.col("hit_after") - F.col("last_hit"))).select(*key, "bucket", "last_hit")
    begins = with_position(begins, [F.col("bucket")], "hunk_no", key).drop("bucket")
    ends = with_position(ends, [F.col("bucket")], "hunk_no", key).drop("bucket")
    length = logs.groupBy(*key).agg(F.max("last_hit").alias("n_lines"))
    return begins.join(ends, [*key, "hunk_no"]).join(length, key).select(
        *key, "hunk_no", F.greatest(F.lit(1), F.col("first_hit") - context).alias("first_line"),
        F.least("n_lines", F.col("last_hit") + context).alias("last_line"))
