"""Parsers of run blocks: run fields and job sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import field, strip

RUN_FIELDS = ("status", "run_url", "branch", "event", "run_started_at", "run_attempt", "commit_sha")
# (column, field name in the document)
JOB_FIELDS = (
    ("job_conclusion", "job_conclusion"), ("step", "step"), ("job_id", "job_id"),
    ("category", "category"), ("is_flake", "is_flake"), ("test_id", "test-id"),
    ("failed_test", "failed_test"), ("error_message", "error_message"), ("summary", "summary"),
)
JOB_MARK = "#### job:"


def block_fields(blocks: DataFrame) -> DataFrame:
    """The run fields of each block: they stand before its first job. Works on streams."""
    head = F.substring_index("body", JOB_MARK, 1)
    return blocks.select("pos", "run_id", *[field(head, f).alias(f) for f in RUN_FIELDS])


def run_fields(blocks: DataFrame) -> DataFrame:
    """One row per run, from its first block."""
    rows = block_fields(blocks).select("run_id", F.struct("pos", *RUN_FIELDS).alias("first"))
    return rows.groupBy("run_id").agg(F.min("first").alias("first")).select(
        "first.pos", "run_id", *[f"first.{f}" for f in RUN_FIELDS])


def job_rows(blocks: DataFrame) -> DataFrame:
    """One row per job section, in block order, with the fields of its run."""
    head = F.substring_index("body", JOB_MARK, 1)
    pieces = F.split("body", JOB_MARK)
    # the name stands between the first two back-ticks, which follow one space
    marked = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda s: F.split(s, "`", 3))
    named = F.filter(marked, lambda p: (F.size(p) == 3) & (p[0] == " ") & (p[1] != ""))
    sections = F.transform(named, lambda p: F.struct(p[1].alias("name"), p[2].alias("text")))
    rows = blocks.select(
        "pos", "run_id", *[field(head, f).alias(f) for f in RUN_FIELDS],
        F.posexplode(sections).alias("job_no", "section"))
    text = F.col("section")["text"]
    return rows.select(
        F.struct(F.col("pos").alias("block"), F.col("job_no").alias("job")).alias("pos"),
        "run_id", *RUN_FIELDS, strip(F.col("section")["name"]).alias("job_name"),
        *[field(text, name).alias(column) for column, name in JOB_FIELDS])
