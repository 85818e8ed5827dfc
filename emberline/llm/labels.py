"""Labelled rows for fitting, and the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row may not teach: crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def usable_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of every labelled row that may teach; an id with several labels counts with the largest one."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))


def training_ids(labels: DataFrame, column: str, rows: int, where: str = "true") -> DataFrame:
    """(doc_id, label) of at most `rows` labelled rows that may teach, chosen by the hash of their id.

    The result is bounded by `rows`.
    """
    return usable_labels(labels, column).where(where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text) of a bounded choice of ids, which is small enough to be broadcast."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
