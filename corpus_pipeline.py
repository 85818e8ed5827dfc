"""A corpus from raw documents: filtered, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage before
it kept. All but the last return the columns of `documents`. The inputs of a stage are written as
Parquet, so a lost executor costs the tasks it ran and no earlier stage.

Rows with null text are rejected by the quality rules, like all texts without words. Rows of one doc_id
count as one document in the near-duplicate stage. Other columns pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe_chunks, lines, minhash, mixing, queries, rules, store
from emberline.session import discard, staging_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    store.session(spark)
    return rules.judge(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id."""
    store.session(spark)
    dropped = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_id"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier one holds."""
    store.session(spark)
    return lines.deduplicated(docs).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target weights."""
    store.session(spark)
    return mixing.mixed(docs).where("kept").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of what they decode to."""
    store.session(spark)
    return bpe_chunks.encoded(docs, queries.tokenizer_path(queries.MERGE_TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("mixing_weights", mixing_weights), ("bpe_encoding", bpe_encoding)]

#: Verified near-duplicates and byte-pair merges cannot be written in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again; gives the last one's rows.

    A stage's folder is deleted when the next one is written; that of the last stays, as the result reads it.
    """
    store.session(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name}-{uuid.uuid4().hex[:8]}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
