"""Substring dedup by hashing the units of texts.

A unit is a line or, within a line, a stretch of whole sentences of at least MIN_WORDS words: a shorter
sentence belongs to the next one, so that a passage is cut alike wherever it stands. Units are
normalised (lower case, single spaces) and hashed; of all equal units the one of the smallest doc_id, and
there the first, stays. All others are cut out, with the white space after them. Units of fewer words
at the end of a line are never cut out.

Null text and null doc_id pass unchanged. A row is known by its doc_id and a hash of its text: repeated rows
count as one, rows of one doc_id with different texts as documents of their own, in the order of the hash. A
text may end up empty and may be of any length; one task reads it a unit at a time. Columns named like those
added are replaced, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emberline.llm.store import Workspace

MIN_WORDS = 8
_PIECE = re.compile(r"[^\n.!?]+[.!?]*[^\S\n]*\n?|[.!?]+[^\S\n]*\n?|\n")
#: 12 bytes of digest: two equal among 10**12 different units have a probability of 6e-6.
UNITS = "high long, low int, doc_id long, text_key long, start int, stop int"
ADDED = ("removed", "kept_spans", "n_removed")


def units(text: str, least: int = MIN_WORDS):
    """(start, stop, normalised words) of the units of `text` that can be cut out; offsets in characters."""
    start, words = 0, []
    for found in _PIECE.finditer(text):
        piece, stop = found.group(), found.end()
        words += piece.split()
        if len(words) >= least:
            yield start, stop, words
            start, words = stop, []
        elif piece.endswith("\n"):
            start, words = stop, []


def _unit_rows(batches):
    for batch in batches:
        digests, ids, keys, starts, stops = [], [], [], [], []
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
            for start, stop, words in units(text):
                digests.append(hashlib.blake2b(" ".join(words).lower().encode(), digest_size=12).digest())
                ids.append(doc_id)
                keys.append(key)
                starts.append(start)
                stops.append(stop)
        packed = np.frombuffer(b"".join(digests), np.dtype([("high", "<i8"), ("low", "<i4")]))
        yield pa.RecordBatch.from_pydict({
            "high": pa.array(np.ascontiguousarray(packed["high"])), "low": pa.array(np.ascontiguousarray(packed["low"])),
            "doc_id": pa.array(ids, pa.int64()), "text_key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int32()), "stop": pa.array(stops, pa.int32())})


@F.pandas_udf(StringType())
def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, removed, strict=True):
        if text is None:
            out.append(None)
            continue
        parts, at = [], 0
        for span in spans:
            parts.append(text[at:span["start"]])
            at = span["stop"]
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).where(
        "doc_id is not null and text is not null")


def repeats(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, text_key, start, stop and first_doc of every unit that is cut out.

    Units are taken from the texts once and written as digests and places. Digests are counted with a
    combination before the shuffle; only units whose digest occurs more than once are looked at again, and Spark
    splits the partitions of very common ones.
    """
    rows = work.table(_keyed(docs).mapInArrow(_unit_rows, UNITS), "units")
    known = rows.groupBy("high", "low").agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = work.table(rows.join(known, ["high", "low"]), "repeated")
    work.drop(rows)
    place = F.struct("text_key", "start")
    own = found.where("doc_id = first_doc")
    first = own.groupBy("high", "low").agg(F.min(place).alias("first_place"))
    again = own.join(first, ["high", "low"]).where(place > F.col("first_place"))
    columns = ("doc_id", "text_key", "start", "stop", "first_doc")
    return found.where("doc_id > first_doc").select(*columns).union(again.select(*columns)).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with repeated units cut out of `text`.

    Adds `removed` (start, stop and first_doc of what was cut out), `kept_spans` (start and stop of
    what is left), both in characters of the original text, and `n_removed`; sets n_chars if there is
    such a column.
    """
    span = F.struct("start", "stop", "first_doc")
    with Workspace(docs.sparkSession) as work:
        cut = work.result(repeats(docs, work).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("removed")))
    cut = cut.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_text")
    base = docs.drop(*ADDED)
    same = (base["doc_id"].cast("long") == cut["_doc"]) & (F.xxhash64(base["text"].cast("string")) == cut["_text"])
    joined = base.join(cut, same, "left").drop(cut["_doc"], cut["_text"])
    hit = F.col("removed").isNotNull()
    old = F.length("text")
    ends = F.concat(F.transform("removed", lambda r: r["start"]), F.array(old))
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["stop"]))
    kept = F.filter(F.transform(F.arrays_zip(begins.alias("start"), ends.alias("stop")),
                                lambda z: F.struct(z["start"].alias("start"), z["stop"].alias("stop"))),
                    lambda z: z["stop"] > z["start"])
    whole = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.coalesce(old, F.lit(0)).alias("stop"))),
                     lambda z: z["stop"] > 0)
    out = joined.withColumn("kept_spans", F.when(hit, kept).otherwise(whole)).withColumn(
        "n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long")).withColumn(
        "text", F.coalesce(_without(F.when(hit, F.col("text")), "removed"), "text")).withColumn(
        "removed", F.coalesce("removed", F.array().cast(joined.schema["removed"].dataType)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*base.columns, *ADDED)
