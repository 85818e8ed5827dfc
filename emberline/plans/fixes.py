"""Fix candidates, matches and their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import params
from emberline.functions.links import detail_line, table_link
from emberline.operators import correlate
from emberline.plans import inputs
from emberline.sources import adapter, readers


def commit_candidates(spark, sf):
    return inputs.commit_candidates(spark, sf)


def pr_candidates(spark, sf):
    return inputs.pull_requests(spark, sf)


def search_tokens(spark, sf):
    return inputs.search_terms(spark, sf)


def _commit_matches(spark, sf):
    found = correlate.commit_candidates(inputs.commit_candidates(spark, sf), params.GIT_BASE, params.REPOSITORY)
    return inputs.matches(spark, sf, found)


def match_commits(spark, sf):
    return _commit_matches(spark, sf).drop("type", "url")


def match_prs(spark, sf):
    found = correlate.pull_request_candidates(inputs.pull_requests(spark, sf))
    return inputs.matches(spark, sf, found).drop("type", "url")


def fix_confidence(spark, sf):
    return inputs.fix_items(spark, sf)


def fix_file_kind(spark, sf):
    return correlate.fix_file_kinds(
        correlate.fix_items(_commit_matches(spark, sf)), adapter.candidate_files(spark, sf))


def sorted_fixes(spark, sf):
    return correlate.sorted_items(inputs.fix_items(spark, sf)).select("category", "type", "ref", "confidence", "position")


def fix_detail_order(spark, sf):
    return correlate.detail_order(inputs.fix_items(spark, sf)).select("category", "type", "ref", "confidence", "position")


def fix_links(spark, sf):
    items = inputs.fix_items(spark, sf)
    c = {n: F.col(n) for n in items.columns}
    return items.select(
        "category", table_link(c["type"], c["id"], c["sha"], c["url"], c["confidence"]).alias("link"),
        detail_line(c["type"], c["id"], c["sha"], c["url"], c["date"], c["title"]).alias("line"))


def fix_counts(spark, sf):
    return correlate.item_counts(inputs.fix_items(spark, sf)).agg(
        F.count("*").alias("categories"), F.coalesce(F.sum("fixes"), F.lit(0)).alias("items"))


def _fix_documents(spark, sf):
    """One small fixes document per part, some broken, with empty and repeated entries."""
    key = F.col("partkey")

    def entry(category, items):
        return F.struct(category.alias("category"), items.alias("items"))

    item = F.struct(
        F.when(key % 2 == 0, "pr").otherwise("commit").alias("type"),
        F.when(key % 2 == 0, key).alias("id"), F.when(key % 2 == 1, F.md5(key.cast("string"))).alias("sha"),
        F.concat(F.lit("https://git.example.com/x/"), key.cast("string")).alias("url"),
        F.col("p_name").alias("title"), F.lit("2001-06-01T00:00:00Z").alias("date"), F.lit("match").alias("confidence"))
    named = F.concat(F.lit("bug/"), F.col("brand_slug"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))
    document = F.to_json(F.struct(F.array(
        entry(named, F.array(item)), entry(F.lit(""), F.array(item)),
        entry(named, F.slice(F.array(item), 1, 0)), entry(F.lit("bug/last"), F.array(item, item))).alias("fixes")))
    broken = F.when(key % 10 == 9, F.substring(document, 1, 40)).otherwise(document)
    return adapter.parts(spark, sf).select(key.alias("doc"), broken.alias("text"))


def load_fixes(spark, sf):
    parsed = _fix_documents(spark, sf).select(
        "doc", F.from_json("text", readers.FIX_SCHEMA)["fixes"].alias("fixes"))
    fixes = readers.fixes_from_documents(parsed, order="doc")
    return fixes.select("category", F.inline("items")).select("category", "type", "id", "sha", "url", "title")


QUERIES = {
    "commit_candidates": commit_candidates, "pr_candidates": pr_candidates, "search_tokens": search_tokens,
    "match_commits": match_commits, "match_prs": match_prs, "fix_confidence": fix_confidence,
    "fix_file_kind": fix_file_kind, "sorted_fixes": sorted_fixes, "fix_detail_order": fix_detail_order,
    "fix_links": fix_links, "fix_counts": fix_counts, "load_fixes": load_fixes,
}
