"""Matching root causes with commits and open pull requests that may fix them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.dates import utc_epoch
from emberline.functions.links import commit_url
from emberline.functions.text import mask_digits, words
from emberline.operators.ordering import with_position

# Words that hint at a fix, and the weight of each kind of search term.
ACTION_WORDS = ["fix", "flake", "flaky", "deflake", "retry", "timeout"]
WEIGHTS = {"test_id": 4, "slug": 3, "component": 3, "error": 2, "action": 1}
# Words too general to point at a component.
STOP_WORDS = ["error", "failed", "after", "with", "from", "this", "that", "test", "tests", "systemic"]
MIN_WORD = 4
WEAK_NEEDED = 2


def _content_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: (F.length(w) >= MIN_WORD) & w.rlike("^[a-z]+$") & ~w.isin(STOP_WORDS))


def search_terms(categories: DataFrame, test_ids: DataFrame) -> DataFrame:
    """(category, kind, token): test ids, the whole root-cause slug, its words and the
    words of the example error. One row per term; a word counts once, as the best kind."""
    slug = F.lower(F.element_at(F.split("category", "/"), 2))
    ids = test_ids.select("category", F.lit("test_id").alias("kind"), F.lower("test_id").alias("token"))
    per_category = categories.select("category", slug.alias("slug"), "example_error")
    slugs = per_category.select("category", F.lit("slug").alias("kind"), F.col("slug").alias("token"))
    parts = per_category.select("category", F.lit("component").alias("kind"),
                                F.explode(_content_words(F.col("slug"))).alias("token"))
    errors = per_category.select("category", F.lit("error").alias("kind"),
                                 F.explode(_content_words(mask_digits(F.col("example_error")))).alias("token"))
    return (ids.unionByName(slugs).unionByName(parts).unionByName(errors)
            .withColumn("weight", _weight(F.col("kind")))
            .groupBy("category", "token")
            .agg(F.max(F.struct("weight", "kind")).alias("best"))
            .select("category", "token", "best.kind", "best.weight"))


def _weight(kind: Column) -> Column:
    value = F.lit(0)
    for name, weight in WEIGHTS.items():
        value = F.when(kind == name, weight).otherwise(value)
    return value


def _is_strong():
    return F.col("kind").isin("test_id", "slug")


CANDIDATE = ("type", "ref", "date", "title", "url")


def commit_candidates(commits: DataFrame, base: str, repository: str) -> DataFrame:
    return commits.select(
        F.lit("commit").alias("type"), F.col("sha").alias("ref"), F.col("author_date").alias("date"),
        F.col("subject").alias("title"), commit_url(base, repository, F.col("sha")).alias("url"))


def pull_request_candidates(pull_requests: DataFrame) -> DataFrame:
    return pull_requests.select(
        F.lit("pr").alias("type"), F.col("number").cast("string").alias("ref"), F.col("created").alias("date"),
        "title", "url")


def match(terms: DataFrame, first_seen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate fixes per category.

    A test id or the whole slug in the title is a match. Otherwise two weak words are
    needed, and a pair with two common words also has one besides the category's most
    common word: that word is left out as a join key and counted only when a pair is
    checked. A commit dated before the category's first failure cannot be its fix; an open
    pull request can.
    """
    titles = candidates.select(*CANDIDATE, words(F.col("title")).alias("words"))
    postings = titles.select("type", "ref", "date", F.explode("words").alias("token"))
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"))
    weak = terms.where(~_is_strong())
    common = (weak.join(frequency, "token").groupBy("category")
              .agg(F.max(F.struct("df", "token")).alias("top"))
              .select("category", F.col("top.token").alias("token")))
    keys = (terms.where(_is_strong()).select("category", "token", "kind", "weight")
            .unionByName(weak.join(common, ["category", "token"], "left_anti")
                         .select("category", "token", "kind", "weight"))
            .join(first_seen.select("category", "first_started_at"), "category"))
    pairs = (keys.join(postings, "token")
             .where((F.col("type") == "pr") | (F.col("date") >= F.col("first_started_at")))
             .groupBy("category", "type", "ref")
             .agg(F.max(F.when(_is_strong(), F.col("weight"))).alias("strong")))
    # The weak words of one category: as many as its slug and example error have.
    weak_words = weak.groupBy("category").agg(
        F.collect_set("token").alias("weak_words"),
        F.collect_set(F.when(F.col("kind") == "component", F.col("token"))).alias("components"))
    checked = (pairs.join(titles, ["type", "ref"]).join(weak_words, "category", "left")
               .withColumn("weak_hits", F.coalesce(F.size(F.array_intersect("words", "weak_words")), F.lit(0))
                           .cast("bigint")))
    named = F.coalesce(F.arrays_overlap("words", "components"), F.lit(False))
    weak_weight = F.when(named, WEIGHTS["component"]).otherwise(WEIGHTS["error"])
    action = F.arrays_overlap("words", F.array(*[F.lit(w) for w in ACTION_WORDS]))
    return (checked.where(F.col("strong").isNotNull() | (F.col("weak_hits") >= WEAK_NEEDED))
            .select("category", *CANDIDATE,
                    F.when(F.col("strong").isNotNull(), "match").otherwise("possible").alias("confidence"),
                    "weak_hits",
                    (F.coalesce("strong", weak_weight) + F.when(action, WEIGHTS["action"]).otherwise(0))
                    .cast("bigint").alias("weight")))


def fix_items(matches: DataFrame) -> DataFrame:
    """Matches in the shape of the fixes file: pull requests have an id, commits a sha."""
    return matches.select(
        "category", "type", F.when(F.col("type") == "pr", F.col("ref")).cast("bigint").alias("id"),
        F.when(F.col("type") == "commit", F.col("ref")).alias("sha"), "url", "title", "date", "confidence")


def _sort_keys(items: DataFrame) -> DataFrame:
    epoch = utc_epoch(F.col("date"))
    return (items.withColumn("confidence_rank", F.when(F.col("confidence") == "match", 0).otherwise(1))
            .withColumn("undated", F.when(epoch == 0, 1).otherwise(0))
            .withColumn("epoch", epoch)
            .withColumn("ref", F.coalesce("sha", F.col("id").cast("string"))))


def sorted_items(items: DataFrame) -> DataFrame:
    """Report order within a category: matches first, dated first, newest first."""
    order = [F.col("confidence_rank"), F.col("undated"), F.desc("epoch"), F.col("type"), F.col("ref")]
    return with_position(_sort_keys(items), order, "position", ["category"])


def detail_order(items: DataFrame) -> DataFrame:
    """Detail order: matches, then possible fixes; commits before pull requests in each."""
    keyed = _sort_keys(items).withColumn("type_rank", F.when(F.col("type") == "commit", 0).otherwise(1))
    order = [F.col("confidence_rank"), F.col("type_rank"), F.col("undated"), F.desc("epoch"), F.col("ref")]
    return with_position(keyed, order, "position", ["category"])


def file_kind(path: Column) -> Column:
    return (F.when(path.rlike(r"(^|/)(\.github|\.ci|deploy)/|Dockerfile|\.ya?ml$"), "ci")
            .when(path.rlike(r"(^|/)tests?/|\.test\.|\.spec\.|_test\.|(^|/)test_"), "test")
            .otherwise("production"))


def fix_file_kinds(items: DataFrame, files: DataFrame) -> DataFrame:
    """Commit candidates whose changed files suit the failure type."""
    kinds = (files.groupBy("sha").agg(*[
        F.bool_or(file_kind(F.col("filename")) == k).alias(f"touches_{k}")
        for k in ("test", "production", "ci")]))
    failure = F.substring_index("category", "/", 1)
    expected = (F.when(failure == "test-flake", F.col("touches_test"))
                .when(failure == "bug", F.col("touches_production"))
                .when(failure == "infra-flake", F.col("touches_ci")).otherwise(F.lit(False)))
    return items.where(F.col("type") == "commit").join(kinds, "sha").select(
        "category", "sha", "confidence", "touches_test", "touches_production", "touches_ci",
        expected.alias("suits_type"))


def item_counts(items: DataFrame) -> DataFrame:
    """Per category number of fixes, by confidence."""
    return items.groupBy("category").agg(
        F.count("*").alias("fixes"), F.count_if(F.col("confidence") == "match").alias("matches"),
        F.count_if(F.col("confidence") == "possible").alias("possible"))


def with_items(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Each category with its fixes in report order as `fixes`; an empty array where it has none."""
    listed = sorted_items(items).groupBy("category").agg(F.array_sort(F.collect_list(F.struct(
        "position", "type", "id", "sha", "url", "title", "date", "confidence"))).alias("fixes"))
    kind = listed.schema["fixes"].dataType
    return categories.join(listed, "category", "left").withColumn("fixes", F.coalesce("fixes", F.array().cast(kind)))
