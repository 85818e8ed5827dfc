"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic with their tokens. Raking scales the
tokens of the cells until the totals of each source, each language and each topic meet their
targets. A cell's factor, divided by the largest one, is the probability with which its documents
are kept; whether a document is kept depends on its id alone, so a repeated run keeps the same ones.

Targets are rows (margin, value, weight): the share of all tokens that a value of a margin is to have.
Values without a row divide what the given shares leave, in proportion to their own shares to the power
`temper`; given shares of more than 1 in all are scaled to 1, and those of values that do not occur go to
the others in proportion. Several rows of one value count with their sum, a row of weight 0 asks for none
of a value, a null or negative weight counts as 0, and a null value means the documents without one.

Null source, language and topic are values of their own. Null or empty text has no tokens; if a cell
has none at all its factor is that of a cell which is left as it is. Repeated rows are kept or dropped
together, an empty table gives an empty table, and columns named like those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.params import MIX_BROADCAST_CELLS, MIX_GAP, MIX_SWEEPS, MIX_TARGETS, MIX_TEMPER

MARGINS = ("source", "lang", "topic")
ADDED = ("topic", "n_tokens", "probability", "kept")


def topic() -> Column:
    """The form of a text, as its topic: tables, lists of short lines, and prose by length."""
    words, lines = F.col("n_tokens"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return (F.when(5 * bars > words, "table").when(12 * lines > words, "list")
            .when(words < 150, "note").when(words < 600, "article").otherwise("essay"))


def n_tokens() -> Column:
    """Words separated by 0x20 and 0x09-0x0D."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def given_targets(docs: DataFrame, shares: dict = MIX_TARGETS) -> DataFrame:
    """The target table (margin, value, weight) of nested dictionaries."""
    rows = [(m, value, float(weight)) for m, values in shares.items() for value, weight in values.items()]
    return docs.sparkSession.createDataFrame(rows, "margin string, value string, weight double")


def margin_targets(cells: DataFrame, targets: DataFrame, margin: str, temper: float = MIX_TEMPER) -> DataFrame:
    """(value, target): the tokens that each value of `margin` with tokens is to have."""
    given = targets.where(F.col("margin") == margin).groupBy("value").agg(
        F.sum(F.greatest("weight", F.lit(0.0))).alias("given")).select(F.col("value").alias("_value"), F.coalesce("given", F.lit(0.0)).alias("given"))
    own = cells.groupBy(F.col(margin).cast("string").alias("value")).agg(F.sum("tokens").cast("double").alias("own")).where("own > 0")
    own = own.join(given, own["value"].eqNullSafe(given["_value"]), "left").drop("_value")
    tempered = F.pow("own", F.lit(float(temper)))
    whole = own.agg(F.sum("own").alias("total"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("listed"),
                    F.coalesce(F.sum(F.when(F.col("given").isNull(), tempered)), F.lit(0.0)).alias("open"))
    left = F.greatest(F.lit(0.0), 1 - F.col("listed"))
    share = F.coalesce("given", left * tempered / F.col("open"))
    wanted = F.col("listed") + F.when(F.col("open") > 0, left).otherwise(0.0)
    return own.crossJoin(F.broadcast(whole)).select(
        "value", F.when(wanted > 0, F.col("total") * share / wanted).alias("target"))


def rake(cells: DataFrame, targets: DataFrame | None = None, sweeps: int = MIX_SWEEPS, temper: float = MIX_TEMPER,
         gap: float = MIX_GAP) -> DataFrame:
    """`cells` with `factor`, the fitted weight over the tokens, and `gap`, by how much the last sweep still
    changed the total of any value, relative to it.

    Sweeps end when that is at most `gap`, or after `sweeps` of them. The cells are the combinations met, so the
    windows over the cells of one value stay small whatever the number of documents.
    """
    targets = given_targets(cells, {}) if targets is None else targets
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        want = margin_targets(cells, targets, m, temper).withColumnRenamed("target", f"target_{m}")
        fitted = fitted.join(want, fitted[m].cast("string").eqNullSafe(want["value"]), "left").drop("value")
    fitted, reached = fitted.checkpoint(), 0.0
    for _ in range(sweeps):
        fitted = fitted.withColumn("gap", F.lit(0.0))
        for m in MARGINS:
            now = F.sum("weight").over(Window.partitionBy(m))
            fitted = (fitted.withColumn("scale", F.when((now > 0) & F.col(f"target_{m}").isNotNull(), F.col(f"target_{m}") / now).otherwise(1.0))
                      .withColumn("weight", F.col("weight") * F.col("scale"))
                      .withColumn("gap", F.greatest("gap", F.abs(F.col("scale") - 1))).drop("scale"))
        fitted = fitted.checkpoint()
        reached = fitted.agg(F.max("gap")).first()[0] or 0.0
        if reached <= gap:
            break
    return fitted.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("factor"),
                         F.lit(float(reached)).alias("gap"))


def draw() -> Column:
    """A number from 0 to 1 that depends on doc_id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast(
        "double") / float(1 << 52)


def mixed(docs: DataFrame, targets: DataFrame | None = None, sweeps: int = MIX_SWEEPS, temper: float = MIX_TEMPER,
          by: Column | None = None) -> DataFrame:
    """Every document with its topic, tokens, probability and whether it is kept.

    `targets` are the wanted shares, those of the parameters if None. `by` is the topic, such as the column of a
    classifier, in place of the form of the text. The text is read twice and never shuffled: once for the cells,
    which are summed before the shuffle, and once with the cells joined to it. The cells are broadcast if their
    counted number is within the bound; beyond it a join on the margins, whose hot values Spark splits.
    """
    targets = given_targets(docs) if targets is None else targets
    if by is not None:
        docs = docs.withColumn("_topic", by.cast("string"))
    base = docs.drop(*ADDED).withColumn("n_tokens", n_tokens()).withColumn("topic", topic() if by is None else F.col("_topic"))
    base = base if by is None else base.drop("_topic")
    cells = base.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).checkpoint()
    fitted = rake(cells, targets, sweeps, temper)
    top = fitted.agg(F.max("factor").alias("top"))
    cells = fitted.crossJoin(F.broadcast(top)).select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS],
        F.round(F.least(F.lit(1.0), F.col("factor") / F.col("top")), 9).alias("probability")).checkpoint()
    side = F.broadcast(cells) if cells.count() <= MIX_BROADCAST_CELLS else cells
    same = [base[m].eqNullSafe(side[f"_{m}"]) for m in MARGINS]
    return base.join(side, same[0] & same[1] & same[2]).drop(*[f"_{m}" for m in MARGINS]).withColumn(
        "kept", draw() < F.col("probability"))


def sql(shares: dict = MIX_TARGETS, sweeps: int = MIX_SWEEPS, temper: float = MIX_TEMPER) -> str:
    """The same rows in DuckDB SQL."""
    steps = ["""base AS (SELECT doc_id, source, lang, CAST(CASE WHEN trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) = '' THEN 0
          ELSE len(regexp_split_to_array(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\\x20\\x09-\\x0D]+')) END AS BIGINT) AS n_tokens,
          length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, length(text) - length(replace(text, '|', '')) AS bars FROM documents)""",
             """topics AS (SELECT *, CASE WHEN 5 * bars > n_tokens THEN 'table' WHEN 12 * n_lines > n_tokens THEN 'list'
          WHEN n_tokens < 150 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'essay' END AS topic FROM base)""",
             "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM topics GROUP BY ALL)"]
    for m in MARGINS:
        listed = ", ".join(f"('{value}', {float(weight)})" for value, weight in shares.get(m, {}).items()) or "(NULL, NULL)"
        steps.append(f"""given_{m} AS (SELECT {m}, t, weight AS g, power(t, {temper}) AS tempered FROM (SELECT {m}, sum(tokens) AS t FROM cells GROUP BY {m})
          LEFT JOIN (VALUES {listed}) v(value, weight) ON value = {m} WHERE t > 0)""")
        steps.append(f"""want_{m} AS MATERIALIZED (SELECT {m}, coalesce(g, greatest(0, 1 - coalesce(sum(g) OVER (), 0)) * tempered / sum(tempered) FILTER (WHERE g IS NULL) OVER ()) AS p,
          sum(t) OVER () AS total FROM given_{m})""")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM cells)")
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN sum(c.weight) OVER (PARTITION BY c.{m}) > 0
              THEN c.weight * (t.p / (SELECT sum(p) FROM want_{m}) * t.total) / sum(c.weight) OVER (PARTITION BY c.{m}) ELSE c.weight END AS weight)
              FROM w{k} c LEFT JOIN want_{m} t ON c.{m} IS NOT DISTINCT FROM t.{m})""")
            k += 1
    return f"""WITH {', '.join(steps)}, f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS factor FROM w{k}),
      p AS (SELECT source, lang, topic, round(least(1.0, factor / max(factor) OVER ()), 9) AS probability FROM f)
      SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.probability, 6) AS probability,
        CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < p.probability AS kept
      FROM topics d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic"""
