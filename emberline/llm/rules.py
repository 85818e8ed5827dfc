"""Quality rules as a short-circuit cascade in the order of rejection per cost.

Every rule is a SQL condition on columns of the text, so the cascade is one CASE expression that
Spark evaluates without Python. A sample tells what each rule costs and what it rejects; the rule
with the most rejections per second comes first. The order changes the time, never the verdict.

Null text counts as text without words: all counts 0, base_failed, not kept. Repeated rows are judged
each for itself, other columns are passed on untouched, an empty table gives an empty table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.params import RULE_SAMPLE_ROWS

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule by the condition under which it rejects; `needs` are counts that it divides by n_words."""

    name: str
    rejects: str


#: Thresholds of the production cascade. `n_words` is over 0 where they are evaluated.
RULES = (
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 7 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("repeated_words", "10 * n_repeat_words > 4 * n_words"),
    Rule("capitals", "10 * length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) < 7 * length(text)"),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > 5 * n_words"),
    Rule("few_letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < length(text)"),
)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once for the row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _shifted(values: Column, by: int) -> Column:
    """The array from its element `by` on; arrays_zip fills the end with nulls."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that the text holds at least twice.

    The hashes of the windows are sorted with their positions, so that equal windows are neighbours;
    windows of a text that agree in a 64-bit hash count as equal.
    """
    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(F.arrays_zip(w.alias("a"), _shifted(w, 1).alias("b"), _shifted(w, 2).alias("c")), 1,
                    F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("at")))

    def repeated(s: Column) -> Column:
        # (window, the one before, the one after)
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,at:int>")), s)
        return F.transform(
            F.filter(F.arrays_zip(s.alias("x"), F.slice(before, 1, F.size(s)).alias("p"), _shifted(s, 1).alias("n")),
                     lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False))
                     | F.coalesce(z["x"]["h"] == z["n"]["h"], F.lit(False))),
            lambda z: z["x"]["at"])

    def covered(at: Column) -> Column:
        return F.aggregate(F.arrays_zip(at.alias("x"), _shifted(at, 1).alias("n")), F.lit(0).cast("long"),
                           lambda total, z: total + F.coalesce(F.least(z["n"] - z["x"], F.lit(3)), F.lit(3)))

    found = _let(F.sort_array(windows(words)), repeated)
    return _let(F.sort_array(found), covered)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The counts of each text; Spark keeps no text or word array beyond the row."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    counted = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w).alias("n_repeat_words")))
    line_counts = _let(lines, lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(x).cast("long").alias("n_lines")))
    return df.withColumn("_words", counted).withColumn("_lines", line_counts).select(
        *[df[c] for c in df.columns],
        F.col("_words.n_words").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_lines.n_dup_lines").alias("n_dup_lines"),
        F.col("_words.n_repeat_words").alias("n_repeat_words"),
        F.col("_lines.n_lines").alias("n_lines"))


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = RULE_SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on about `rows` sampled rows.

    Each rule is run over the sample together with the counts it may need, so its cost includes the
    counts that Spark would not compute without it.
    """
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select("text").sample(min(1.0, rows / total), seed=11).checkpoint()
    counted = with_counts(sample).where(~base_failed())
    worth = []
    for rule in rules:
        started = time.perf_counter()
        rejected = counted.where(F.expr(rule.rejects)).count()
        worth.append((rejected / max(time.perf_counter() - started, 1e-6), rule))
    return [rule for _, rule in sorted(worth, key=lambda x: (-x[0], x[1].name))]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """The documents with their counts, `base_failed`, `failed_rule` (the first that rejects) and `kept`."""
    verdict = F.when(base_failed(), "base")
    for rule in order if order is not None else rule_order(docs, rules):
        verdict = verdict.when(F.expr(rule.rejects), rule.name)
    names = {"base_failed", "failed_rule", "kept", "n_lines", *COUNTS}
    counted = with_counts(docs.drop(*[c for c in docs.columns if c in names]))
    return counted.withColumn("base_failed", base_failed()).withColumn("failed_rule", verdict).withColumn(
        "kept", F.col("failed_rule").isNull())
