import duckdb
from brute import counts
from pyspark.sql import functions as F

from emberline.llm import mixing, queries, rules

SF = "/root/testdata/sf0.001"


def judged(df):
    return rules.judge(df, order=list(rules.RULES)).collect()


def test_counts_equal_a_plain_count(spark, odd_docs):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        for r in judged(frame):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.doc_id


def test_any_order_of_the_rules_gives_the_same_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [{r.doc_id for r in rules.judge(docs, order=order).where("kept").collect()}
            for order in (list(rules.RULES), list(reversed(rules.RULES)), rules.rule_order(docs))]
    assert kept[0] == kept[1] == kept[2] and 0 < len(kept[0]) < docs.count()


def test_odd_rows(odd_docs, no_docs):
    rows = judged(odd_docs)
    assert len(rows) == 11 and [r.doc_id for r in rows if r.doc_id == 5] == [5, 5]
    assert all(r.base_failed and not r.kept for r in rows if r.text is None or not r.text.strip())
    assert rules.judge(no_docs).count() == 0


def test_quality_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = rules.judge(docs, order=list(rules.RULES)).where("not base_failed").join(labels, "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (rules.judge(docs, order=list(rules.RULES)), mixing.mixed(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian"))


def _cells(docs):
    base = docs.withColumn("n_tokens", mixing.n_tokens()).withColumn("topic", mixing.topic())
    return base.groupBy(*mixing.MARGINS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")


def test_mixing_meets_the_targets(spark):
    cells = _cells(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).checkpoint()
    shares = {"source": {"src0": 0.2, "src1": 0.0}, "lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    for given in ({}, shares):
        fitted = mixing.rake(cells, mixing.given_targets(cells, given), temper=0.5).toPandas()
        fitted["weight"] = fitted.factor * fitted.tokens
        total = fitted.tokens.sum()
        assert fitted.gap.max() <= 1e-9
        for m in mixing.MARGINS:
            listed = given.get(m, {})
            share = fitted.groupby(m).tokens.sum() / total
            other = share[[v not in listed for v in share.index]] ** 0.5
            wanted = other / other.sum() * (1 - sum(listed.values()))
            got = fitted.groupby(m).weight.sum() / total
            for value in share.index:
                assert abs(got[value] - listed.get(value, wanted.get(value))) < 1e-9, (m, value)


def test_kept_tokens_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = mixing.mixed(docs).where("kept").groupBy("lang").sum("n_tokens").toPandas().set_index("lang")["sum(n_tokens)"]
    for lang, share in mixing.MIX_TARGETS["lang"].items():
        assert abs(kept[lang] / kept.sum() - share) < 0.02


def test_odd_targets(spark):
    cells = spark.createDataFrame([("a", "x", None, 10), ("b", "x", None, 30), (None, "x", "t", 60), ("c", None, "t", 0)],
                                  "source string, lang string, topic string, tokens long")

    def sums(rows):
        table = spark.createDataFrame(rows, "margin string, value string, weight double")
        fitted = mixing.rake(cells, table, temper=1.0).collect()
        return {r.source: round(r.factor * r.tokens, 6) for r in fitted}

    source = lambda *rows: [("source", v, w) for v, w in rows]
    free = [("topic", None, None)]
    assert sums([]) == {"a": 10, "b": 30, None: 60, "c": 0}
    assert sums(source((None, 0.6), ("a", 0.05), ("a", 0.05))) == {"a": 10, "b": 30, None: 60, "c": 0}
    # more than 1 in all is scaled, and shares of values that don't occur go to the others
    assert sums(source((None, 1.2), ("a", 0.2), ("b", 0.6))) == {"a": 10, "b": 30, None: 60, "c": 0}
    assert sums(source((None, 0.3), ("a", 0.05), ("b", 0.15), ("z", 0.5))) == {"a": 10, "b": 30, None: 60, "c": 0}
    # the topic without a name is wanted no more: its sources go to 0
    assert sums(free) == {"a": 0, "b": 0, None: 100, "c": 0}


def test_topic_of_a_column(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("form", F.col("doc_id") % 3)
    rows = mixing.mixed(docs, by=F.col("form")).collect()
    assert all(r.topic == str(r.doc_id % 3) for r in rows) and len(rows) == docs.count()


def test_mixing_odd_rows(odd_docs, no_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == 11 and all(0 <= r.probability <= 1 for r in rows)
    assert len({r.kept for r in rows if r.doc_id == 5}) == 1
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mixed(no_docs).count() == 0


def test_mixing_beyond_the_broadcast_bound_is_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = {r.doc_id: r.kept for r in mixing.mixed(docs).collect()}
    monkeypatch.setattr(mixing, "MIX_BROADCAST_CELLS", 0)
    assert {r.doc_id: r.kept for r in mixing.mixed(docs).collect()} == some


def test_oracles_are_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert len(duck.execute(queries.ORACLES["op7_quality_cascade"]).fetchall()) == 200
