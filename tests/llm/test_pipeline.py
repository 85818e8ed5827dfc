from brute import near_duplicates
from test_encoding import digests

import corpus_pipeline
from emberline.llm import lines, mixing, queries, rules

SF = "/root/testdata/sf0.001"


def plain(spark, docs):
    """The stages over all rows in memory, near-duplicates by all pairs and units in one pass."""
    kept = [r for r in rules.judge(docs, order=list(rules.RULES)).collect() if r.kept]
    group = near_duplicates([(r.doc_id, r.text) for r in kept])
    kept = sorted((r for r in kept if group[r.doc_id][1] == r.doc_id), key=lambda r: r.doc_id)
    seen, rows = set(), []
    for r in kept:
        parts, at = [], 0
        for start, stop, words in lines.units(r.text):
            unit = " ".join(words).lower()
            if unit in seen:
                parts.append(r.text[at:start])
                at = stop
            seen.add(unit)
        rows.append((r.doc_id, "".join([*parts, r.text[at:]]), r.lang, r.source))
    left = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")
    return {r.doc_id: digests(r.text) for r in mixing.mixed(left).collect() if r.kept}


def test_pipeline_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.pipeline(spark, SF).collect()}
    assert got == plain(spark, docs) and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_and_odd_rows(spark, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "substring_dedup", "mixing_weights", "bpe_encoding"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            made = stage(spark, docs, SF)
            made.count()
            assert name == "bpe_encoding" or made.columns == docs.columns
    kept = corpus_pipeline.near_dedup(spark, odd_docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 5, 7, 8, 9]
