import numpy as np
from brute import held_out

from emberline.llm import gam, toxicity
from emberline.llm.features import NAMES, form

SF = "/root/testdata/sf0.1"


def labelled(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    return [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_of_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = gam.scored(docs, gam.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows[:500])
    found = labelled(rows, labels, "quality")
    assert np.mean([a == b for a, b, _ in found]) > 0.98


def test_toxicity_of_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    found = labelled(rows, labels, "toxic")
    assert np.mean([p for t, p, _ in found if t == 1]) > 0.85
    assert np.mean([p for t, p, _ in found if t == 0]) < 0.02


def test_interactions_are_learnt():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    score = gam.Model(x, y)(x)
    assert ((score > 0.5) == y).mean() > 0.95


def test_labels_out_of_the_fold_do_not_teach(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "%%% !!! ###") for i in range(200)], "doc_id LONG, text STRING")
    swapped = spark.createDataFrame([(i, int(i % 2 == 0), 1) if held_out(i) else (i, i % 2, int(i % 2 == 0)) for i in range(200)],
                                    "doc_id LONG, quality INT, toxic INT")
    rows = gam.scored(docs, gam.fit(docs, swapped)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (5, 1, None), (77, None, 1)], "doc_id LONG, quality INT, toxic INT")
    for part in (gam, toxicity):
        model = part.fit(odd_docs, labels)
        rows = part.scored(odd_docs, model).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert part.scored(no_docs, model).count() == 0
        assert part.scored(odd_docs, part.fit(no_docs, labels.where("false"))).count() == 11


def test_form_of_odd_texts():
    rows = form([b"", b" ", "É a1 B!".encode(), b"x y z x y z\nx y z x y z"])
    assert rows.shape == (4, len(NAMES)) and np.isfinite(rows).all() and (rows[0, :3] == 0).all()
    at = {n: i for i, n in enumerate(NAMES)}
    assert rows[2, at["word_chars"]] == 5 / 3 and rows[3, at["repeated_lines"]] == 0.5
