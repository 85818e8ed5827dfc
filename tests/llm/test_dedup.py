import numpy as np
import pyarrow as pa
import pytest
from brute import cosine_links, groups, near_duplicates
from pyspark.sql import functions as F

from emberline.llm import lines, minhash, multi_index
from emberline.llm.components import components

SF = "/root/testdata/sf0.001"


def changed(base, k, draw):
    out = list(base)
    for i in draw.choice(len(base), k, replace=False):
        out[i] = f"other{draw.integers(10**6)}"
    return " ".join(out)


@pytest.fixture
def copies():
    """Groups of near copies whose similarities lie on both sides of the threshold."""
    draw = np.random.default_rng(3)
    docs, n = [], 0
    for size in (2, 3, 12, 60):
        base = [f"w{draw.integers(10**6)}" for _ in range(150)]
        for _ in range(size):
            docs.append((n, changed(base, int(draw.integers(0, 7)), draw)))
            n += 1
    docs += [(n + i, docs[-1 - i][1].upper().replace(" ", "\n\t")) for i in range(5)]
    return docs + [(900, "a b"), (901, "A  b"), (902, "a b c"), (903, None), (904, ""), (905, "  ")]


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}


def test_near_duplicates_equal_all_pairs(spark, copies):
    expected = near_duplicates(copies)
    df = spark.createDataFrame(copies, "doc_id LONG, text STRING")
    assert found(df) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in minhash.near_duplicates(df).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == near_duplicates([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("percent", [5, 30])
def test_low_thresholds_lose_no_link(spark, percent):
    draw = np.random.default_rng(percent)
    base = [f"w{i}" for i in range(80)]
    docs = [(n, changed(base[:60], 6 if percent == 30 else 14, draw)) for n in range(12)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id LONG, text STRING"), percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_duplicates(docs, percent)


@pytest.mark.parametrize("percent", [1, 30, 50, 85, 95, 99])
def test_bands_miss_a_pair_at_the_threshold_no_oftener_than_asked(percent):
    bands, rows = minhash.banding(percent, 1e-9)
    assert (1 - (percent / 100) ** rows) ** bands <= 1e-9


def test_rows_of_one_id_with_different_texts_keep_their_links(spark):
    words = [f"w{i}" for i in range(100)]
    near, other = " ".join([*words[:-1], "x"]), " ".join(f"o{i}" for i in range(100))
    docs = [(5, " ".join(words)), (5, other), (9, near), (7, other + " y")]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").coalesce(1)
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (7, 5), (9, 5)]


def test_links_of_components_that_also_share_a_seeming_pair(spark, monkeypatch):
    """A pair of two components that survives by its signatures only hides none of their other pairs."""
    def in_one_bucket(bands, rows):
        def run(batches):
            for batch in batches:
                ids = batch.column("id").to_numpy()
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids), "key": pa.array(ids // 100), "band": pa.array(np.zeros(len(ids), np.int32))})
        return run

    monkeypatch.setattr(minhash, "_bands", in_one_bucket)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    draw, docs = np.random.default_rng(7), []
    for c in range(20):
        ids, said = draw.permutation(30) + 100 * c, [f"c{c}w{i}" for i in range(400)]
        docs += [(int(ids[k]), " ".join(said[8 * k:8 * k + 104])) for k in range(30)]  # neighbours 0.85, the next ones 0.72
    assert found(spark.createDataFrame(docs, "doc_id LONG, text STRING")) == near_duplicates(docs)


def test_rows_of_one_id_are_one_document(spark):
    """Texts of one id link what they are copies of, also where they are no near copies of each other; a null one links nothing."""
    one, other = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = [(5, one), (5, other), (5, None), (3, other), (9, one), (2, one + " y"), (8, other + " y"), (7, "alone")]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id LONG, text STRING")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [
        (2, 2, True), (3, 2, False), (5, 2, False), (5, 2, False), (5, 5, True), (7, 7, True), (8, 2, False), (9, 2, False)]


def test_open_pairs_of_blocks_are_compared(spark, copies, monkeypatch):
    """One round with one member each, then blocks of four rows: nothing may be lost."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    assert found(spark.createDataFrame(copies, "doc_id LONG, text STRING")) == near_duplicates(copies)


def test_bound_of_the_comparison():
    for n, least in minhash.least_matches(85, 1e-5).items():
        draws = np.random.default_rng(1).binomial(n, 0.85, 200_000)
        assert (draws < least).mean() < 1e-3 and least > n // 2


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert len(got) == 11
    assert [g for g in got if g[0] in (5, 6)] == [(5, 10, 5, True), (5, 10, 5, True), (6, 10, 5, False)]
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, 0, i, True) for i in (1, 2, 3)]
    assert [g[2:] for g in got if g[0] == 0] == [(None, True)]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1000, 1040)] + [(5, i) for i in range(200, 260)] + [(70, 71), (71, 72), (72, 70), (8, 8)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    expected = groups({i for x in links for i in x} - {8}, links[:-1])
    assert got == expected
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


@pytest.fixture
def vectors():
    draw = np.random.default_rng(4)
    rows, n = [], 0
    for size in (1,) * 300 + (2, 5, 40, 200):
        base = draw.standard_normal(24)
        for _ in range(size):
            rows.append((n, [float(x) for x in base + draw.standard_normal(24) * draw.uniform(0, 0.3)]))
            n += 1
    rows += [(2000, rows[-1][1]), (2001, [2 * x for x in rows[-1][1]]), (2002, None), (2003, []), (2004, [0.0] * 24),
             (2005, [float("nan")] + [1.0] * 23), (2006, [None] + [1.0] * 23), (2007, [float("inf")] * 24), (2008, [1.0, 2.0]), (2009, [1.0, 2.1])]
    return rows


@pytest.mark.parametrize("cell_rows, block_rows", [(512, 2048), (8, 16)])
def test_vector_links_equal_all_pairs(spark, vectors, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(multi_index, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", block_rows)
    rows = multi_index.near_duplicates(spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<DOUBLE>")).collect()
    links = cosine_links(vectors)
    linked = {i: 0 for i, _ in vectors}
    for pair in links:
        for i in pair:
            linked[i] += 1
    assert sum(r.n_links for r in rows) >= 0.99 * 2 * len(links)  # the target recall
    assert all(r.n_links <= linked[r.vec_id] for r in rows)
    reached = groups(linked, links)
    assert {r.vec_id: r.component_id for r in rows} == reached
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_vectors_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [1.0, 0.0], 3), (None, [1.0, 0.0], 3)],
                               "vec_id LONG, embedding ARRAY<FLOAT>, component_id INT").withColumn("id", F.lit(1)).withColumn("digest", F.lit(1))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert multi_index.near_duplicates(df.where("false")).count() == 0


def test_cells_are_visited_nearest_first():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multi_index.Index(x, 20_000)
    first, second = index.distances(x[:20])
    k = second.shape[1]
    for a, b in zip(first, second, strict=True):
        whole = (a[:, None] + b[None, :]).ravel()
        expected = np.flatnonzero(whole - whole.min() <= index.margin)
        got = index.visits(a, b)
        assert len(got) == len(set(got)) and set(got) == set(expected.tolist()) and k > 1
        assert (np.diff(whole[got]) >= -1e-9).all()


def test_repeated_units_stay_once(spark):
    passage = " ".join(f"common{i}" for i in range(60)) + "."
    rows = [(3, f"Intro of the third text here now.\n{passage}\nIts own last line with several words in it."),
            (1, f"{passage.upper()}   And a first text of its own with many words."), (2, f"Before it stands a sentence of eight words. {passage} After."),
            (4, "A clean text that shares nothing.\nYes.\nYes.\nYes."), (5, "the same line twice in this one text\nthe same line twice in this one text\n")]
    got = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    texts = dict(rows)
    assert got[1].text == texts[1] and got[4].text == texts[4] and got[4].n_removed == 0
    assert got[3].text == texts[3].replace(passage + "\n", "") and got[2].text == texts[2].replace(passage + " ", "")
    assert [(s.first_doc, texts[3][s.start:s.stop]) for s in got[3].removed] == [(1, passage + "\n")]
    assert got[5].text == "the same line twice in this one text\n"
    for r in got.values():
        assert "".join(texts[r.doc_id][s.start:s.stop] for s in r.kept_spans) == r.text


def test_repeats_equal_a_plain_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, expected = set(), {}
    for r in docs.orderBy("doc_id").collect():
        parts, at = [], 0
        for start, stop, words in lines.units(r.text):
            unit = " ".join(words).lower()
            if unit in seen:
                parts.append(r.text[at:start])
                at = stop
            seen.add(unit)
        expected[r.doc_id] = "".join([*parts, r.text[at:]])
    got = lines.deduplicated(docs).collect()
    assert {r.doc_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got)


def test_lines_of_odd_rows(odd_docs, no_docs):
    rows = lines.deduplicated(odd_docs).collect()
    assert len(rows) == 11
    assert {r.doc_id: r.text for r in rows}[1] is None
    assert [len(r.text) for r in rows if r.doc_id == 6] == [0]
    assert lines.deduplicated(no_docs).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """What is cut out of one row's text is not cut out of another of the same id."""
    passage = "These eight or more words stand in several of the documents here. "
    one, other = passage + "And this is the first text which nobody repeats at all.", "A clean sentence that stands nowhere else in any of the rows. " + passage
    rows = [(1, passage), (2, one), (2, other), (2, other), (3, other)]
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    texts = sorted((r.doc_id, r.text) for r in got)
    clean = "A clean sentence that stands nowhere else in any of the rows. "
    assert texts == sorted([(1, passage), (2, one[len(passage):]), (2, clean), (2, clean), (3, "")])
