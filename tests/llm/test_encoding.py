import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from emberline.llm import bpe_chunks, encoding, minhash, token_files, words
from emberline.llm.queries import BYTE_TOKENIZER, MERGE_TOKENIZER, tokenizer_path
from emberline.llm.store import Workspace

SF = "/root/testdata/sf0.001"
PIECES = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "Word", "é", "ß", "\u00a0", "!", "...", "'s", "don't", "12", "<|endoftext|>", "👍",
          "\u1680", "\u200b", "\x85", "\r\n", "İ", "中文", "the ", " of", "́", "x'S", "-'", "%%%", "|"]


@pytest.mark.parametrize("kind, name", [(encoding.WordUnits, MERGE_TOKENIZER), (encoding.SpacedUnits, BYTE_TOKENIZER)])
def test_units_equal_the_library(kind, name, monkeypatch):
    monkeypatch.setattr(encoding, "KNOWN_UNITS", 50)
    draw = random.Random(1)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 15))).encode() for _ in range(1500)]
    engine, library = kind(tokenizer_path(name)), encoding.tokenizer(tokenizer_path(name))
    for start in range(0, len(texts), 300):
        some = texts[start:start + 300]
        for text, ids in zip(some, engine.texts(some), strict=True):
            assert library.encode(text.decode(), add_special_tokens=False).ids == ids.tolist(), text


def digests(text):
    library = encoding.tokenizer(tokenizer_path(MERGE_TOKENIZER))
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_share_and_join_exactly(spark, odd_docs, no_docs):
    draw = random.Random(2)
    shared = "".join(draw.choice(PIECES[:16] + PIECES[17:]) for _ in range(6000))
    words = " ".join(f"tok{draw.randint(0, 999)}x" for _ in range(3000))
    glued = "".join(f"tok{draw.randint(0, 999)}" for _ in range(2000))
    rows = [(i, f"{'z' * i}{body}{'q' * i}") for i in range(6) for body in (shared, words, glued)]
    rows = [(3 * i + k, t) for k in range(3) for i, (_, t) in enumerate(rows[k::3])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in bpe_chunks.encoded(docs, tokenizer_path(MERGE_TOKENIZER)).collect()}
    assert got == {i: digests(t) for i, t in rows}
    assert bpe_chunks.shared_sketch(docs).any()
    odd = bpe_chunks.encoded(odd_docs, tokenizer_path(MERGE_TOKENIZER)).collect()
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, odd), key=key) == sorted(((r.doc_id, *digests(r.text)) for r in odd_docs.collect()), key=key)
    assert bpe_chunks.encoded(no_docs, tokenizer_path(MERGE_TOKENIZER)).count() == 0


def test_chunks_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe_chunks.encoded(docs, tokenizer_path(MERGE_TOKENIZER)).collect()}
    assert got == {r.doc_id: digests(r.text) for r in docs.collect()}


def contextual(part):
    """Ids of words that depend on all words back to the last "stop", and the characters they come from."""
    ids, offsets, state = [], [], 0
    for m in re.finditer(r"\S+", part.decode()):
        state = 0 if m[0] == "stop" else zlib.crc32(m[0].encode(), state)
        ids.append(state)
        offsets.append(m.span())
    return ids, offsets


def test_joins_widen_until_both_sides_agree():
    words = " ".join(f"w{i}" for i in range(40))
    text = f"before the {words} stop again {words} stop last one".encode()
    a, b = text.index(b"w3 "), len(text)
    place, n = bpe_chunks.join_head(contextual, text, a, b, 0)
    ids, offsets = contextual(text[a:b])
    whole = contextual(text)[0]
    assert n > 20 and ids[n:] == whole[-len(ids[n:]):] and a + offsets[n][0] >= place
    assert bpe_chunks.join_head(contextual, text, a, text.index(b" stop"), 0) is None
    assert bpe_chunks.join_head(contextual, text, 0, 50, 0) == (0, 0)

    def backward(part):
        ids, offsets = contextual(part[::-1])
        return ids[::-1], [(len(part) - e, len(part) - s) for s, e in offsets[::-1]]

    turned = text[::-1].replace(b"pots", b"stop"[::-1])
    b = len(turned) - a
    place, n = bpe_chunks.join_tail(backward, turned, 0, b)
    assert n > 20 and place < b and backward(turned[:b])[0][:-n] == backward(turned)[0][:len(backward(turned[:b])[0]) - n]
    assert bpe_chunks.join_tail(backward, turned, 0, len(turned)) == (len(turned), 0)


def test_share_of_reused_ids(spark, no_docs):
    draw = random.Random(5)
    body = " ".join(f"tok{draw.randint(0, 9999)}x" for _ in range(4000))
    docs = spark.createDataFrame([(i, f"{i} own words {body}") for i in range(8)], "doc_id LONG, text STRING")
    path = tokenizer_path(MERGE_TOKENIZER)
    row = bpe_chunks.reuse(docs, path).first()
    assert row.n_ids == sum(digests(r.text)[0] for r in docs.collect())
    assert 0.9 * row.n_ids < row.n_reused < row.n_ids and 20 < row.n_chunks < 200
    assert tuple(bpe_chunks.reuse(no_docs, path).first()) == (0, 0, 0)


def test_chunk_ends_are_those_of_characters_and_of_content():
    draw = random.Random(3)
    body = "".join(draw.choice("aé中👍 bc") for _ in range(20_000))
    (ends,), (moved,) = bpe_chunks.chunk_ends([body.encode()]), bpe_chunks.chunk_ends([("xyz" + body).encode()])
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        body.encode()[a:b].decode()
        assert b - a <= bpe_chunks.MOST + 4
    assert len(set(ends) & {e - 3 for e in moved}) > 0.9 * len(ends)


def test_token_files(spark, odd_docs, no_docs):
    library = encoding.tokenizer(tokenizer_path(BYTE_TOKENIZER))
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        expected, start = [], 0
        for doc_id, text in rows:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
            expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = token_files.round_trip(docs, tokenizer_path(BYTE_TOKENIZER)).orderBy("start").collect()
        assert [tuple(r) for r in got] == expected
    assert token_files.round_trip(no_docs, tokenizer_path(BYTE_TOKENIZER)).count() == 0


def test_token_file_format(spark):
    docs = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id LONG, text STRING").coalesce(1)
    with Workspace(spark) as work:
        parts = token_files.write(docs, work.folder("t"), tokenizer_path(BYTE_TOKENIZER), end_id=9).orderBy("part").collect()
        ids = np.concatenate([np.memmap(f"{p.path}.ids", "<u2", "r", shape=(p.n_tokens,)) for p in parts])
        assert sum(p.n_docs for p in parts) == 2 and [p.base for p in parts][0] == 0
        assert ids.tolist() == [64, 9, 65, 269, 9]


def _twins(size):
    """The Thue-Morse word of this length and its complement, which polynomials modulo 2**64 hash alike."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_long_words_that_clash_under_polynomial_hashes(spark, size):
    a, b = _twins(size)
    for kind, path in ((encoding.SpacedUnits, BYTE_TOKENIZER), (encoding.WordUnits, MERGE_TOKENIZER)):
        engine = kind(tokenizer_path(path))
        for text, ids in zip((a, b), engine.texts([a.encode(), b.encode()]), strict=True):
            assert ids.tolist() == engine.whole(text).tolist()
    sets, bounds = words.shingles(words.Runs([a.encode(), b.encode()]))
    assert sets[0] != sets[1] and bounds.tolist() == [0, 1, 2]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id LONG, text STRING")
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2, 1]
