"""Fill-in-the-middle by frames against plain string work."""

import hashlib
import re

import pytest
import zstandard

from emberline.llm import fim, queries

MARKS = (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)


def plain(doc_id, text, unit="line", share=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= share:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), out


@pytest.fixture
def lines(spark, odd_docs):
    """Odd documents, and lines of many lengths around the size of a frame."""
    rows = [(100 + i, "\n" * (i % 4) + "é" * i + "\nab\n\n" + "中x\n" * (i % 7) + "end" * (i % 3)) for i in range(60)]
    rows += [(200, "a <P> b\nc"), (201, "<M"), (202, "\n"), (203, "<S\n>\n<"), (203, "<S\n>\n<")]
    return odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id LONG, text STRING"))


@pytest.mark.parametrize(("unit", "size", "share"), [("line", 1, 100), ("line", 5, 100), ("line", 32_768, 60), ("char", 4, 100)])
def test_frames_give_the_plain_result(lines, unit, size, share):
    lines = lines.where("length(text) < 1000 or text is null") if size < 100 else lines
    made = fim.transformed(fim.framed(lines, unit, size=size), unit, share=share)
    got = {}
    for r in fim.texts(made).collect():
        got.setdefault(r.doc_id, []).append((r.n, r.form, r.prefix_chars, r.middle_chars, r.text))
    want = {}
    for r in lines.collect():
        want.setdefault(r.doc_id, []).append(plain(r.doc_id, r.text, unit, share))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    originals = {}
    for r in lines.collect():
        originals.setdefault(r.doc_id, set()).add(hashlib.sha256((r.text or "").encode()).hexdigest())
    for r in fim.digests(made).collect():
        assert r.restored_sha256 in originals[r.doc_id]
    assert {r.output_sha256 for r in fim.digests(made).collect()} == {
        hashlib.sha256(x[-1].encode()).hexdigest() for v in want.values() for x in v}


def test_other_columns_stay_and_clashing_ones_are_replaced(odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "1 AS frames", "2 AS n", "3 AS form", "4 AS output_sha256")
    out = fim.digests(fim.transformed(fim.framed(clash)))
    assert out.count() == odd_docs.count() and set(out.columns) >= {"lang", "digest", "kept", "n", "output_sha256"}
    assert {r.digest for r in out.collect()} == {7}
    assert fim.digests(fim.transformed(fim.framed(no_docs))).count() == 0


def test_only_frames_of_the_cuts_are_compressed_anew(spark):
    text = "".join(f"line number {i}\n" for i in range(2000))
    stored = fim.framed(spark.createDataFrame([(i, text) for i in range(6)], "doc_id LONG, text STRING"), size=500)
    frames = {bytes(f.data) for f in stored.first().frames}
    for row in fim.transformed(stored).collect():
        output = [bytes(f) for f in row.output]
        assert sum(f not in frames for f in output) <= 3 + 4
        whole = zstandard.ZstdDecompressor().stream_reader(b"".join(output), read_across_frames=True).read().decode()
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, whole) == plain(row.doc_id, text)


def test_marks_are_found_across_pieces():
    text = b"<S>suf<<Pix<P>pre<M><M>mid"
    for size in (1, 2, 3, 7, 100):
        pieces = (text[i:i + size] for i in range(0, len(text), size))
        parts = {}
        for place, data in fim.sections(pieces, (b"<S>", b"<P>", b"<M>")):
            parts[place] = parts.get(place, b"") + data
        assert {k: v for k, v in parts.items() if v} == {0: b"suf<<Pix", 1: b"pre", 2: b"<M>mid"}


def test_null_and_empty_texts_in_the_query(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_fim_frames(spark, str(tmp_path)).collect()
    assert len(rows) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.form == "plain" and r.n == 0 and r.output_sha256 == empty == r.restored_sha256 for r in rows if r.doc_id in (1, 2))
