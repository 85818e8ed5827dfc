import pytest
from pyspark.sql import functions as F

from emberline.functions import categories as cat
from emberline.functions import dates, links, text


def evaluate(table, expression, inputs):
    rows = table([(i, v) for i, v in enumerate(inputs)], "i INT, v STRING").select("i", expression(F.col("v")).alias("o"))
    return [r.o for r in rows.orderBy("i").collect()]


def test_category_split_drops_the_last_of_three_or_more(table):
    names = ["a/b", "a/b/c", "a/b/c/d", "a", ""]
    assert evaluate(table, cat.report_category, names) == ["a/b", "a/b", "a/b/c", "a", ""]
    assert evaluate(table, cat.subcategory, names) == ["", "c", "d", "", ""]
    assert evaluate(table, cat.list_category, names) == ["a/b", "a/b", "a/b", "a", ""]


def test_valid_prefix_needs_the_slash(table):
    assert evaluate(table, cat.has_valid_prefix, ["bug/x", "bug", "bugs/x", "test-flake/", "x/bug/", ""]) == \
        [True, False, False, True, False, False]


@pytest.mark.parametrize("stamp, epoch", [
    ("2026-02-18T14:30:00Z", 1771425000), ("2026-02-18T09:30:00-05:00", 1771425000), ("2026-02-18", 1771372800),
    ("", 0), (None, 0), ("garbage", 0)])
def test_epoch(table, stamp, epoch):
    assert evaluate(table, dates.utc_epoch, [stamp]) == [epoch]


def test_relative_date_uses_the_date_in_the_stamp(table):
    stamps = ["2026-02-20T23:59:00-05:00", "2026-02-19", "2026-02-10T00:00:00Z", "2026-02-22", "", "nope"]
    got = evaluate(table, lambda v: dates.relative_date(v, F.lit("2026-02-20").cast("date")), stamps)
    assert got == ["today", "1 day ago", "10 days ago", "-2 days ago", "", ""]


def test_clip_counts_characters(table):
    assert evaluate(table, lambda v: text.clip(v, 5, 3), ["éééééé", "12345", "123456", ""]) == ["ééé...", "12345", "123...", ""]


def test_field_of_an_empty_line_is_empty(table):
    body = "- **category**:\n- **is_flake**:   yes \n- **test-id**: a`b\\c $1\n"
    assert evaluate(table, lambda v: text.field(v, "category"), [body]) == [""]
    assert evaluate(table, lambda v: text.field(v, "is_flake"), [body]) == ["yes"]
    assert evaluate(table, lambda v: text.field(v, "test-id"), [body]) == ["a`b\\c $1"]
    assert evaluate(table, lambda v: text.field(v, "missing"), [body]) == [""]


def test_strip_and_log_cleaning(table):
    assert evaluate(table, text.strip, ["\t\u00a0 x y \n", " "]) == ["x y", ""]
    lines = ["\u001b[31mbad\u001b[0m", "2026-02-18T14:30:00.123Z  boom", "at 2026-02-18 14:30:00 x"]
    assert evaluate(table, text.clean_log, lines) == ["bad", "boom", "at x"]


def test_search_words(table):
    words = set(evaluate(table, text.words, ["Fix connectionPool in brand-12 (test_a.py::T)"])[0])
    assert {"fix", "connectionpool", "connection", "pool", "brand-12", "brand", "12", "test_a.py::t"} <= words


def test_compose_and_slug(table):
    assert evaluate(table, cat.slug, ["Context deadline exceeded after #s: one two three", "!!"]) == \
        ["context-deadline-exceeded-after-s-one-two-three", ""]
    rows = table([("test-flake", "x", False, "T1"), ("test-flake", "x", True, "T1"), ("infra-flake", "x", False, "T1"),
                  ("bug", "x", False, "")], "k STRING, r STRING, s BOOLEAN, t STRING")
    got = [r[0] for r in rows.select(cat.compose(*[F.col(c) for c in "krst"])).collect()]
    assert got == ["test-flake/x/T1", "test-flake/systemic-x", "infra-flake/x", "bug/x"]


def test_fix_links(table):
    rows = table([("pr", 12, None, "u", "2026-02-18T01:00:00Z", "Title", "match"),
                  ("commit", None, "abcdef123456", "u", "", "", "possible")],
                 "type STRING, id LONG, sha STRING, url STRING, date STRING, title STRING, confidence STRING")
    c = {n: F.col(n) for n in rows.columns}
    got = rows.select(links.table_link(c["type"], c["id"], c["sha"], c["url"], c["confidence"]),
                      links.detail_line(c["type"], c["id"], c["sha"], c["url"], c["date"], c["title"])).collect()
    assert [tuple(r) for r in got] == [("[#12](u)", "  - 2026-02-18 [#12](u) Title"),
                                       ("[abcdef1](u) (possibly)", "  - [abcdef1](u)")]
