"""The rule table: built-in and user rows, anchors found by index or by join, all failed tests of a job, hunks."""

import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from emberline.functions.search import holds_any
from emberline.operators import hunks, rules, signals
from emberline.sources import adapter

LOG = "run_id LONG, job_id LONG, line_no LONG, text STRING"
LINES = ["\u001b[31m[FAIL]\u001b[0m x [It] y [42, slow]", "[\u001b[1mFAIL\u001b[0m] split by colours", "2026-02-18T00:00:00Z --- FAIL: TestA (0.1s)", "FAIL\tpkg/a",
         "FAILED t.py::test_a - x", "E       AssertionError: 1", "Tests run: 3, Failures: 0", "Tests run: 3, Failures: 2 in A#b", "FAIL src/a.test.ts > A > b",
         "Received: 2", "wait timed out", "all fine", "\u001b[32mok\u001b[0m", "", "disk-1: x", "disk-12: full", "é disk-1 中"]


def lines(table, texts=LINES):
    return table([(1, 1, i, t) for i, t in enumerate(texts)], LOG)


def user(table, rows):
    return table(rows, rules.RULES)


def test_builtin_rows_find_what_the_fixed_expressions_find(spark, table):
    got = rules.marker_rows(rules.hit_lines(lines(table), rules.builtin_rules(spark)))
    assert set(values(got, "line_no", "framework", "kind")) == set(values(signals.marker_hits(lines(table)), "line_no", "framework", "kind"))


@pytest.mark.parametrize("index_chars", [rules.INDEX_CHARS, 0])
def test_a_row_changes_the_result_without_code(spark, table, index_chars):
    builtin = rules.builtin_rules(spark)
    more = user(table, [("disk-1", "site", "disk", "disk-1", None, 2, "disk-one"), ("disk-12", "site", "disk", "disk-12", "full$", 1, None),
                        ("any-timeout-2", "any", "timeout", "timed out", "never", 1, None), (None, "x", None, "all", None, 1, None),
                        ("no-anchor", "x", "y", "", None, 1, None), ("late", "x", "y", "all fine", None, None, None)])
    got = rules.marker_rows(rules.hit_lines(lines(table), rules.with_user_rules(builtin, more), index_chars))
    mine = [r for r in values(got, "line_no", "rule_id", "priority") if r[0] in (10, 11, 14, 15, 16)]
    assert mine == [(11, "late", 5), (14, "disk-1", 2), (15, "disk-1", 2), (15, "disk-12", 1), (16, "disk-1", 2)]


def test_index_and_join_give_the_same_hits(spark, table):
    draw, rows = random.Random(3), []
    for i in range(60):
        anchor = "".join(draw.choice("ab-:") for _ in range(draw.randint(1, 5)))
        rows.append((f"r{i:02}", "f", draw.choice(["k", "test", "test_id"]), anchor, draw.choice([None, "a(b*)", "(-+):"]) if i % 3 else "(a+)", i % 4, None))
    texts = ["".join(draw.choice("ab-: ") for _ in range(draw.randint(0, 12))) for _ in range(120)]
    table_, log = user(table, rows), lines(table, texts)
    by_index, by_join = (values(rules.hit_lines(log, table_, n).selectExpr("line_no", "cast(hits.rule_id as string) as ids")) for n in (10**6, 0))
    brute = {i: sorted((r[5], r[0]) for r in rows if r[3] in t.strip() and (r[4] is None or __import__("re").search(r[4], t.strip())))
             for i, t in enumerate(texts)}
    kind = {r[0]: r[2] for r in rows}
    brute = {i: found for i, found in brute.items() if any(kind[n] != rules.ID_KIND for _, n in found)}
    assert by_index == by_join == [(i, f"[{', '.join(n for _, n in found)}]") for i, found in sorted(brute.items()) if found]


def test_no_rules_and_no_lines(spark, table):
    assert rules.hit_lines(lines(table), user(table, [])).count() == 0
    assert rules.hit_lines(lines(table, []), rules.builtin_rules(spark)).count() == 0


def test_every_failed_test_of_a_job_in_order(spark, table):
    log = table([(1, 1, 9, "--- FAIL: TestB (0.1s)"), (1, 1, 4, "--- FAIL: TestA (0.1s)"), (1, 1, 20, "--- FAIL: TestA (0.1s)"), (1, 1, 30, "--- FAIL: TestC (1s)"),
                 (1, 1, 31, "panic: x"), (1, 2, 1, "deadline exceeded"), (1, 3, 2, "FAILED a/t.py::T::x - y"), (1, 3, 1, "FAILED b/t.py::T::x - y")], LOG)
    found = rules.job_signals(rules.hit_lines(log, rules.builtin_rules(spark)))
    assert values(found, "job_id", "test_id", "failed_test", "test_file", "error_message") == [
        (1, "TestA", "TestA, TestB, TestC", "", "panic: x"), (2, "", "", "", "deadline exceeded"),
        (3, "b/t.py::T::x", "b/t.py::T::x, a/t.py::T::x", "b/t.py", "FAILED b/t.py::T::x - y")]


def test_a_slug_names_the_root_cause(spark, table):
    more = user(table, [("disk", "site", "disk", "disk-", None, 1, "bad-disk")])
    log = table([(1, 1, 1, "disk-7: gone"), (1, 1, 2, "--- FAIL: TestA (0.1s)"), (1, 2, 1, "connection refused")], LOG)
    found = rules.log_category(rules.job_signals(rules.hit_lines(log, rules.with_user_rules(rules.builtin_rules(spark), more))))
    assert values(found, "job_id", "category") == [(1, "test-flake/bad-disk/TestA"), (2, "infra-flake/connection-refused")]


def brute_hunks(hits, length, context):
    out = []
    for line in sorted(hits):
        if out and line - context <= out[-1][1] + 1:
            out[-1][1] = line + context
        else:
            out.append([line - context, line + context])
    return [(max(1, a), min(length, b)) for a, b in out]


@pytest.mark.parametrize("context", [0, 1, 5])
def test_hunks_equal_merged_frames(table, context):
    draw, rows, want = random.Random(context), [], []
    for job in range(25):
        length = draw.randint(1, 120)
        hits = {i for i in range(1, length + 1) if draw.random() < (0.02, 0.1, 0.5)[job % 3]}
        rows += [(1, job, i, "hit" if i in hits else "x") for i in range(1, length + 1)]
        want += [(job, n, a, b) for n, (a, b) in enumerate(brute_hunks(hits, length, context), 1)]
    got = hunks.context_hunks(table(rows, LOG).repartition(6), "hit", context)
    assert values(got, "job_id", "hunk_no", "first_line", "last_line") == sorted(want)


def test_one_log_of_many_lines(spark, table):
    log = spark.range(1, 30_001).selectExpr("1L AS run_id", "2L AS job_id", "id AS line_no", "if(id % 13 = 0 OR id = 7, 'hit', 'x') AS text")
    got = hunks.context_hunks(log, "hit", 5)
    assert got.count() == len(brute_hunks({7, *range(13, 30_001, 13)}, 30_000, 5))
    assert got.agg({"hunk_no": "max"}).first()[0] == got.count()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_lines_are_read_once_for_hunks(spark):
    log = spark.range(1, 100).selectExpr("1L AS run_id", "2L AS job_id", "id AS line_no", "if(id = 50, 'hit', 'x') AS text")
    got = hunks.context_hunks(log, "hit", 5)
    assert "Range (" not in plan(got)
    assert values(got, "hunk_no", "first_line", "last_line") == [(1, 45, 55)]


def test_the_hits_are_gone_through_once_for_the_signals(spark):
    log = spark.range(1, 100).selectExpr("1L AS run_id", "2L AS job_id", "id AS line_no", "if(id % 40 = 0, 'FAIL src/a' || id || '.test.ts > A', 'x') AS text")
    found = rules.job_signals(rules.hit_lines(log, rules.builtin_rules(spark)))
    assert plan(found).count("Range (") == 1
    assert [(t, sorted(f)) for t, f in values(found, "test_id", "test_files")] == [("A", ["src/a40.test.ts", "src/a80.test.ts"])]


def test_long_anchors_are_one_search(spark, table):
    names = ["a.b", "a.bc", "(x", "ab", "é+\U0001f600z", "Q[1]", "x\ty"]
    text = ["za.by", "axb", "a(x", "é+\U0001f600z!", "é+z", "Q[1]", "Q1", "x\ty", "x y", "", None]
    found = holds_any(F.col("text"), names)
    assert str(found).count("contains") == 2
    rows = table([(i, t) for i, t in enumerate(text)], "i INT, text STRING").where(found)
    assert [i for i, in values(rows, "i")] == [i for i, t in enumerate(text) if t and any(n in t for n in names)]


def test_the_time_of_a_log_line_is_made_once_a_job(spark):
    lines = adapter.long_log_lines(spark, "/root/testdata/sf0.001")
    by_job = plan(lines).split("Generate explode(sequence")[-1]
    assert plan(lines).count("date_format") == by_job.count("date_format") > 0
