from helpers import values
from pyspark.sql import functions as F

from emberline.operators import rollup

SCHEMA = ("run_id LONG, category STRING, is_flake STRING, test_id STRING, run_started_at STRING, run_url STRING, "
          "branch STRING, error_message STRING, summary STRING, status STRING, pos STRUCT<age:LONG,run:LONG,seq:LONG,job:LONG>")


def row(n, run_id, category, flake="yes", test_id="", started="2026-02-10T00:00:00Z", error="", summary="", status="done"):
    return (run_id, category, flake, test_id, started, f"u{run_id}", "main", error, summary, status, (0, 0, n, n))


def build(table, rows):
    return rollup.rollup(rollup.category_runs(rollup.valid_rows(table(rows, SCHEMA))))


def test_counts_flags_and_examples(table):
    got = build(table, [
        row(1, 1, "bug/a/T1", "yes", error="", summary="s1"), row(2, 1, "bug/a", "yes", error="e2"),
        row(3, 2, "bug/a/T2", "yes", error="e3", started="2026-02-12T00:00:00Z"),
        row(4, 3, "bug/b", "no"), row(5, 3, "bug/b", ""), row(6, 4, "bug/c", "no"), row(7, 5, "bug/d", "unclear"),
        row(8, 9, "misc/x"), row(9, 9, ""), row(10, 9, "bug/a", status="pending")])
    assert values(got, "category", "runs", "jobs", "flake", "example_error", "example_summary", "last_started_at") == [
        ("bug/a", 2, 3, "yes", "e2", "s1", "2026-02-12T00:00:00Z"), ("bug/b", 1, 2, "mixed", "", "", "2026-02-10T00:00:00Z"),
        ("bug/c", 1, 1, "no", "", "", "2026-02-10T00:00:00Z"), ("bug/d", 1, 1, "mixed", "", "", "2026-02-10T00:00:00Z")]


def test_last_occurrence_compares_instants(table):
    got = build(table, [row(1, 1, "bug/a", started="2026-02-10T23:00:00-05:00"), row(2, 2, "bug/a", started="2026-02-11T01:00:00Z")])
    assert values(got, "last_started_at") == [("2026-02-10T23:00:00-05:00",)]


def test_verdicts_count_invalid_categories_too(table):
    done = rollup.done_rows(table([row(1, 1, "misc/x", "no"), row(2, 1, "bug/a", "yes"), row(3, 2, "bug/a", "yes"),
                                   row(4, 2, "bug/a", ""), row(5, 3, "", ""), row(6, 4, "bug/a", "no", status="error")], SCHEMA))
    verdicts = rollup.run_verdict_rows(done)
    assert values(verdicts, "run_id", "verdict") == [(1, "real"), (2, "flake"), (3, "unclear")]
    assert values(rollup.totals(verdicts)) == [(3, 1, 1, 1, 5)]
    assert values(rollup.totals(verdicts.where("false"))) == [(0, 0, 0, 0, 0)]


def test_test_ids_split_trim_and_guard(table):
    rows = table([row(1, 1, "bug/a", test_id=" T1,T2 ,, T1"), row(2, 2, "bug/a", test_id="- **failed_test**: x"), row(3, 2, "bug/a")], SCHEMA)
    assert values(rollup.category_test_ids(rows)) == [("bug/a", "T1"), ("bug/a", "T2")]


def test_category_list_keeps_an_empty_first_summary(table):
    rows = table([row(1, 1, "bug/a/T1", summary=""), row(2, 1, "bug/a/T2", summary="later"),
                  row(3, 1, "bug/b", summary="x" * 130, status="classified"), row(4, 1, "bug/c", status="pending")], SCHEMA)
    assert values(rollup.category_list(rows)) == [("bug/a", ""), ("bug/b", "x" * 117 + "...")]


def test_descriptions_prefer_the_exact_name_then_the_first(table):
    names = table([("bug/a",), ("bug/b",), ("bug/c",)], "category STRING")
    known = table([("bug/a/T1", 1, "near"), ("bug/a", 2, "exact"), ("bug/b/T2", 4, "second"), ("bug/b/T1", 3, "first")],
                  "full_category STRING, pos INT, description STRING")
    assert values(rollup.describe(names, known), "category", "description") == [("bug/a", "exact"), ("bug/b", "first"), ("bug/c", "")]


def test_affected_runs_order_key(table):
    rows = rollup.affected_runs(rollup.category_runs(rollup.valid_rows(table([
        row(1, 10, "bug/a"), row(2, 9, "bug/a"), row(3, 9, "bug/a"), row(4, 2, "bug/a", started="")], SCHEMA))))
    got = rows.orderBy(F.desc("epoch"), "run_id").collect()
    assert [(r.run_id, r.jobs_failed, r.date) for r in got] == [("10", 1, "2026-02-10"), ("9", 2, "2026-02-10"), ("2", 1, "")]
