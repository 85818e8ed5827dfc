import json
from collections import Counter

from helpers import values

from emberline.operators import report, status
from emberline.plans import inputs
from emberline.plans import statistics as plans

SF = "/root/testdata/sf0.001"


def test_report_folder_is_complete(spark, tmp_path):
    parts = plans._parts(spark, SF)
    report.write(parts, str(tmp_path / "r"), "2001-08-01")
    records = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r/report_json")).collect()]
    cats = [r for r in records if "n_fixes" in r]
    runs = [r for r in records if "jobs_failed" in r]
    assert len(cats) == parts.categories.count()
    assert Counter(r["name"] for r in runs) == Counter({c["name"]: c["runs"] for c in cats})
    assert sum(c["jobs"] for c in cats) == sum(r["jobs_failed"] for r in runs) == inputs.valid(spark, SF).count()
    assert sum(c["n_test_ids"] for c in cats) == sum("test_id" in r for r in records)
    assert sum(c["n_subcategories"] for c in cats) == sum("subcategory" in r for r in records)
    assert sum(c["n_fixes"] for c in cats) == sum("confidence" in r for r in records)
    assert spark.read.json(str(tmp_path / "r/affected_runs")).count() == len(runs)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/report_md")).collect())
    assert text.count("\n### ") >= len(cats) and text.index("### Flaky causes") < text.index("### Lasting causes")


def test_empty_report_only_without_failures(table):
    runs = table([(1,)], "run_id LONG")
    assert report.empty_report(runs, "2026-02-18").count() == 0
    row = report.empty_report(runs.where("false"), "2026-02-18").collect()[0]
    assert (row.status, row.total_runs, row.categories) == ("no-failures", 0, 0)


def test_life_cycle_rules(table):
    base = table([(1, "pending"), (2, "done"), (3, "classified")], "run_id LONG, status STRING")
    updates = table([(1, 1, "done"), (1, 2, "error"), (9, 1, "done")], "run_id LONG, version LONG, status STRING")
    assert values(status.merge_runs(base, updates)) == [(1, "error", True, False), (2, "done", False, True), (3, "classified", False, False)]
    assert values(status.latest_status(updates), "run_id", "status") == [(1, "done"), (9, "done")]
    assert values(status.mark_error(base, base), "run_id", "status") == [(1, "error"), (2, "done"), (3, "classified")]
    assert values(status.promote(base, "classified", "done"), "status") == [("done",), ("done",), ("pending",)]
