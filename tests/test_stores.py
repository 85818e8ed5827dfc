"""Stored runs, the compacted status table, the new document, checked readers and statistics over files."""

import contextlib
import io
from pathlib import Path

import pytest
from helpers import values
from pyspark.sql import functions as F

from emberline.operators import ordering, stats
from emberline.params import FAILED_JOB_COLUMNS
from emberline.plans import documents as documents_of_queries
from emberline.plans import ingest
from emberline.sinks import run_table, writers
from emberline.sources import documents, readers
from emberline.streaming import status_table

VERSION = "STRUCT<no: LONG, id: LONG>"


def test_an_update_can_be_repeated_and_never_goes_back(spark, table, tmp_path):
    path = str(tmp_path / "runs")
    run_table.create(table([(i, "pending", (0, 0)) for i in range(50)], f"run_id LONG, status STRING, version {VERSION}"), path, 8)

    def update(*rows):
        return values(run_table.upsert(spark, path, table(list(rows), f"run_id LONG, version {VERSION}, status STRING"), 8))

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "runs").rglob("*.parquet")}

    assert update((1, (1, 1), "classified"), (1, (2, 1), "done"), (2, (1, 1), "error"), (999, (1, 1), "done")) == [
        (1, "done", True), (2, "error", True), (999, None, False)]
    before = files()
    assert update((1, (2, 1), "done"), (2, (1, 1), "error")) == [(1, "done", True), (2, "error", True)]
    assert files() == before  # nothing was written
    assert update((1, (1, 9), "error")) == [(1, "done", False)]
    assert update((2, (1, 2), "done")) == [(2, "done", True)]
    after = files()
    assert sum(f not in before for f in after) == 1  # one folder of eight
    assert dict(values(run_table.read(spark, path), "run_id", "status")) == {**{i: "pending" for i in range(50)}, 1: "done", 2: "done"}


def test_folders_of_the_stream_are_folded(spark, tmp_path):
    source, target, state = (tmp_path / n for n in ("in", "table", "state"))
    source.mkdir()
    want, rank = {}, ["pending", "error", "classified", "done"]
    for n in range(9):
        rows = [(run, rank[(run * n) % 4]) for run in range(5)]
        for run, status in rows:
            want[str(run)] = max(want.get(str(run), "pending"), status, key=rank.index)
        (source / f"{n}.md").write_text("".join(
            f"<!-- BEGIN RUN {run} -->\n- **status**: {status}\n\n#### job: `a`\n<!-- END RUN {run} -->\n" for run, status in rows))
        status_table.start(status_table.document_stream(spark, str(source)), str(target), str(state), compact_every=3).awaitTermination(120)
        assert dict(values(status_table.read(spark, str(target)), "run_id", "status")) == want
        assert len(list((target / "batches").iterdir())) <= 3
    status_table.compact(spark, str(target), 8)
    status_table.compact(spark, str(target), 8)  # repeated
    assert [p.name for p in (target / "snapshots").iterdir()] == ["upto=8"]
    # a replayed batch that a snapshot covers is not counted again
    spark.createDataFrame([("0", "pending", 1)], "run_id STRING, status STRING, updates LONG").write.parquet(f"{target}/batches/batch=2")
    assert dict(values(status_table.read(spark, str(target)), "run_id", "status")) == want
    assert status_table.read(spark, str(tmp_path / "none")).count() == 0


def test_new_document_from_the_file(spark, table, tmp_path):
    rows = [("7", "http://x/7", "main", "push", "abc", f"job {i}", "failure", "2026-02-18T00:00:00Z", "", "1", "test") for i in range(10_002)]
    rows[3:3] = [("8", "http://x/8", "", "push", "abd", 'quoted "job"', "cancelled", "2026-02-17T00:00:00Z", "", "2", "")]
    rows.append(("9", "", "b\\c", "push", "", "last", "failure", "", "", "", "step, one"))
    data = table([(i, *r) for i, r in enumerate(rows)], "pos INT, " + ", ".join(f"{c} STRING" for c in FAILED_JOB_COLUMNS))
    writers.write_pending_document(writers.pending_document(data), str(tmp_path / "doc"))
    blocks = readers.read_run_document(spark, str(tmp_path / "doc"))
    assert blocks.count() == 4  # the long run has two
    runs = documents.run_fields(blocks).orderBy("pos").collect()
    assert [(r.run_id, r.status, r.run_url, r.branch, r.run_attempt) for r in runs] == [
        ("7", "pending", "http://x/7", "main", "1"), ("8", "pending", "http://x/8", "", "2"), ("9", "pending", "", "b\\c", "")]
    jobs = documents.job_rows(blocks).orderBy("pos").collect()
    assert [(r.run_id, r.job_name, r.job_conclusion, r.step) for r in jobs] == [
        (r[0], r[5], r[6], r[10]) for key in "789" for r in rows if r[0] == key]
    assert {(r.job_id, r.category, r.is_flake, r.test_id, r.summary) for r in jobs} == {("", "", "", "", "")}
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert text.startswith("# CI Failure Classification Progress\n\n## Categories So Far\n<!-- CATEGORIES START -->\n(none yet)\n<!-- CATEGORIES END -->\n\n---\n\n"
                           "<!-- BEGIN RUN 7 -->\n## run_id: 7\n- **status**: pending\n")
    assert text.endswith("- **summary**:\n\n<!-- END RUN 9 -->\n\n")


def test_new_document_of_nothing(spark, table, tmp_path):
    data = table([], "pos INT, " + ", ".join(f"{c} STRING" for c in FAILED_JOB_COLUMNS))
    writers.write_pending_document(writers.pending_document(data), str(tmp_path / "doc"))
    assert readers.read_run_document(spark, str(tmp_path / "doc")).count() == 0
    assert spark.read.text(str(tmp_path / "doc")).where("value = '(none yet)'").count() == 1


def test_tsv_has_no_quoting(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text('#1\t2026-02-18T00:00:00Z\t"Quoted start only\thttp://x/1\n#2\t2026-02-18T00:00:00Z\ta "b" \\\thttp://x/2\r\n\n'
                    "#3\t2026-02-18T00:00:00Z\ttab\tin title\thttp://x/3\nno fields\n#x\t2026-02-18T00:00:00Z\tt\thttp://x\n#4\t\tt\thttp://x\n")
    assert values(readers.read_pull_requests_tsv(spark, str(path)), "number", "title", "url") == [
        (1, '"Quoted start only', "http://x/1"), (2, 'a "b" \\', "http://x/2"), (3, "tab\tin title", "http://x/3")]
    bad = readers.malformed_tsv(spark, str(path), readers.PULL_REQUESTS_TSV)
    assert sorted(r.problem for r in bad.collect()) == ["malformed created", "malformed number", "too few fields"]
    (tmp_path / "c.tsv").write_text('ab1\t2026-02-18T00:00:00Z\t"open quote\nab2\t2026-02-19T00:00:00+01:00\tnext row\n')
    assert values(readers.read_commits_tsv(spark, str(tmp_path / "c.tsv"), "2026-02-01"), "sha", "subject") == [("ab1", '"open quote'), ("ab2", "next row")]


def test_unusable_json_is_kept_apart(spark, tmp_path):
    good = '{"run_id":1,"job_id":2,"conclusion":"failure","steps":[{"name":"a","conclusion":"failure","number":1}]}'
    (tmp_path / "j.json").write_text("\n".join([good, good[:50], '{"run_id":1}', '{"run_id":"x","job_id":3}', "[]", "", "null"]))
    checked = readers.read_jobs_json(spark, str(tmp_path))
    assert [(r.run_id, r.job_id, r.steps[0].name) for r in readers.good_records(checked).collect()] == [(1, 2, "a")]
    reasons = sorted((r.problem, r.file) for r in readers.quarantined(checked).collect())
    assert [p for p, _ in reasons].count("no job_id") >= 1 and [p for p, _ in reasons].count("unreadable") >= 2 and len(reasons) == 5


def test_logs_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "5_6.log").write_text("".join(f"line {i}\n" for i in range(1, 4001)))
    (tmp_path / "5_7.log").mkdir()
    for part in range(3):
        (tmp_path / "5_7.log" / f"part-{part}.txt").write_text("".join(f"line {part * 700 + i}\n" for i in range(1, 701)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = readers.read_logs(spark, f"{tmp_path}/*.log")
        assert lines.where(F.col("text") != F.concat(F.lit("line "), "line_no")).count() == 0
        assert values(lines.groupBy("run_id", "job_id").count()) == [(5, 6, 4000), (5, 7, 2100)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("series", "want"), [([1, 2, 3, 3, 4], [0, 1, 2, 0, 1]), ([5, 4], [0, 0]), ([None, 1, 2], [0, 0, 1]), ([], [])])
def test_rises(table, series, want):
    trend = table([(f"2026-{i:02}", float(v) if v is not None else None) for i, v in enumerate(series, 1)], "period STRING, x DOUBLE")
    got = stats.sustained_rises(trend, ("x",)).orderBy("period").collect()
    assert [r.rising_for for r in got] == want and [r.sustained for r in got] == [n >= 2 for n in want]


def test_usage_is_added_up_by_key(table):
    rows = [("a", 1, 10, 5, False, {"in": "3", "tier": "x"}), ("a", 2, 20, None, True, {"in": "4", "out": "1"}), ("b", 1, 1, 1, False, {}), ("b", 1, 1, 1, False, None)]
    got = stats.phase_totals(table(rows, "phase STRING, turns LONG, duration_ms LONG, duration_api_ms LONG, is_error BOOLEAN, usage MAP<STRING, STRING>"))
    assert {r.phase: (r.records, r.turns, r.duration_api_ms, r.errors, r.usage) for r in got.collect()} == {
        "a": (2, 3, 5, 1, {"in": 7, "out": 1}), "b": (2, 2, 2, 0, {})}


def test_staged_lines_are_small_and_whole(spark):
    lines = spark.range(20_000).select(F.to_json(F.struct("id", F.lit("success").alias("conclusion"), F.array(
        F.lit("checkout"), F.lit("build"), F.lit("test")).alias("steps"))).alias("value"))
    sizes = []

    def read(session, path):
        sizes.append(sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("part-*")))
        return session.read.text(path)

    assert values(ingest._through_files(spark, "lines", lines, read)) == values(lines)
    assert sizes[0] * 4 < sum(len(r.value) + 1 for r in lines.collect())


def test_new_document_numbers_only_long_runs(spark, table, monkeypatch):
    rows = [(i, str(run), f"u{run}", "main", "push", "s", f"job {i}", "failure", "", "", "1", "")
            for i, run in enumerate([5] * 7 + [3, 3, 4, 3, 5])]
    data = table(rows, "pos INT, " + ", ".join(f"{c} STRING" for c in FAILED_JOB_COLUMNS))
    numbered = []
    real = writers.with_position
    monkeypatch.setattr(writers, "with_position", lambda df, *a: numbered.append(values(df, "pos")) or real(df, *a))
    text = "".join(r.text for r in writers.pending_document(data, 3).orderBy("run_pos", "block_no", "part", "pos").collect())
    assert numbered == [[(i,) for i in (0, 1, 2, 3, 4, 5, 6, 11)]]
    assert [line.strip("#` ") for line in text.split("\n") if "job: `" in line] == [f"job: `job {i}" for i in (0, 1, 2, 3, 4, 5, 6, 11, 7, 8, 10, 9)]
    assert [text.count(f"BEGIN RUN {r} ") for r in (5, 3, 4)] == [3, 1, 1]
    numbered.clear()
    writers.pending_document(data, 8).collect()
    assert numbered == []


def test_positions_follow_the_files(spark, tmp_path):
    for part, n in ((2, 5), (0, 400), (1, 90)):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part}-{i:03}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = spark.read.text(str(tmp_path)).select("value", "_metadata.file_name", "_metadata.file_block_start")
        got = ordering.with_read_position(lines, [F.col("file_name"), F.col("file_block_start")], "position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.position for r in sorted(got, key=lambda r: r.value)] == list(range(1, 496))


def test_positions_of_the_new_document_store_no_rows(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        documents_of_queries.pending_document_jobs(spark, "/root/testdata/sf0.001").explain()
    assert "ExistingRDD" not in text.getvalue() and "rangepartitioning" not in text.getvalue()
