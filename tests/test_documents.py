import contextlib
import io
from pathlib import Path
from urllib.parse import unquote, urlparse

from helpers import values
from pyspark.sql import functions as F

from emberline.operators import history
from emberline.plans import documents as plans
from emberline.plans.inputs import failed_jobs
from emberline.sinks import writers
from emberline.sources import adapter, documents, readers

SF = "/root/testdata/sf0.001"

DOCUMENT = """# head
<!-- CATEGORIES START -->
- `bug/a` -- first
- `bug/b`
- `bug/c` -- see `x` -- y
- `bug/a` -- second
<!-- CATEGORIES END -->
- `bug/outside` -- no

<!-- BEGIN RUN 7 -->
## run_id: 7
- **status**: done
- **branch**: main

#### job: `one`
- **step**: build
- **category**:
- **is_flake**: yes
- **test-id**: T1, T2
- **error_message**: path C:\\temp `x` $1

#### job: `two`
- **category**: bug/x
- **summary**:
<!-- END RUN 7 -->

<!-- BEGIN RUN 8 -->
- **status**: pending
<!-- BEGIN RUN 9 -->
- **status**: error
<!-- END RUN 9 -->
<!-- BEGIN RUN 7 -->
- **status**: classified
#### job: `three`
- **category**: bug/y
<!-- END RUN 7 -->
"""


def test_blocks_and_jobs_of_a_document(spark, tmp_path):
    (tmp_path / "doc.md").write_text(DOCUMENT)
    blocks = readers.read_run_document(spark, str(tmp_path / "doc.md"))
    fields = documents.run_fields(blocks).orderBy("pos").collect()
    assert [(r.run_id, r.status, r.branch) for r in fields] == [("7", "done", "main"), ("9", "error", "")]
    jobs = documents.job_rows(blocks).orderBy("pos").collect()
    assert [(j.run_id, j.job_name, j.category, j.is_flake, j.test_id) for j in jobs] == [
        ("7", "one", "", "yes", "T1, T2"), ("7", "two", "bug/x", "", ""), ("7", "three", "bug/y", "", "")]
    assert jobs[0].error_message == "path C:\\temp `x` $1"


def test_category_section(spark, tmp_path):
    (tmp_path / "doc.md").write_text(DOCUMENT)
    lines = readers.read_category_section(spark, str(tmp_path / "doc.md"))
    got = readers.parse_descriptions(lines).orderBy("pos").collect()
    assert [(r.full_category, r.description) for r in got] == [("bug/a", "second"), ("bug/c", "see `x` -- y")]


def test_text_without_blocks(spark, tmp_path):
    (tmp_path / "doc.md").write_text("nothing here\n")
    assert readers.read_run_document(spark, str(tmp_path / "doc.md")).count() == 0


def test_a_large_run_is_split_and_read_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "BLOCK_JOBS", 2)
    rows = plans._block_input(spark, SF)
    pieces = writers.block_pieces(rows)
    assert pieces.where("part = 1").groupBy("run_id", "block_no").count().count() > rows.select("run_id").distinct().count()
    writers.write_run_document(pieces, str(tmp_path / "doc"))
    back = documents.job_rows(readers.read_run_document(spark, str(tmp_path / "doc")))
    assert values(back, "run_id", "job_id", "category") == values(
        rows.select(F.col("run_id").cast("string"), F.col("job_id").cast("string"), "category"))


def test_block_size_changes_neither_runs_nor_job_order(spark, tmp_path, monkeypatch):
    base = plans._block_input(spark, SF).limit(1)
    rows = base.drop("job_seq", "job_id").crossJoin(spark.range(10_002).select(F.col("id").alias("job_seq"), F.col("id").alias("job_id")))
    found = []
    for size in (10_000, 7):
        monkeypatch.setattr(writers, "BLOCK_JOBS", size)
        path = str(tmp_path / f"doc{size}")
        writers.write_run_document(writers.block_pieces(rows), path)
        blocks = readers.read_run_document(spark, path)
        jobs = [int(r.job_id) for r in documents.job_rows(blocks).orderBy("pos").select("job_id").collect()]
        assert jobs == list(range(10_002)) and blocks.count() > 1
        found.append(values(documents.run_fields(blocks).drop("pos")))
    assert found[0] == found[1] and len(found[0]) == 1


def test_document_order_survives_many_splits(spark, tmp_path):
    rows = plans._block_input(spark, SF)
    writers.write_run_document(writers.block_pieces(rows), str(tmp_path / "doc"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        blocks = readers.read_run_document(spark, str(tmp_path / "doc"))
        assert blocks.rdd.getNumPartitions() > 8
        got = [r.run_id for r in blocks.orderBy("pos").select("run_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [str(r.run_id) for r in rows.select("run_id", "created_at").distinct()
                .orderBy(F.desc("created_at"), "run_id").collect()]
    assert got == expected


def test_csv_quoting_old_layout_and_order(spark, tmp_path):
    fact = history.failed_jobs(adapter.runs(spark, SF), adapter.jobs(spark, SF)) \
        .withColumn("failed_job_name", F.lit('say "hi",\nthen go')).withColumn("pos", F.struct("run_id", "job_seq", "job_id"))
    writers.write_failed_jobs(fact, str(tmp_path / "csv"))
    back = readers.read_failed_jobs(spark, str(tmp_path / "csv"))
    assert back.count() == fact.count()
    assert values(back.select("failed_job_name").distinct()) == [('say "hi",\nthen go',)]
    stamps = [r[0] for r in back.orderBy("pos").select("run_started_at").collect()]
    assert stamps == sorted(stamps, reverse=True)
    old = ("run_id,run_url,branch,event,commit_sha,failed_job_name,run_started_at,job_completed_at,run_attempt,failure_step\n"
           "1,u,main,push,s,a,2026-02-18T00:00:00Z,,1,\n")
    (tmp_path / "old.csv").write_text(old)
    row = readers.read_failed_jobs(spark, str(tmp_path / "old.csv")).collect()[0]
    assert (row.job_conclusion, row.failure_step, row.job_completed_at) == ("failure", "", "")


def test_csv_layouts_in_one_folder_and_blanks(spark, tmp_path):
    folder = tmp_path / "both"
    folder.mkdir()
    (folder / "a.csv").write_text("run_id,run_url,branch,event,commit_sha,failed_job_name,run_started_at,job_completed_at,run_attempt,failure_step\n"
                                  "1,u,main,push,s,a,2026-02-18T00:00:00Z,,1,old step\n")
    (folder / "b.csv").write_text("run_id,run_url,branch,event,commit_sha,failed_job_name,job_conclusion,run_started_at,job_completed_at,"
                                  "run_attempt,failure_step\n2,u,main,push,s,  b  ,cancelled,2026-02-19T00:00:00Z,,1,new step\n")
    back = readers.read_failed_jobs(spark, str(folder))
    assert values(back, "run_id", "failed_job_name", "job_conclusion", "run_started_at", "failure_step") == [
        ("1", "a", "failure", "2026-02-18T00:00:00Z", "old step"), ("2", "  b  ", "cancelled", "2026-02-19T00:00:00Z", "new step")]
    writers.write_failed_jobs(back, str(tmp_path / "again"))
    again = readers.read_failed_jobs(spark, str(tmp_path / "again")).orderBy("pos")
    assert [(r.run_id, r.failed_job_name) for r in again.collect()] == [("2", "  b  "), ("1", "a")]


def test_logs_are_numbered_across_splits(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for run_id, job_id, n in ((1, 11, 500), (1, 12, 3), (2, 21, 40)):
        (logs / f"{run_id}_{job_id}.log").write_text("\n".join(f"line {i}" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = readers.read_logs(spark, str(logs)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(lines) == 543
    assert all(r.text == f"line {r.line_no}" for r in lines)
    assert {(r.run_id, r.job_id) for r in lines} == {(1, 11), (1, 12), (2, 21)}


def test_tsv_candidates_and_fixes(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("aaa\t2026-02-18T00:00:00Z\tFix it\nbbb\t2026-01-01T00:00:00Z\tOld\n")
    assert values(readers.read_commits_tsv(spark, str(tmp_path / "c.tsv"), "2026-02-01")) == [("aaa", "2026-02-18T00:00:00Z", "Fix it")]
    (tmp_path / "p.tsv").write_text("#12\t2026-02-18T00:00:00Z\tTitle\thttp://x\n")
    assert values(readers.read_pull_requests_tsv(spark, str(tmp_path / "p.tsv"))) == [(12, "2026-02-18T00:00:00Z", "Title", "http://x")]
    (tmp_path / "fixes.json").write_text(
        '{"fixes": [{"category": "bug/a", "items": [{"type": "pr", "id": 1}]}, {"category": "bug/b"}, '
        '{"items": [{"type": "pr", "id": 2}]}, {"category": "bug/a", "items": [{"type": "pr", "id": 3}]}]}')
    fixes = readers.read_fixes(spark, str(tmp_path / "fixes.json"))
    assert values(fixes.select("category", F.inline("items")).select("category", "id")) == [("bug/a", 3)]
    (tmp_path / "bad.json").write_text('{"fixes": [{"cat')
    assert readers.read_fixes(spark, str(tmp_path / "bad.json")).count() == 0


def test_documents_of_queries_are_written_small(spark):
    blocks = plans._written_blocks(spark, SF)
    sizes = [Path(unquote(urlparse(f).path)).stat().st_size for f in blocks.inputFiles()]
    rows = plans._block_input(spark, SF)
    assert sum(sizes) * 3 < writers.block_pieces(rows).agg(F.sum(F.length("text"))).first()[0]
    assert documents.job_rows(blocks).count() == rows.count()


def test_steps_and_texts_do_not_travel_through_joins(spark):
    for frame in (adapter.classified(spark, SF), failed_jobs(spark, SF)):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            frame.explain()
        before_join = text.getvalue().split("Join", 1)[1]
        assert "AS steps" not in before_join and "error in" not in before_join and " failed on " not in before_join
