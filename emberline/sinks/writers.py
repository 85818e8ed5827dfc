"""Sinks: interchange CSV, run document, category section and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.ordering import with_position
from emberline.params import BLOCK_JOBS, FAILED_JOB_COLUMNS

CSV_ROWS_PER_FILE = 500_000
LINES_PER_FILE = 500_000
# Files that are made only to be read back: repeated labels and keys take a fraction of their size. A compressed file is read
# by one task, so the writers keep each file small.
STAGED = "gzip"


def write_lines(lines: DataFrame, path: str, compression: str = STAGED) -> None:
    """Lines without an order, in compressed files of a bounded number of lines."""
    lines.write.option("maxRecordsPerFile", LINES_PER_FILE).text(path, compression=compression)


def write_failed_jobs(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Newest run first, fixed column order. `rows` carries its source order in `pos`."""
    (rows.orderBy(F.desc("run_started_at"), "pos").select(*FAILED_JOB_COLUMNS)
     .write.option("maxRecordsPerFile", CSV_ROWS_PER_FILE)
     .csv(path, header=True, escape='"', mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
          compression=compression))


# --- run document ------------------------------------------------------------------

# The labels of the interchange format.
RUN_TEMPLATE = ("status", "run_url", "branch", "event", "run_started_at", "run_attempt", "commit_sha")
JOB_TEMPLATE = (
    ("job_conclusion", "job_conclusion"), ("step", "step"), ("job_id", "job_id"),
    ("category", "category"), ("is_flake", "is_flake"), ("test-id", "test_id"),
    ("failed_test", "failed_test"), ("error_message", "error_message"), ("summary", "summary"),
)


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"- **{name}**:"), F.when(value != "", F.concat(F.lit(" "), value)).otherwise(""))


def block_pieces(jobs: DataFrame) -> DataFrame:
    """Text pieces of the run blocks: (run order, block_no, part, job order, text).

    One row per piece instead of one string per run, so a run with very many jobs is never
    gathered. A block holds BLOCK_JOBS consecutive places of its run; the next ones follow in
    another block of the same id, and `run_fields` makes one run of them again. Header and
    footer come from one row per block.
    """
    numbered = jobs.withColumn("block_no", F.floor(F.col("job_seq") / BLOCK_JOBS).cast("bigint"))
    run_id = F.col("run_id").cast("string")
    heads = numbered.groupBy("run_id", "block_no").agg(
        F.min("created_at").alias("created_at"),
        F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in RUN_TEMPLATE]), "pos").alias("run"))
    opener = F.concat_ws(
        "\n", F.concat(F.lit("<!-- BEGIN RUN "), run_id, F.lit(" -->")),
        F.concat(F.lit("## run_id: "), run_id),
        *[_line(c, F.col("run")[c]) for c in RUN_TEMPLATE], F.lit(""))
    footer = F.concat(F.lit("<!-- END RUN "), run_id, F.lit(" -->\n"))
    frame = heads.select(
        "created_at", "run_id", "block_no",
        F.inline(F.array(
            F.struct(F.lit(0).alias("part"), opener.alias("text")),
            F.struct(F.lit(2).alias("part"), footer.alias("text"))))) \
        .select("*", F.lit(0).cast("bigint").alias("job_seq"), F.lit(0).cast("bigint").alias("job_key"))
    job_text = F.concat_ws(
        "\n", F.concat(F.lit("#### job: `"), F.col("job_name"), F.lit("`")),
        *[_line(label, F.col(c).cast("string")) for label, c in JOB_TEMPLATE], F.lit(""))
    sections = numbered.select("created_at", "run_id", "block_no", F.lit(1).alias("part"),
                               job_text.alias("text"), "job_seq", F.col("job_id").alias("job_key"))
    return frame.unionByName(sections)


def write_run_document(pieces: DataFrame, path: str, compression: str = "none") -> None:
    """Newest run first; a block is never split over two files."""
    order = [F.desc("created_at"), F.col("run_id"), F.col("block_no")]
    (pieces.repartitionByRange(*order)
     .sortWithinPartitions(*order, "part", "job_seq", "job_key")
     .select("text").write.text(path, compression=compression))


HEAD = ("# CI Failure Classification Progress", "", "## Categories So Far", "<!-- CATEGORIES START -->", "(none yet)",
        "<!-- CATEGORIES END -->", "", "---", "")


def pending_document(rows: DataFrame, block_jobs: int = BLOCK_JOBS) -> DataFrame:
    """The whole new document for rows of the failed-job file: (run_pos, block_no, part, pos, text).

    Runs stand in the order of their first row and their jobs in the order of the rows, which are at `pos`; the
    fields of a run come from its first row. Every run is pending and the results of its jobs are empty. The
    head and the empty category list are one row before all others. A run of more than `block_jobs` jobs has
    several blocks in a row, which `run_fields` makes one run of again. Only rows of such runs are numbered:
    the others have one block, whose jobs are sorted by `pos` when it is written.
    """
    fields = [c for c in RUN_TEMPLATE if c != "status"]
    # one row a run; read for the frames, for the places of the jobs and to find the long runs
    runs = (rows.where(F.col("run_id").isNotNull()).groupBy("run_id")
            .agg(F.min(F.struct("pos", *fields)).alias("first"), F.count("*").alias("jobs"))
            .select("run_id", F.col("first.pos").alias("run_pos"), F.struct(*[f"first.{c}" for c in fields]).alias("run"), "jobs").checkpoint())
    blocks = F.floor((F.col("jobs") - 1) / block_jobs).cast("bigint")
    ends = runs.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks)))
    numbered = _in_blocks(rows, runs.where(F.col("jobs") > block_jobs).select("run_id"), block_jobs)
    opener = F.concat_ws(
        "\n", F.concat(F.lit("<!-- BEGIN RUN "), "run_id", F.lit(" -->")), F.concat(F.lit("## run_id: "), "run_id"),
        _line("status", F.lit("pending")), *[_line(c, F.col("run")[c]) for c in fields], F.lit(""))
    footer = F.concat(F.lit("<!-- END RUN "), "run_id", F.lit(" -->\n"))
    none = F.lit(None).cast(rows.schema["pos"].dataType).alias("pos")
    frame = ends.select("run_pos", "block_no", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), none, opener.alias("text")), F.struct(F.lit(2).alias("part"), none, footer.alias("text")))))
    known = {"job_conclusion": F.col("job_conclusion"), "step": F.col("failure_step")}
    section = F.concat_ws("\n", F.concat(F.lit("#### job: `"), "failed_job_name", F.lit("`")),
                          *[_line(label, known.get(c, F.lit(""))) for label, c in JOB_TEMPLATE], F.lit(""))
    # the place of a run is one row a run; Spark splits the partitions of a run with very many jobs
    sections = numbered.join(runs.select("run_id", "run_pos"), "run_id").select(
        "run_pos", "block_no", F.lit(1).alias("part"), "pos", section.alias("text"))
    first = rows.sparkSession.range(1).select(
        F.lit(None).cast(frame.schema["run_pos"].dataType).alias("run_pos"), F.lit(0).cast("bigint").alias("block_no"),
        F.lit(0).alias("part"), none, F.lit("\n".join(HEAD)).alias("text"))
    return first.unionByName(frame).unionByName(sections)


def _in_blocks(rows: DataFrame, long: DataFrame, block_jobs: int) -> DataFrame:
    """Rows with the number of their block: 0 unless their run is one of the `long` ones."""
    whole = F.lit(0).cast("bigint")
    if long.isEmpty():
        return rows.withColumn("block_no", whole)
    few = F.broadcast(long)  # at most one run in `block_jobs` rows
    numbered = with_position(rows.join(few, "run_id", "left_semi"), [F.col("pos")], "job_no", ["run_id"])
    return rows.join(few, "run_id", "left_anti").withColumn("block_no", whole).unionByName(
        numbered.withColumn("block_no", F.floor((F.col("job_no") - 1) / block_jobs).cast("bigint")).drop("job_no"))


def write_pending_document(pieces: DataFrame, path: str, compression: str = "none") -> None:
    """The head, then the blocks in order; a block is never split over two files."""
    order = [F.col("run_pos").asc_nulls_first(), F.col("block_no")]
    (pieces.repartitionByRange(*order).sortWithinPartitions(*order, "part", "pos").select("text")
     .write.text(path, compression=compression))


def category_lines(categories: DataFrame) -> DataFrame:
    """The category section, one line per category between its two markers."""
    bullet = F.concat(F.lit("- `"), F.col("category"), F.lit("`"),
                      F.when(F.col("description") != "", F.concat(F.lit(" -- "), F.col("description")))
                       .otherwise(""))
    def marker(part: int, text: str):
        return F.struct(F.lit(part).alias("part"), F.lit("").alias("category"), F.lit(text).alias("line"))

    frame = categories.sparkSession.range(1).select(F.inline(F.array(
        marker(0, "<!-- CATEGORIES START -->"), marker(2, "<!-- CATEGORIES END -->"))))
    return frame.unionByName(categories.select(F.lit(1).alias("part"), "category", bullet.alias("line")))


def write_category_section(categories: DataFrame, path: str) -> None:
    category_lines(categories).orderBy("part", "category").select("line").write.text(path)


# --- report ------------------------------------------------------------------------

def write_json_lines(rows: DataFrame, path: str, order: list) -> None:
    rows.orderBy(*order).write.option("ignoreNullFields", "false").json(path, mode="overwrite")


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Markdown lines in report order; part files concatenate to the document."""
    keys = [c for c in lines.columns if c != "line"]
    lines.orderBy(*keys).select("line").write.text(path)
