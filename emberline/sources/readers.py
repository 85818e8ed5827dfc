"""Readers for CI history kept as files. All are lazy and splittable unless noted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.text import strip
from emberline.params import FAILED_CONCLUSIONS, FAILED_JOB_COLUMNS

# Field names of the interchange files.
RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("run_url", T.StringType()),
    T.StructField("workflow", T.StringType()), T.StructField("branch", T.StringType()),
    T.StructField("event", T.StringType()), T.StructField("commit_sha", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("run_attempt", T.LongType()),
    T.StructField("conclusion", T.StringType()),
])
STEP_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("conclusion", T.StringType()),
    T.StructField("number", T.IntegerType()),
])
JOB_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("job_seq", T.LongType()),
    T.StructField("job_id", T.LongType()), T.StructField("job_name", T.StringType()),
    T.StructField("conclusion", T.StringType()), T.StructField("completed_at", T.TimestampType()),
    T.StructField("steps", T.ArrayType(STEP_SCHEMA)),
])
PHASE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("phase", T.StringType()),
    T.StructField("turns", T.LongType()), T.StructField("duration_ms", T.LongType()),
    T.StructField("duration_api_ms", T.LongType()), T.StructField("is_error", T.BooleanType()),
    T.StructField("tool_calls", T.MapType(T.StringType(), T.LongType())),
    T.StructField("usage", T.MapType(T.StringType(), T.StringType())),
])
FIX_ITEM_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("sha", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("confidence", T.StringType()),
])
FIX_SCHEMA = T.StructType([T.StructField("fixes", T.ArrayType(T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("items", T.ArrayType(FIX_ITEM_SCHEMA)),
])))])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def read_runs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, RUN_SCHEMA, fmt)


def read_jobs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Failed and cancelled jobs with their steps."""
    return read_table(spark, path, JOB_SCHEMA, fmt).where(
        F.col("conclusion").isin(*FAILED_CONCLUSIONS))


def read_phase_stats(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, PHASE_SCHEMA, fmt)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log text files named `{run}_{job}.log`, one row per line.

    Lines are numbered from the reader's order inside each split plus the line counts of the splits before
    it, added up per file, so a large log is read by many tasks. A log may also be a folder of that name
    with several files, which follow each other by name.
    """
    name = r"(\d+)_(\d+)\.log(?:/[^/]*)?$"
    path_of = F.col("_metadata.file_path")
    lines = (spark.read.text(path)
             .select("value", path_of.alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.regexp_extract(path_of, name, 1).cast("bigint").alias("run_id"),
                     F.regexp_extract(path_of, name, 2).cast("bigint").alias("job_id"),
                     F.monotonically_increasing_id().alias("tag")))
    log = ["run_id", "job_id"]
    splits = lines.groupBy(*log, "file", "block").agg(F.min("tag").alias("first"), F.count("*").alias("n"))
    # The splits of one log: bounded by its size over the size of a split.
    before = Window.partitionBy(*log).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (lines.join(numbered.drop("n", *log), ["file", "block"])
            .select(*log, (F.col("before") + F.col("tag") - F.col("first") + 1).alias("line_no"), F.col("value").alias("text")))


def read_failed_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The failed-job CSV with the place `pos` of each row: file, then row.

    Files of the older layout have no job_conclusion column. Files are read together with those of
    the same header, so columns are matched by name even if a folder holds both layouts. Every value
    is text and missing means empty. Embedded newlines are legal, so a file is read by one task;
    the writer keeps its files small.
    """
    first = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.monotonically_increasing_id().alias("n"), "value").alias("line"))
    headers = first.groupBy("file").agg(F.min("line").alias("line")).groupBy("line.value").agg(F.collect_list("file").alias("files"))
    layouts = [_failed_job_rows(spark, row.files) for row in headers.collect()]
    if not layouts:
        return spark.createDataFrame([], "pos STRUCT<file: STRING, row: LONG>, " + ", ".join(f"{c} STRING" for c in FAILED_JOB_COLUMNS))
    return reduce(DataFrame.unionByName, layouts)


def _failed_job_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    raw = spark.read.csv(files, header=True, escape='"', multiLine=True)
    default = {"job_conclusion": "failure"}

    def column(name: str):
        missing = F.lit(default.get(name, ""))
        return (F.coalesce(F.col(name), missing) if name in raw.columns else missing).alias(name)

    pos = F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"))
    return raw.select(pos.alias("pos"), *[column(name) for name in FAILED_JOB_COLUMNS])


def read_tsv(spark: SparkSession, path: str, fields: list[str], free: str, checks: dict[str, str]) -> DataFrame:
    """Lines of tab-separated fields without quoting: the fields, `raw`, `file` and the `problem` of malformed ones.

    Quotes and back-slashes are ordinary characters, so a line is always one record. Surplus tabs belong to the
    field `free`, the only one of free text. `checks` gives a pattern for each field that must have a form. `problem`
    is null for good lines; empty lines are no records.
    """
    line = F.regexp_replace("value", "\\r$", "")
    n, at, after = len(fields), fields.index(free), len(fields) - fields.index(free) - 1
    rows = spark.read.text(path, lineSep="\n").select(
        line.alias("raw"), F.split(line, "\t", -1).alias("parts"), F.col("_metadata.file_name").alias("file")).where("raw <> ''")
    size = F.size("parts")
    whole = F.array_join(F.slice("parts", F.lit(at + 1), F.greatest(size - (n - 1), F.lit(0))), "\t")
    columns = [F.try_element_at("parts", F.lit(i + 1)) if i < at else whole if i == at else
               F.try_element_at("parts", F.lit(i - at - after - 1)) for i in range(n)]
    named = rows.select("raw", "file", size.alias("n_fields"), *[c.alias(f) for f, c in zip(fields, columns, strict=True)])
    problem = F.when(F.col("n_fields") < n, "too few fields")
    for field_name, form in checks.items():
        problem = problem.when(~F.col(field_name).rlike(form), f"malformed {field_name}")
    return named.select(*fields, "raw", "file", problem.alias("problem"))


# Fixed patterns: the forms of the fields.
TSV_DATE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
COMMITS_TSV = (["sha", "author_date", "message"], "message", {"sha": "^[0-9a-f]+$", "author_date": TSV_DATE})
PULL_REQUESTS_TSV = (["number", "created", "title", "url"], "title", {"number": "^#[0-9]{1,18}$", "created": TSV_DATE, "url": "^https?://"})


def read_commits_tsv(spark: SparkSession, path: str, since: str) -> DataFrame:
    """sha, author date and subject (first line of the message) since a date; malformed lines are left out."""
    return commit_candidates(read_tsv(spark, path, *COMMITS_TSV).where("problem is null"), since)


def read_pull_requests_tsv(spark: SparkSession, path: str) -> DataFrame:
    good = read_tsv(spark, path, *PULL_REQUESTS_TSV).where("problem is null")
    return good.select(F.substring("number", 2, 18).cast("bigint").alias("number"), "created", "title", "url")


def malformed_tsv(spark: SparkSession, path: str, form: tuple) -> DataFrame:
    """The lines that the readers leave out: file, line and reason."""
    return read_tsv(spark, path, *form).where("problem is not null").select("file", "raw", "problem")


# --- JSON lines --------------------------------------------------------------------

def read_checked_json(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Records of JSON lines with `raw`, `file` and the `problem` of those that cannot be used.

    A record is unreadable if it is no JSON or a field has another type than the schema says; it lacks a key if
    one of `keys` is missing or null. `problem` is null for good records, so that both kinds come from one pass.
    """
    corrupt = "_unreadable"
    wanted = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = spark.read.text(path).where("trim(value) <> ''").select(
        F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file"), parsed.alias("record"))
    problem = F.when(F.col("record").isNull() | F.col(f"record.{corrupt}").isNotNull(), "unreadable")
    for key in keys:
        problem = problem.when(F.col(f"record.{key}").isNull(), f"no {key}")
    return rows.select(*[F.col(f"record.{f}").alias(f) for f in schema.fieldNames()], "raw", "file", problem.alias("problem"))


def good_records(checked: DataFrame) -> DataFrame:
    return checked.where("problem is null").drop("raw", "file", "problem")


def quarantined(checked: DataFrame) -> DataFrame:
    """The records that were kept apart, with their file and reason."""
    return checked.where("problem is not null").select("file", "raw", "problem")


def read_runs_json(spark: SparkSession, path: str) -> DataFrame:
    return read_checked_json(spark, path, RUN_SCHEMA, ["run_id", "conclusion"])


def read_jobs_json(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of all conclusions with their nested steps; `good_records` and a filter give the failed ones."""
    return read_checked_json(spark, path, JOB_SCHEMA, ["run_id", "job_id"])


def commit_candidates(commits: DataFrame, since: str) -> DataFrame:
    return (commits.where(F.col("author_date") >= f"{since}T00:00:00Z")
            .select("sha", "author_date", F.split("message", "\n")[0].alias("subject")))


def pull_request_candidates(pull_requests: DataFrame) -> DataFrame:
    return pull_requests.where(F.col("state") == "open").select("number", "created", "title", "url")


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """Fix correlations as (category, items); unreadable files give no rows."""
    documents = spark.read.json(path, schema=FIX_SCHEMA, multiLine=True, mode="PERMISSIVE")
    return fixes_from_documents(documents.withColumn("doc", F.col("_metadata.file_name")), order="doc")


def fixes_from_documents(documents: DataFrame, order: str) -> DataFrame:
    """Entries with a category and items; a repeated category keeps its last entry in
    document order."""
    entries = documents.select(F.col(order).alias("doc"), F.posexplode("fixes").alias("entry_no", "entry")) \
        .select(F.struct("doc", "entry_no").alias("at"), "entry.category", "entry.items")
    return (entries.where((F.col("category") != "") & (F.size("items") > 0))
            .groupBy("category").agg(F.max_by("items", "at").alias("items")))


# --- run documents -----------------------------------------------------------------

BLOCK_START = "<!-- BEGIN RUN "


def read_run_document(spark: SparkSession, path: str) -> DataFrame:
    """Run blocks of a progress document as (pos, run_id, body).

    The block opener is the record separator, so the file splits at run boundaries and no
    task has to hold the document. A block counts when the same id closes it.
    `pos` orders blocks as written: file, split, then the reader's order inside the split.
    """
    records = spark.read.text(path, lineSep=BLOCK_START).select(
        F.col("value"),
        F.struct(F.col("_metadata.file_name").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("record")).alias("pos"))
    return parse_run_records(records)


def parse_run_records(records: DataFrame) -> DataFrame:
    closed = r"(?s)^(\d+) -->(.*?)<!-- END RUN \1 -->"
    return (records.where(F.col("value").rlike(closed))
            .select("pos", F.regexp_extract("value", closed, 1).alias("run_id"),
                    F.regexp_extract("value", closed, 2).alias("body")))


def read_category_section(spark: SparkSession, path: str) -> DataFrame:
    """Lines between the first pair of category markers, with their order."""
    lines = spark.read.text(path).select(
        F.col("value"),
        F.struct(F.col("_metadata.file_name").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("record")).alias("pos"))
    opened = lines.where(F.col("value").contains("<!-- CATEGORIES START -->")) \
        .agg(F.min("pos").alias("start_pos"))
    closed = lines.where(F.col("value").contains("<!-- CATEGORIES END -->")) \
        .crossJoin(opened).where(F.col("pos") > F.col("start_pos")) \
        .agg(F.min("pos").alias("end_pos"), F.min("start_pos").alias("start_pos"))
    # The marker positions are a single aggregated row.
    return (lines.join(F.broadcast(closed),
                       (F.col("pos") > F.col("start_pos")) & (F.col("pos") < F.col("end_pos")))
            .select("pos", "value"))


def parse_descriptions(lines: DataFrame) -> DataFrame:
    """Bullets with a description; a repeated name keeps its first place and last text."""
    parts = F.split(F.col("line"), "`", 3)
    rest = strip(F.element_at("parts", 3))
    return (lines.select(strip(F.col("value")).alias("line"), "pos")
            .where(F.col("line").startswith("- `")).select("pos", parts.alias("parts"))
            .where((F.size("parts") == 3) & (F.element_at("parts", 2) != "")).where(rest.startswith("--"))
            .select("pos", F.element_at("parts", 2).alias("full_category"),
                    strip(F.substring(rest, 3, 2**31 - 1)).alias("description"))
            .groupBy("full_category")
            .agg(F.min("pos").alias("pos"), F.max_by("description", "pos").alias("description")))
