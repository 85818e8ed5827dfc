"""The report: category rows, JSON records and Markdown lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.dates import relative_date
from emberline.functions.dates import utc_epoch
from emberline.functions.links import detail_line
from emberline.functions.text import clip
from emberline.operators import correlate, rollup
from emberline.operators.ordering import with_position

GENERATOR = "emberline"
NO_FAILURES = "The selection holds no failed run."


@dataclass
class ReportParts:
    """The report as flat tables; each is complete on its own."""

    categories: DataFrame      # one row per category, numbered
    affected: DataFrame        # one row per (category, run)
    values: DataFrame          # one row per (category, kind, value): test ids, subcategories
    fixes: DataFrame           # one row per (category, fix)
    unfinished: DataFrame      # one row per run that is not done
    totals: DataFrame          # one row


def numbered(categories: DataFrame) -> DataFrame:
    """Most runs first; ties keep the category seen first in the document."""
    return with_position(categories, [F.desc("runs"), F.col("first_pos")], "number")


def build(classified: DataFrame, runs: DataFrame, descriptions: DataFrame, candidates: DataFrame) -> ReportParts:
    """Every report table from the fact table and the fix candidates.

    The report reads each of them several times, so the roll-ups are computed once and
    checkpointed; the fact table itself is never stored.
    """
    done = rollup.done_rows(classified)
    valid = rollup.valid_rows(classified)
    grain = rollup.category_runs(valid).checkpoint()
    values = rollup.category_values(valid).checkpoint()
    categories = numbered(rollup.describe(rollup.rollup(grain), descriptions))
    terms = correlate.search_terms(categories, _values(values, "test_id")).checkpoint()
    return ReportParts(
        categories=categories,
        affected=rollup.affected_runs(grain),
        values=values,
        fixes=correlate.fix_items(correlate.match(terms, categories, candidates)).checkpoint(),
        unfinished=rollup.unfinished(runs),
        totals=rollup.totals(rollup.run_verdict_rows(done)).checkpoint())


def _values(values: DataFrame, kind: str) -> DataFrame:
    return values.where(F.col("kind") == kind).select("category", F.col("value").alias(kind))


def with_counts(parts: ReportParts) -> DataFrame:
    """The categories with the number of their test ids, subcategories and fixes."""
    wide = parts.categories.join(rollup.value_counts(parts.values), "category", "left").join(
        correlate.item_counts(parts.fixes), "category", "left")
    counts = ("n_test_ids", "n_subcategories", "fixes", "matches", "possible")
    return wide.select(*parts.categories.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def json_records(parts: ReportParts, date: str) -> DataFrame:
    """The report as JSON lines, of one shape at every size.

    Parts: 0 the header, 1 one record per category with its counts, 2 to 5 one record per test id,
    subcategory, affected run and fix, named by their category, 6 one per unfinished run.
    """
    def record(df: DataFrame, part: int, number: Column, key: Column, *fields) -> DataFrame:
        return df.select(F.lit(part).alias("part"), number.cast("bigint").alias("number"), key.cast("string").alias("key"),
                         F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))

    number, name = F.col("number"), F.col("category").alias("name")
    heading = parts.categories.select("category", "number")
    values = parts.values.join(heading, "category")
    runs, fixes = parts.affected.join(heading, "category"), parts.fixes.join(heading, "category")
    ref = F.coalesce("sha", F.col("id").cast("string"))
    pieces = [
        record(parts.totals, 0, F.lit(0), F.lit(""), F.struct(F.lit(GENERATOR).alias("generated_by")).alias("metadata"),
               F.lit(date).alias("date"), "total_runs", "flake_runs", "real_failure_runs", "unclear_runs", "total_jobs"),
        record(with_counts(parts), 1, number, F.col("category"), name, "description", F.col("flake").alias("is_flake"), "runs", "jobs",
               "n_test_ids", "n_subcategories", F.col("fixes").alias("n_fixes"), "example_error", "example_summary"),
        *[record(values.where(F.col("kind") == kind), part, number, F.col("value"), name, F.col("value").alias(kind))
          for part, kind in ((2, "test_id"), (3, "subcategory"))],
        record(runs, 4, number, F.col("run_id"), name, "run_id", "run_url", "branch", "date", "run_started_at", "jobs_failed"),
        record(fixes, 5, number, F.concat_ws("-", "type", ref), name, "type", "id", "sha", "url", "title", "date", "confidence"),
        record(parts.unfinished, 6, F.col("status_rank"), F.col("run_id"), F.col("run_id").cast("string").alias("run_id"), "status", "run_url")]
    records = pieces[0]
    for piece in pieces[1:]:
        records = records.unionByName(piece)
    return records


# --- Markdown ----------------------------------------------------------------------

def _rows(df: DataFrame, section: int, block: Column, number: Column, item: int, epoch: Column,
          key: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), block.cast("int").alias("block"),
                     number.cast("bigint").alias("number"), F.lit(item).alias("item"),
                     epoch.cast("bigint").alias("rank"), key.alias("key"), line.alias("line"))


def markdown_lines(parts: ReportParts, date: str) -> DataFrame:
    """The readable report as lines; sorting by the key columns gives the document.

    Sections: 0 head, 1 table of flakes, 2 table of the rest, 3 total, 4 details (flakes
    first, numbers kept), 5 unfinished runs. Test ids, subcategories, fixes and affected runs
    are one line each at every size, so no category is ever put into one string.
    """
    zero, empty = F.lit(0), F.lit("")
    is_flake = F.col("flake") == "yes"
    # One row per category, read by several kinds of lines.
    cats = with_counts(parts).checkpoint()
    heading = cats.select("category", "number", "flake")
    number = F.col("number")

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def cells(*values: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))

    def head_of(*titles: str) -> str:
        return "| " + " | ".join(titles) + " |\n" + "|---" * len(titles) + "|"

    section = F.when(is_flake, 1).otherwise(2)
    last = relative_date(F.col("last_started_at"), F.lit(date).cast("date"))
    summary = cats.select(section.alias("section"), F.lit(1).alias("block"), "number", F.lit(0).alias("item"),
                          F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("key"), cells(
                              text("number"), F.concat(F.lit("`"), F.col("category"), F.lit("`")), text("n_subcategories"),
                              text("runs"), text("jobs"), last, text("matches"), text("possible")).alias("line"))
    titles = head_of("No.", "Root cause", "Subcategories", "Runs", "Jobs", "Last seen", "Fixes", "Possible fixes")
    # A table appears only when it has rows: one row per kind present.
    present = cats.select(section.alias("section")).distinct().select(
        "section", F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("number"), F.lit(0).alias("item"),
        F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("key"),
        F.concat(F.when(F.col("section") == 1, "\n### Flaky causes\n\n").otherwise("\n### Lasting causes\n\n"), F.lit(titles)).alias("line"))

    head = _rows(parts.totals, 0, zero, zero, 0, zero, empty, F.concat(
        F.lit(f"# Why CI runs failed\n\nAs of {date}. Failed runs: "), text("total_runs"), F.lit("; flaky "), text("flake_runs"),
        F.lit(", lasting "), text("real_failure_runs"), F.lit(", undecided "), text("unclear_runs"), F.lit(".")))
    total = _rows(parts.totals, 3, zero, zero, 0, zero, empty, F.concat(
        F.lit("\nFailed jobs: "), text("total_jobs"), F.lit(" in "), text("total_runs"), F.lit(" runs.\n\n## Causes one by one\n")))

    detail_block = F.when(is_flake, 0).otherwise(1)

    def detail(df: DataFrame, item: int, line: Column, rank: Column = zero, key: Column = empty) -> DataFrame:
        return _rows(df, 4, detail_block, number, item, rank, key, line)

    def part(condition: Column, *pieces: Column) -> Column:
        return F.when(condition, F.concat(*pieces)).otherwise("")

    opening = detail(cats, 0, F.concat(
        F.lit("### "), text("number"), F.lit(". `"), F.col("category"), F.lit("`\n"),
        part(F.col("description") != "", F.lit("\n"), F.col("description"), F.lit("\n")),
        F.lit("\n- runs: "), text("runs"), F.lit("\n- jobs: "), text("jobs")))
    values = parts.values.join(heading, "category")
    fix_rows = parts.fixes.join(heading, "category")
    fix_line = detail_line(*[F.col(c) for c in ("type", "id", "sha", "url", "date", "title")])
    epoch = utc_epoch(F.col("date"))
    age = F.when(epoch == 0, 1).otherwise(-epoch)
    ref = F.concat(F.when(F.col("type") == "commit", "0").otherwise("1"),
                   F.coalesce("sha", F.lpad(F.col("id").cast("string"), 20, "0")))
    confirmed, commit = F.col("confidence") == "match", F.col("type") == "commit"
    examples = detail(cats, 8, F.concat(
        part(F.col("example_error") != "", F.lit("- error: `"), clip(F.col("example_error"), 200, 200), F.lit("`\n")),
        part(F.col("example_summary") != "", F.lit("- summary: "), clip(F.col("example_summary"), 600, 600), F.lit("\n")),
        F.lit("\n" + head_of("Run", "Branch", "Day", "Failed jobs"))))

    def link() -> Column:
        return F.concat(F.lit("["), F.col("run_id").cast("string"), F.lit("]("), F.col("run_url"), F.lit(")"))

    run_rows = detail(parts.affected.join(heading, "category"), 9,
                      cells(link(), clip(F.col("branch"), 40, 37), F.col("date"), text("jobs_failed")), -F.col("epoch"), F.col("run_id"))
    open_runs = parts.unfinished
    pieces = [
        head, present, summary, total, opening,
        *[detail(values.where(F.col("kind") == kind), item, F.concat(F.lit(f"  - {label}: "), F.col("value")), key=F.col("value"))
          for item, kind, label in ((1, "test_id", "test"), (2, "subcategory", "subcategory"))],
        detail(cats.where("matches > 0"), 3, F.lit("- fixes:")),
        detail(fix_rows.where(confirmed & commit), 4, fix_line, age, ref),
        detail(fix_rows.where(confirmed & ~commit), 5, fix_line, age, ref),
        detail(cats.where("possible > 0"), 6, F.lit("- possible fixes:")),
        detail(fix_rows.where(~confirmed), 7, fix_line, age, ref),
        examples, run_rows, detail(heading, 10, empty),
        _rows(open_runs.agg(F.count("*").alias("n")).where(F.col("n") > 0), 5, zero, zero, 0, zero, empty,
              F.lit("## Runs without a verdict\n\n" + head_of("Run", "Status"))),
        _rows(open_runs, 5, F.lit(1), F.col("status_rank"), 0, zero, F.col("run_id").cast("string"), cells(link(), F.col("status")))]
    lines = pieces[0]
    for piece in pieces[1:]:
        lines = lines.unionByName(piece)
    return lines


def summary_text(totals: DataFrame, categories: DataFrame) -> DataFrame:
    """Two or three plain sentences: totals and the one or two most frequent root causes."""
    top = (categories.orderBy(F.desc("runs"), "first_pos").limit(2)
           .agg(F.array_sort(F.collect_list(F.struct((-F.col("runs")).alias("rank"), "first_pos", "category")))
                .alias("top")))
    phrases = F.transform("top", lambda c: F.concat(c["category"], F.lit(" ("), (-c["rank"]).cast("string"), F.lit(" runs)")))
    return totals.crossJoin(top).select(F.concat(
        F.format_string("%d failed runs analyzed: %d caused by flakes, %d by real failures",
                        "total_runs", "flake_runs", "real_failure_runs"),
        F.when(F.col("unclear_runs") > 0, F.format_string(", %d unclear", "unclear_runs")).otherwise(""),
        F.lit("."),
        F.when(F.size("top") > 0, F.concat(F.lit(" Top root causes: "), F.array_join(phrases, " and "), F.lit(".")))
         .otherwise("")).alias("summary"))


def empty_report(selected_runs: DataFrame, date: str) -> DataFrame:
    """The stub report, one row, when the selection has no failed run; else no row."""
    count = selected_runs.agg(F.count("*").alias("n")).where(F.col("n") == 0)
    zero = F.lit(0).cast("bigint")
    return count.select(F.lit(date).alias("date"), F.lit("no-failures").alias("status"),
                        F.lit(NO_FAILURES).alias("message"),
                        *[zero.alias(c) for c in ("total_runs", "flake_runs", "real_failure_runs",
                                                  "unclear_runs", "total_jobs", "categories", "unfinished_runs")])


def empty_forms(selected_runs: DataFrame, date: str, filters: dict[str, str]) -> DataFrame:
    """The stub report as text, Markdown and JSON lines (form, line_no, line); no rows if there is a failed run.

    `filters` names what the selection asked for and is repeated in Markdown and JSON. The lists of the JSON record are
    there and empty, its counts are zero.
    """
    stub = empty_report(selected_runs, date)
    counts = ("total_runs", "flake_runs", "real_failure_runs", "unclear_runs", "total_jobs")
    nothing = F.array().cast("array<string>")
    record = F.to_json(F.struct(
        "date", "status", "message", F.struct(*[F.lit(v).alias(k) for k, v in filters.items()]).alias("filters"), *counts,
        nothing.alias("categories"), nothing.alias("unfinished_runs")))
    markdown = [F.lit("# CI failure report"), F.lit(""), F.concat(F.lit("Date: "), "date"), F.lit(""), F.col("message"), F.lit(""),
                *[F.lit(f"- {name}: `{value}`") for name, value in filters.items()]]
    forms = [F.struct(F.lit(form).alias("form"), F.lit(no).alias("line_no"), line.alias("line"))
             for form, lines in (("text", [F.col("message")]), ("markdown", markdown), ("json", [record])) for no, line in enumerate(lines, 1)]
    return stub.select(F.inline(F.array(*forms)))


def write(parts: ReportParts, path: str, date: str) -> None:
    """Report folder: JSON lines, Markdown lines and the complete flat tables."""
    from emberline.sinks.writers import write_json_lines, write_report_lines

    records = json_records(parts, date)
    records.orderBy("part", "number", "key").select("record").write.text(f"{path}/report_json")
    write_report_lines(markdown_lines(parts, date), f"{path}/report_md")
    write_json_lines(parts.affected, f"{path}/affected_runs", ["category", F.desc("epoch"), "run_id"])
    for kind in ("test_id", "subcategory"):
        write_json_lines(_values(parts.values, kind), f"{path}/{kind}s", ["category", kind])
    write_json_lines(parts.fixes, f"{path}/fixes", ["category", "type", F.desc("date")])
