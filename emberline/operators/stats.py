"""Execution statistics of the analysis and their trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ordering import with_position
from emberline.operators.quantiles import distributions, one_decimal


def phase_stats(events: DataFrame) -> DataFrame:
    """One row per (run, phase) from event-grain records."""
    return events.groupBy("run_id", "phase").agg(
        F.sum("turns").alias("turns"), F.sum("duration_ms").alias("duration_ms"),
        F.bool_or("is_error").alias("is_error"), F.count("*").alias("calls"))


def tool_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "phase", "tool").agg(
        F.count("*").alias("calls"), F.min("event_id").alias("first_event"))


def phase_tool_maps(events: DataFrame) -> DataFrame:
    """Calls by tool name per phase; a map holds as many entries as there are tools."""
    entries = F.array_sort(F.collect_list(F.struct("tool", "calls")))
    return (tool_counts(events).groupBy("run_id", "phase")
            .agg(F.map_from_entries(entries).alias("tool_calls")))


def merged_tools(tools: DataFrame) -> DataFrame:
    """Calls per tool over all phases, most frequent first, ties first-seen.

    `tools`: (tool, calls, first_event), for instance an exploded map of calls.
    """
    merged = tools.groupBy("tool").agg(F.sum("calls").alias("calls"), F.min("first_event").alias("first_event"))
    return with_position(merged, [F.desc("calls"), F.col("first_event")], "position").drop("first_event")


def turn_distributions(phases: DataFrame) -> DataFrame:
    return distributions(phases.select(F.concat("phase", F.lit(".turns")).alias("metric"), "turns"),
                         "metric", "turns")


METRICS = ["classify.turns", "classify.duration_ms", "recheck.turns", "recheck.duration_ms"]


def classifier_metrics(phases: DataFrame) -> DataFrame:
    """The four distributions of the summary; zeros mean the phase did not run.

    Every metric has a row: nothing measured is all zeros.
    """
    values = phases.select("phase", F.inline(F.array(
        F.struct(F.lit(".turns").alias("what"), F.col("turns").alias("value")),
        F.struct(F.lit(".duration_ms").alias("what"), F.col("duration_ms").alias("value"))))) \
        .select(F.concat("phase", "what").alias("metric"), "value").where(F.col("value") != 0)
    measured = distributions(values, "metric", "value")
    names = phases.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    return names.join(measured, "metric", "left").select(
        "metric", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("min", "max")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg", "median")])


def agent_totals(phases: DataFrame) -> DataFrame:
    """Number of agents and of those with an error in either phase (one row)."""
    return (phases.groupBy("run_id").agg(F.bool_or("is_error").alias("failed"))
            .agg(F.count("*").alias("agents"), F.count_if("failed").alias("errors")))


def classifier_summary(phases: DataFrame) -> DataFrame:
    # agent_totals is a single aggregated row.
    return classifier_metrics(phases).join(F.broadcast(agent_totals(phases)))


def execution_stats(phases: DataFrame, events: DataFrame, model: str, version: str,
                    correlator: DataFrame | None = None, summarizer: DataFrame | None = None) -> DataFrame:
    """One nested row: summary of the classifiers, optional other phases (null if absent).

    Four metric rows, one row per tool and one row per optional phase go into it.
    """
    def one(metric: str, what: str):
        return F.max(F.when(F.col("metric") == metric, F.col(what))).alias(what)

    def dist(metric: str):
        return F.struct(*[one(metric, w) for w in ("min", "max", "avg", "median")])

    metrics = classifier_metrics(phases).agg(
        F.struct(dist(METRICS[0]).alias("turns"), dist(METRICS[1]).alias("duration_ms")).alias("classify_phase"),
        F.struct(dist(METRICS[2]).alias("turns"), dist(METRICS[3]).alias("duration_ms")).alias("recheck_phase"))
    merged = tool_counts(events).groupBy("tool").agg(F.sum("calls").alias("calls"), F.min("first_event").alias("seen"))
    tools = merged.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("rank"), "seen", "tool"))).alias("t")) \
        .select(F.map_from_entries(F.transform("t", lambda e: F.struct(e["tool"], -e["rank"]))).alias("tool_calls"))
    row = agent_totals(phases).crossJoin(metrics).crossJoin(tools).select(
        F.lit(model).alias("model"), F.lit(version).alias("engine_version"),
        F.struct("agents", "errors", "classify_phase", "recheck_phase", "tool_calls").alias("classifier_agents"))
    for name, phase in (("correlator_agent", correlator), ("summarizer_agent", summarizer)):
        if phase is None:
            row = row.withColumn(name, F.lit(None).cast("string"))
        else:
            row = row.crossJoin(phase.agg(F.first(F.struct(*phase.columns)).alias(name)))
    return row


def with_execution_stats(report: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the statistics to the one-row report header, replacing earlier ones."""
    nested = stats.select(F.struct(*stats.columns).alias("execution_stats"))
    return report.drop("execution_stats").crossJoin(nested)


def quality_signals(phases: DataFrame, verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """Error rate of the agents in percent, unclear and unfinished runs (one row)."""
    unclear = verdicts.agg(F.count_if(F.col("verdict") == "unclear").alias("unclear_runs"))
    open_runs = runs.agg(F.count_if(F.col("status").isin("pending", "error")).alias("unfinished_runs"))
    return (agent_totals(phases).crossJoin(unclear).crossJoin(open_runs)
            .select("agents", "errors", one_decimal(F.col("errors") * 100, F.col("agents")).alias("error_rate"),
                    "unclear_runs", "unfinished_runs"))


TREND = ("unclear_runs", "unfinished_runs", "agent_error_rate", "turns")


def quality_trend(run_rows: DataFrame, verdicts: DataFrame, phases: DataFrame, periods: int) -> DataFrame:
    """Per month the unclear and unfinished runs, the share of analysed runs whose agent failed
    in any phase and the turns taken; each with its change to the month before and its average
    over up to `periods` months before. The window sees one row per month."""
    agents = phases.groupBy("run_id").agg(F.bool_or("is_error").alias("agent_failed"), F.sum("turns").alias("turns"))
    monthly = (run_rows.join(verdicts.select("run_id", "verdict"), "run_id", "left").join(agents, "run_id", "left")
               .groupBy(F.date_format("created_at", "yyyy-MM").alias("period"))
               .agg(F.count("*").alias("runs"),
                    F.count_if(F.col("verdict") == "unclear").alias("unclear_runs"),
                    F.count_if(F.col("status").isin("pending", "error")).alias("unfinished_runs"),
                    F.count("agent_failed").alias("agents"), F.count_if("agent_failed").alias("errors"),
                    F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))
               .withColumn("agent_error_rate", one_decimal(F.col("errors") * 100, F.col("agents"))).drop("errors"))
    ordered = Window.orderBy("period")
    before = ordered.rowsBetween(-periods, -1)
    # tenths, so that the averages are taken over whole numbers
    tenths = {c: F.round(F.col(c) * 10).cast("bigint") for c in TREND}
    return monthly.select(
        "period", "runs", "agents", *TREND,
        *[F.round(F.col(c) - F.lag(c).over(ordered), 1).alias(f"{c}_change") for c in TREND],
        *[one_decimal(F.sum(tenths[c]).over(before), F.count(c).over(before) * 10).alias(f"{c}_before") for c in TREND])


def sustained_rises(trend: DataFrame, signals: tuple[str, ...] = TREND, least: int = 2) -> DataFrame:
    """Per period and signal the number of periods that it has risen without a break, and whether that is sustained.

    Gaps and islands over the rows of the trend, one a period: every period in which a signal does not rise
    begins a new island. A rise of `least` periods or more counts as sustained.
    """
    # one row for each period and signal
    long = trend.select("period", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"))
                                                     for s in signals])))
    ordered = Window.partitionBy("signal").orderBy("period")
    rises = F.coalesce(F.col("value") > F.lag("value").over(ordered), F.lit(False))
    islands = long.withColumn("rises", rises).withColumn("island", F.sum(F.when(F.col("rises"), 0).otherwise(1)).over(ordered))
    length = F.count("*").over(Window.partitionBy("signal", "island").orderBy("period")) - 1
    return islands.select("period", "signal", "value", length.alias("rising_for")).withColumn(
        "sustained", F.col("rising_for") >= least)


def merged_maps(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per group one map: the values of each map key added up. Entries meet by (group, key), combined before the
    shuffle, so that a map of many keys or a group of many rows is never in one task as a whole."""
    entries = rows.select(*keys, F.explode(column).alias("key", "value"))
    summed = entries.groupBy(*keys, "key").agg(F.sum("value").alias("value"))
    maps = summed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(column))
    return rows.select(*keys).distinct().join(maps, keys, "left").withColumn(
        column, F.coalesce(column, F.create_map().cast(maps.schema[column].dataType)))


def phase_totals(records: DataFrame) -> DataFrame:
    """Per phase the records, turns, both durations, errors and the usage counters of all its records.

    Usage entries that are no whole numbers are no counters and are left out.
    """
    counters = F.map_filter(F.transform_values("usage", lambda _, v: v.try_cast("bigint")), lambda _, v: v.isNotNull())
    records = records.withColumn("usage", counters)
    totals = records.groupBy("phase").agg(
        F.count("*").alias("records"), F.sum("turns").alias("turns"), F.sum("duration_ms").alias("duration_ms"),
        F.sum("duration_api_ms").alias("duration_api_ms"), F.count_if("is_error").alias("errors"))
    return totals.join(merged_maps(records, ["phase"], "usage"), "phase")
