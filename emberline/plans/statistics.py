"""Execution statistics and report outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import params
from emberline.operators import history, report, rollup, stats
from emberline.plans import inputs
from emberline.session import staging
from emberline.sources import adapter, readers


def phase_stats(spark, sf):
    return inputs.phases(spark, sf)


def phase_tool_counts(spark, sf):
    maps = stats.phase_tool_maps(adapter.phase_events(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("tool_calls")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("run_id", "phase", F.array_join(pairs, ",").alias("tool_calls"))


def tool_calls(spark, sf):
    return stats.merged_tools(stats.tool_counts(adapter.phase_events(spark, sf)))


def turn_distribution(spark, sf):
    return stats.turn_distributions(inputs.phases(spark, sf))


def classifier_summary(spark, sf):
    return stats.classifier_summary(inputs.phases(spark, sf))


def execution_stats(spark, sf):
    events = adapter.phase_events(spark, sf)
    nested = stats.execution_stats(stats.phase_stats(events), events, "none", "1")
    header = rollup.totals(inputs.verdicts(spark, sf)).select("total_runs", "flake_runs")
    merged = stats.with_execution_stats(header, nested)
    return merged.select("total_runs", "flake_runs", F.to_json("execution_stats").alias("execution_stats"))


def quality_signals(spark, sf):
    return stats.quality_signals(inputs.phases(spark, sf), inputs.verdicts(spark, sf), inputs.failed_runs(spark, sf))


def quality_trend(spark, sf):
    return stats.quality_trend(inputs.failed_runs(spark, sf), inputs.verdicts(spark, sf), inputs.phases(spark, sf), 3)


def quality_rises(spark, sf):
    return stats.sustained_rises(quality_trend(spark, sf))


def _phase_totals(spark, sf):
    """Totals of the phases from their records in files."""
    with staging(spark, "phases") as path:
        adapter.phase_records(spark, sf).write.text(path)
        return stats.phase_totals(readers.read_phase_stats(spark, path)).checkpoint()


def phase_usage(spark, sf):
    pairs = F.transform(F.array_sort(F.map_entries("usage")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _phase_totals(spark, sf).withColumn("usage", F.array_join(pairs, ","))


def execution_stats_phases(spark, sf):
    """Execution statistics with both optional phases filled."""
    totals, events = _phase_totals(spark, sf), adapter.phase_events(spark, sf)
    optional = [totals.where(F.col("phase") == name).drop("phase") for name in ("correlate", "summarize")]
    nested = stats.execution_stats(stats.phase_stats(events), events, "none", "1", *optional)
    return nested.select("classifier_agents.agents", *[F.to_json(c).alias(c) for c in ("correlator_agent", "summarizer_agent")])


def _parts(spark, sf):
    classified = adapter.classified(spark, sf)
    listed = rollup.category_list(classified).where(F.col("description") != "")
    descriptions = listed.select(F.col("category").alias("full_category"), F.col("category").alias("pos"), "description")
    return report.build(classified, inputs.failed_runs(spark, sf), descriptions, inputs.candidates(spark, sf))


def report_json(spark, sf):
    return report.json_records(_parts(spark, sf), params.REFERENCE_DATE)


def report_md_rows(spark, sf):
    return report.markdown_lines(_parts(spark, sf), params.REFERENCE_DATE)


def summary_text(spark, sf):
    return report.summary_text(rollup.totals(inputs.verdicts(spark, sf)), inputs.categories(spark, sf))


def empty_report(spark, sf):
    """A look-back that starts after the last run selects nothing."""
    later = history.since(inputs.failed_runs(spark, sf), "2031-01-01")
    return report.empty_report(later, params.REFERENCE_DATE)


def empty_report_forms(spark, sf):
    later = history.since(inputs.failed_runs(spark, sf), "2031-01-01")
    return report.empty_forms(later, params.REFERENCE_DATE, {
        "repository": params.REPOSITORY, "branch": ",".join(params.BRANCHES), "workflow": "*", "lookback_days": str(params.LOOKBACK_DAYS)})


QUERIES = {
    "empty_report_forms": empty_report_forms,
    "phase_stats": phase_stats, "phase_tool_counts": phase_tool_counts, "tool_calls": tool_calls,
    "turn_distribution": turn_distribution, "classifier_summary": classifier_summary,
    "execution_stats": execution_stats, "quality_signals": quality_signals, "quality_trend": quality_trend,
    "quality_rises": quality_rises, "phase_usage": phase_usage, "execution_stats_phases": execution_stats_phases,
    "report_json": report_json, "report_md_rows": report_md_rows, "summary_text": summary_text,
    "empty_report": empty_report,
}
