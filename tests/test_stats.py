import random
import statistics

import pytest
from helpers import values
from pyspark.sql import functions as F

from emberline.operators import ordering, stats
from emberline.operators.quantiles import distributions

PHASE = "run_id LONG, phase STRING, turns LONG, duration_ms LONG, is_error BOOLEAN, calls LONG"


@pytest.mark.parametrize("numbers", [[5], [1, 2], [3, 1, 2], [7, 7, 7, 1], [10**9, 1, 65536, 65535], [0, 0, 5]])
def test_distribution(table, numbers):
    got = distributions(table([("m", n) for n in numbers], "metric STRING, v LONG"), "metric", "v").collect()[0]
    assert (got["min"], got["max"], got["median"]) == (min(numbers), max(numbers), statistics.median(numbers))
    assert abs(got["avg"] - sum(numbers) / len(numbers)) <= 0.05 + 1e-9


def test_distribution_of_many_values(table):
    rng = random.Random(1)
    numbers = [rng.randint(0, 10**7) for _ in range(3001)] + [5_000_000] * 1500
    got = distributions(table([("m", n) for n in numbers], "metric STRING, v LONG"), "metric", "v").collect()[0]
    assert got["median"] == statistics.median(numbers)


def test_summary_skips_zeros_and_fills_missing_metrics(table):
    phases = table([(1, "classify", 4, 100, False, 1), (1, "recheck", 0, 0, True, 1), (2, "classify", 0, 300, False, 1)], PHASE)
    got = {r.metric: r for r in stats.classifier_summary(phases).collect()}
    assert (got["classify.turns"]["min"], got["classify.turns"]["avg"]) == (4, 4.0)
    assert (got["classify.duration_ms"]["median"], got["classify.duration_ms"]["max"]) == (200.0, 300)
    assert (got["recheck.turns"]["max"], got["recheck.turns"]["avg"]) == (0, 0.0)
    assert (got["recheck.turns"].agents, got["recheck.turns"].errors) == (2, 1)


def test_tools_are_ranked_by_calls_then_first_seen(table):
    tools = table([("b", 2, 5), ("a", 2, 7), ("c", 3, 9), ("b", 1, 1), ("a", 1, 2)], "tool STRING, calls LONG, first_event LONG")
    assert [tuple(r) for r in stats.merged_tools(tools).orderBy("position").collect()] == [("b", 3, 1), ("a", 3, 2), ("c", 3, 3)]


def test_optional_phases_and_overwrite(table):
    phases = table([(1, "classify", 4, 100, False, 1)], PHASE)
    events = table([(1, "classify", "Read", 1)], "run_id LONG, phase STRING, tool STRING, event_id LONG")
    one = stats.execution_stats(phases, events, "m", "1", correlator=phases.select("turns", "duration_ms"))
    row = one.collect()[0]
    assert row.correlator_agent.turns == 4 and row.summarizer_agent is None
    assert row.classifier_agents.tool_calls == {"Read": 1}
    merged = stats.with_execution_stats(stats.with_execution_stats(table([(1,)], "total_runs INT"), one), one)
    assert merged.columns == ["total_runs", "execution_stats"] and merged.count() == 1


def test_no_agents_has_no_error_rate(table):
    empty = table([], PHASE)
    row = stats.quality_signals(empty, table([], "run_id LONG, verdict STRING"), table([], "run_id LONG, status STRING")).collect()[0]
    assert (row.agents, row.error_rate, row.unclear_runs) == (0, 0.0, 0)


def test_positions_with_a_hot_group(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))).alias("g"),
                                    F.hash("id").alias("k"), "id")
    got = ordering.with_position(rows, [F.desc("k"), F.col("id")], "position", ["g"])
    groups = {}
    for r in got.collect():
        groups.setdefault(r.g, []).append((-r.k, r.id, r.position))
    assert sum(map(len, groups.values())) == 9000
    for members in groups.values():
        assert [m[2] for m in sorted(members)] == list(range(1, len(members) + 1))
    overall = ordering.with_position(rows, [F.col("k"), F.col("id")], "position").orderBy("position").collect()
    assert [r.position for r in overall] == list(range(1, 9001))
    assert [(r.k, r.id) for r in overall] == sorted((r.k, r.id) for r in overall)
