"""Every registered query against its DuckDB oracle on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracles import TABLES, family, oracle_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_of_the_core_has_an_oracle():
    assert {name for name in QUERIES if not name.startswith("op") and name != "pipeline"} <= set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    names, kinds, expected = oracle_rows(duck, ORACLES[name])
    assert columns == names
    assert {f.name: family(f.dataType.simpleString()) for f in frame.schema} == kinds
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == expected
