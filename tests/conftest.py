import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from emberline.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    yield prepare(session)
    session.stop()


@pytest.fixture
def table(spark):
    """A small table from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
