import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tablewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a int, b string", rows, parts) with rows spread over partitions."""

    def make(schema, rows, parts=1):
        df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        return df.repartition(parts) if parts > 1 else df.coalesce(1)

    return make


def values(df, *order):
    """Rows as tuples, in the order of the given columns (or of all)."""
    rows = df.orderBy(*order).collect() if order else sorted(df.collect(), key=lambda r: tuple(map(str, r)))
    return [tuple(r) for r in rows]
