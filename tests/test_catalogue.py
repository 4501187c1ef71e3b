"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", None) in ("i", "u", "f"):
        return float(v)
    return pd.Timestamp(v) if hasattr(v, "isoformat") else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert rows(got) == rows(duck.execute(sql).df())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
