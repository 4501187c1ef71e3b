"""Shapes of physical plans: what is shuffled, pushed down and kept on the JVM."""

import re

import pytest
from pyspark.sql import functions as F

import catalogue
import tablewright as tw
from tablewright.functions import dates, numbers, text
from tablewright.operators import combine

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_dedupe_limits_rows_before_the_shuffle(spark):
    plan = plan_of(tw.dedupe(read(spark, "events"), ["user_id"], "first", ["event_id"]))
    below = plan[plan.index("Exchange"):]
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in below
    none = plan_of(tw.dedupe(read(spark, "events"), ["user_id"], "none"))
    assert none.count("Exchange") == 1 and "WindowGroupLimit" in none[none.index("Exchange"):]


def test_whole_row_dedupe_is_a_partial_aggregate(spark):
    plan = plan_of(tw.dedupe(read(spark, "nation")))
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_rules_stay_in_the_jvm(spark):
    df = read(spark, "documents").select(
        numbers.parse_number(F.col("text")), numbers.parse_percent(F.col("text")), dates.parse_date(F.col("text")),
        text.smart_title(F.col("text")), text.squeeze(F.col("text")),
    )
    plan = plan_of(df)
    assert "Python" not in plan and "Exchange" not in plan


def test_only_the_columns_in_use_are_read(spark):
    plan = plan_of(tw.totals(read(spark, "customer").select("c_name", "c_acctbal")))
    assert re.search(r"ReadSchema: struct<c_acctbal:double>", plan)
    filtered = plan_of(tw.drop_sparse_rows(read(spark, "lineitem").where("l_quantity > 49").select("l_orderkey"), 0.5))
    assert "GreaterThan(l_quantity,49.0)" in filtered


def test_fills_shuffle_the_table_once_and_never_cross_join(spark):
    df = read(spark, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    for out in (tw.fill_forward(df, ["v"], ["event_id"], rows_per_bucket=100), tw.interpolate_linear(df, ["v"], ["event_id"], rows_per_bucket=100)):
        plan = plan_of(out)
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        # every shuffle but one carries bucket summaries
        wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(_bucket" in line]
        assert len(wide) >= 1
        assert "BroadcastExchange" in plan


def test_join_sides_are_reduced_before_rates_and_orphans(spark):
    left = read(spark, "customer").select(F.col("c_custkey").alias("k"))
    right = read(spark, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    assert "Cartesian" not in plan_of(combine.stage_rates(left, right, "k"))
    plan = plan_of(combine.join_stage(left, "orders", right, "k"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["dedupe_first", "duplicate_provenance", "text_squeeze", "fill_forward", "join_chain", "append_rows"])
def test_no_cross_join_in_registered_queries(spark, name):
    plan = plan_of(catalogue.QUERIES[name](spark, SF))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_spread_leaves_large_scans_alone(spark):
    from tablewright.sources.readers import spread

    small = read(spark, "nation")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=20)
    assert spread(wide) is wide


def test_a_long_side_is_shuffled_though_its_files_are_small(spark, monkeypatch):
    left = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("a"))
    right = spark.range(30).select((F.col("id") % 15).alias("k"), F.col("id").alias("b"))
    few = tw.join_chain({"l.csv": left, "r.csv": right}, "k")
    monkeypatch.setattr(combine, "FEW_ROWS", 5)
    many = tw.join_chain({"l.csv": left, "r.csv": right}, "k")
    for small, long in ((few.data, many.data), (few.orphans, many.orphans)):
        assert "BroadcastHashJoin" in plan_of(small) and "BroadcastExchange" not in plan_of(long)
        assert sorted(map(str, small.collect())) == sorted(map(str, long.collect()))
