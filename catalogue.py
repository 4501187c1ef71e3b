"""Registered queries over the test tables, each with its SQL counterpart.

The test tables are clean, so every query first dirties whole columns by a
formula of the row (text money, mixed date spellings, nulls, repeated rows) and
then repairs them with the library.  The SQL computes the expected result from
the clean columns; it never repeats the repair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tablewright as tw
from tablewright.config import CleanConfig
from tablewright.functions import dates, numbers, text
from tablewright.functions import fixed_values as fv
from tablewright.operators import combine, profile, quantiles
from tablewright.plans.clean import read_dates
from tablewright.session import materialise, scratch_path
from tablewright.sources.readers import list_tables, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# ------------------------------------------------------------ dirtying formulas


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def commas(v: Column) -> Column:
    return F.format_number(v, 0)


def dots(v: Column) -> Column:
    return F.translate(commas(v), ",", ".")


def decimal_comma(v: Column) -> Column:
    """Hundredths written as 1.234,56."""
    whole = F.floor(v / 100).cast("bigint")
    return F.concat(dots(whole), F.lit(","), F.lpad((v % 100).cast("string"), 2, "0"))


def money_text(v: Column, key: Column) -> Column:
    """A whole number in seven spellings; the last one shows it as hundredths."""
    k = F.pmod(key, F.lit(7))
    return (
        F.when(k == 0, v.cast("string"))
        .when(k == 1, F.concat(F.lit("Rp "), dots(v)))
        .when(k == 2, commas(v))
        .when(k == 3, dots(v))
        .when(k == 4, F.concat(dots(v), F.lit("[a]")))
        .when(k == 5, F.concat(F.lit(" "), v.cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit("Rp. "), decimal_comma(v)))
    )


MONEY_SQL = "CASE WHEN {k} % 7 = 6 THEN {v} / 100.0 ELSE {v} END::DOUBLE"


def date_text(ts: Column, key: Column) -> Column:
    """Five spellings: slash day first, dash month first, year first twice, month name."""
    k = F.pmod(key, F.lit(5))
    return (
        F.when(k == 0, F.date_format(ts, "dd/MM/yyyy"))
        .when(k == 1, F.date_format(ts, "MM-dd-yyyy"))
        .when(k == 2, F.date_format(ts, "yyyy.MM.dd"))
        .when(k == 3, F.date_format(ts, "dd MMM yyyy"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def null_every(c: str | Column, key: str, n: int, rest: int = 0) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.when(F.pmod(F.col(key), F.lit(n)) != rest, value)


ORDER_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


# ------------------------------------------------------------ numbers


@query("parse_currency", f"""
    SELECT o_orderkey, {MONEY_SQL.format(k='o_orderkey', v=ORDER_CENTS)} AS price FROM orders""")
def parse_currency(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select("o_orderkey", money_text(cents("o_totalprice"), F.col("o_orderkey")).alias("raw"))
    return raw.select("o_orderkey", numbers.parse_currency(F.col("raw")).alias("price"))


@query("parse_percent", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_partkey % 4 = 3 THEN 1000 + p ELSE p END / 100.0::DOUBLE AS discount
    FROM (SELECT *, CAST(round(l_discount * 100) AS BIGINT) AS p FROM lineitem)""")
def parse_percent(spark, sf):
    p, k = cents("l_discount"), F.pmod(F.col("l_partkey"), F.lit(4))
    raw = (
        F.when(k == 0, F.concat(p.cast("string"), F.lit("%")))
        .when(k == 1, F.concat(p.cast("string"), F.lit(",0%")))
        .when(k == 2, F.concat(F.lit(" "), p.cast("string"), F.lit(".0 %")))
        .otherwise(F.concat(dots(p + 1000), F.lit(",0%")))
    )
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, sf, "lineitem").select(*keys, raw.alias("raw")).select(
        *keys, numbers.parse_percent(F.col("raw")).alias("discount")
    )


@query("parse_number", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE l_suppkey % 5 WHEN 0 THEN -v WHEN 2 THEN v / 100.0 ELSE v END::DOUBLE AS amount
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)""")
def parse_number(spark, sf):
    v, k = cents("l_extendedprice"), F.pmod(F.col("l_suppkey"), F.lit(5))
    raw = (
        F.when(k == 0, F.concat(F.lit("-"), dots(v)))
        .when(k == 1, v.cast("string"))
        .when(k == 2, F.translate(decimal_comma(v), ".", ""))
        .when(k == 3, commas(v))
        .otherwise(F.concat(dots(v), F.lit(" [12]")))
    )
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, sf, "lineitem").select(*keys, raw.alias("raw")).select(
        *keys, numbers.parse_number(F.col("raw")).alias("amount")
    )


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with text money, mixed dates, percentages, phone-like figures and nulls,
    written once: cleaning reads its input in several passes, as it would a file."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return materialise(o.select(
        key.alias("no_order"),
        null_every(money_text(cents("o_totalprice"), key), "o_orderkey", 11).alias("harga"),
        F.concat(F.pmod(key, F.lit(40)).cast("string"), F.lit("%")).alias("diskon"),
        commas(F.col("o_custkey") * 1000 + 1000).alias("poin"),
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("nomor_hp"),
        null_every(date_text(F.col("o_orderdate"), key), "o_orderkey", 13).alias("tanggal_order"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("kirim"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lower("o_orderpriority")).otherwise(
            F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("  "))
        ).alias("keterangan"),
        null_every("o_orderstatus", "o_orderkey", 17).alias("status"),
    ), "dirty")


@query("detect_columns", """
    SELECT 'harga' AS "column", 'currency' AS kind, count(*) AS known FROM orders WHERE o_orderkey % 11 <> 0
    UNION ALL SELECT 'diskon', 'percent', count(*) FROM orders
    UNION ALL SELECT 'poin', 'number', count(*) FROM orders
    UNION ALL SELECT 'tanggal_order', 'date', count(*) FROM orders WHERE o_orderkey % 13 <> 0
    UNION ALL SELECT 'kirim', 'date', count(*) FROM orders""")
def detect_columns(spark, sf):
    return profile.detected_table(dirty_orders(spark, sf))


# ------------------------------------------------------------ dates


@query("parse_dates_mixed", "SELECT o_orderkey, o_orderdate AS order_date FROM orders")
def parse_dates_mixed(spark, sf):
    o = table(spark, sf, "orders")
    raw = materialise(o.select("o_orderkey", date_text(F.col("o_orderdate"), F.col("o_orderkey")).alias("order_date")), "dirty")
    return read_dates(raw, CleanConfig())


@query("parse_iso_datetime", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def parse_iso_datetime(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.pmod("event_id", F.lit(2)) == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("ts", "yyyy-M-d'T'HH:mm:ss")
    )
    return e.select("event_id", raw.alias("raw")).select("event_id", dates.parse_date(F.col("raw")).alias("ts"))


def shipping_text() -> Column:
    k = F.pmod(F.col("l_linenumber"), F.lit(3))
    ts = F.col("l_shipdate")
    return (
        F.when(k == 0, F.date_format(ts, "dd/MM/yyyy"))
        .when(k == 1, F.date_format(ts, "MM-dd-yyyy"))
        .otherwise(F.date_format(ts, "d.M.yyyy"))
    )


@query("date_evidence", """
    SELECT 'shipped' AS "column",
           CASE l_linenumber % 3 WHEN 0 THEN '/' WHEN 1 THEN '-' ELSE '.' END AS separator,
           count(*) AS "rows",
           max(CASE WHEN l_linenumber % 3 = 1 THEN month(l_shipdate) ELSE day(l_shipdate) END) > 12 AS day_first_proof,
           max(CASE WHEN l_linenumber % 3 = 1 THEN day(l_shipdate) ELSE month(l_shipdate) END) > 12 AS month_first_proof,
           count(*) FILTER (WHERE day(l_shipdate) <= 12 AND day(l_shipdate) <> month(l_shipdate)) AS either_way
    FROM lineitem GROUP BY 1, 2""")
def date_evidence(spark, sf):
    return profile.date_evidence(table(spark, sf, "lineitem").select(shipping_text().alias("shipped")), ["shipped"])


@query("date_ambiguity", """
    SELECT 'shipped' AS "column",
           count(*) FILTER (WHERE (day(l_shipdate) - 1) % 12 + 1 <> month(l_shipdate)) AS ambiguous
    FROM lineitem""")
def date_ambiguity(spark, sf):
    ts = F.col("l_shipdate")
    folded = F.concat(
        ((F.dayofmonth(ts) - 1) % 12 + 1).cast("string"), F.lit("/"), F.month(ts).cast("string"), F.lit("/"), F.year(ts).cast("string")
    )
    return profile.count_ambiguous(table(spark, sf, "lineitem").select(folded.alias("shipped")), ["shipped"])


# ------------------------------------------------------------ missing values


def holey_customer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        null_every("c_name", "c_custkey", 3).alias("c_name"),
        null_every("c_acctbal", "c_custkey", 7).alias("c_acctbal"),
        null_every("c_mktsegment", "c_custkey", 5).alias("c_mktsegment"),
        null_every("c_nationkey", "c_custkey", 4).alias("c_nationkey"),
    )


HOLEY_SQL = """SELECT c_custkey,
    CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment,
    CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS c_nationkey FROM customer"""


@query("null_counts", f"""
    WITH d AS ({HOLEY_SQL})
    SELECT 'c_custkey' AS "column", count(*) - count(c_custkey) AS nulls, count(*) AS "rows" FROM d
    UNION ALL SELECT 'c_name', count(*) - count(c_name), count(*) FROM d
    UNION ALL SELECT 'c_acctbal', count(*) - count(c_acctbal), count(*) FROM d
    UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment), count(*) FROM d
    UNION ALL SELECT 'c_nationkey', count(*) - count(c_nationkey), count(*) FROM d""")
def null_counts(spark, sf):
    return profile.null_counts(holey_customer(spark, sf))


def holey_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        null_every("value", "event_id", 7).alias("value"),
        null_every("event_type", "event_id", 5, 1).alias("event_type"),
        null_every("user_id", "event_id", 9, 2).alias("user_id"),
    )


EVENTS_SQL = """SELECT event_id,
    CASE WHEN event_id % 7 <> 0 THEN value END AS value,
    CASE WHEN event_id % 5 <> 1 THEN event_type END AS event_type,
    CASE WHEN event_id % 9 <> 2 THEN user_id END AS user_id FROM events"""


@query("fill_median", f"""
    WITH d AS ({EVENTS_SQL})
    SELECT event_id, round(coalesce(value, (SELECT median(value) FROM d)), 6) AS value FROM d""")
def fill_median(spark, sf):
    filled = tw.fill_numeric(holey_events(spark, sf).select("event_id", "value"), ["value"], "median")
    return filled.select("event_id", F.round("value", 6).alias("value"))


# every number column of lineitem, with holes, as if it were too long for the built-in median
LONG_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


def holey_lineitem(spark, sf):
    gaps = {c: F.when(F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(11 + i)) != 0, F.col(c)) for i, c in enumerate(LONG_NUMBERS)}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_orderkey", F.lit(3)).cast("int").alias("part"), *LONG_NUMBERS).withColumns(gaps)


@query("medians_long_columns", " UNION ALL ".join(f"""
    SELECT CAST(l_orderkey % 3 AS INTEGER) AS part, '{c}' AS column_name, round(median(CAST({c} AS DOUBLE)), 6) AS median
    FROM lineitem WHERE (l_orderkey + l_linenumber) % {11 + i} <> 0 GROUP BY 1""" for i, c in enumerate(LONG_NUMBERS)))
def medians_long_columns(spark, sf):
    """Medians per table number and column; all of them share the passes over the rows."""
    df = holey_lineitem(spark, sf)
    known = df.groupBy("part").agg(*[F.count(c).alias(c) for c in LONG_NUMBERS]).collect()
    found = quantiles.medians_by(df, "part", {r["part"]: {c: r[c] for c in LONG_NUMBERS} for r in known}, small=0)
    lines = [(part, c, v) for part, of in found.items() for c, v in of.items()]
    return spark.createDataFrame(lines, "part int, column_name string, median double").withColumn("median", F.round("median", 6))


MANY_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_quantity"]


@query("modes_many_columns", " UNION ALL ".join(f"""
    SELECT * FROM (SELECT CAST(l_orderkey % 3 AS INTEGER) AS part, '{c}' AS column_name, first({c} ORDER BY n DESC, {c})::VARCHAR AS value
    FROM (SELECT l_orderkey % 3 AS l_orderkey, {c}, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""" for c in MANY_TEXTS))
def modes_many_columns(spark, sf):
    """Most frequent values of columns of several types per table number, from one scan."""
    df = table(spark, sf, "lineitem").select(F.pmod("l_orderkey", F.lit(3)).cast("int").alias("part"), *MANY_TEXTS)
    found = quantiles.modes_by(df, "part", MANY_TEXTS)
    return spark.createDataFrame([(part, c, v) for part, of in found.items() for c, v in of.items()], "part int, column_name string, value string")


@query("fill_mean", f"""
    WITH d AS ({EVENTS_SQL})
    SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value FROM d""")
def fill_mean(spark, sf):
    filled = tw.fill_numeric(holey_events(spark, sf).select("event_id", "value"), ["value"], "mean")
    return filled.select("event_id", F.round("value", 6).alias("value"))


@query("fill_mode", f"""
    WITH d AS ({EVENTS_SQL})
    SELECT event_id, coalesce(user_id, (SELECT user_id FROM d WHERE user_id IS NOT NULL GROUP BY user_id
        ORDER BY count(*) DESC, user_id LIMIT 1)) AS user_id FROM d""")
def fill_mode(spark, sf):
    return tw.fill_numeric(holey_events(spark, sf).select("event_id", "user_id"), ["user_id"], "mode")


@query("fill_constant", f"""
    WITH d AS ({EVENTS_SQL})
    SELECT event_id, coalesce(value, 0) AS value, coalesce(event_type, 'Unknown') AS event_type FROM d""")
def fill_constant(spark, sf):
    d = holey_events(spark, sf).select("event_id", "value", "event_type")
    return tw.fill_constants(d, {"value": 0, "event_type": "Unknown"})


@query("fill_datetime_mode", """
    WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS o_orderdate FROM orders)
    SELECT o_orderkey, coalesce(o_orderdate, (SELECT o_orderdate FROM d WHERE o_orderdate IS NOT NULL
        GROUP BY o_orderdate ORDER BY count(*) DESC, o_orderdate LIMIT 1)) AS o_orderdate FROM d""")
def fill_datetime_mode(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", null_every("o_orderdate", "o_orderkey", 6).alias("o_orderdate"))
    return tw.fill_datetime(d, ["o_orderdate"], "mode")


ROWS_PER_BUCKET = 2_000  # small on purpose: several buckets even on the test tables


@query("fill_forward", f"""
    WITH d AS ({EVENTS_SQL})
    SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value,
           coalesce(last_value(event_type IGNORE NULLS) OVER w, 'Unknown') AS event_type,
           last_value(user_id IGNORE NULLS) OVER w AS user_id
    FROM d WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward(spark, sf):
    out = tw.fill_forward(
        holey_events(spark, sf), ["value", "event_type", "user_id"], ["event_id"], rows_per_bucket=ROWS_PER_BUCKET
    )
    return out.withColumn("event_type", F.coalesce("event_type", F.lit("Unknown")))


@query("fill_backward", f"""
    WITH d AS ({EVENTS_SQL})
    SELECT event_id, first_value(value IGNORE NULLS) OVER w AS value,
           first_value(event_type IGNORE NULLS) OVER w AS event_type,
           first_value(user_id IGNORE NULLS) OVER w AS user_id
    FROM d WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_backward(spark, sf):
    return tw.fill_backward(
        holey_events(spark, sf), ["value", "event_type", "user_id"], ["event_id"], rows_per_bucket=ROWS_PER_BUCKET
    )


@query("interpolate_linear", """
    WITH d AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos,
                      CASE WHEN event_id % 7 NOT IN (0, 1, 2) THEN value END AS value FROM events),
    n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv,
                 last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
                 first_value(value IGNORE NULLS) OVER a AS nv,
                 first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np
          FROM d WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        a AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, pv + (nv - pv) * (pos - pp) / (np - pp), pv, nv), 6) AS value FROM n""")
def interpolate_linear(spark, sf):
    k = F.pmod(F.col("event_id"), F.lit(7))
    d = table(spark, sf, "events").select("event_id", F.when(~k.isin(0, 1, 2), F.col("value")).alias("value"))
    out = tw.interpolate_linear(d, ["value"], ["event_id"], rows_per_bucket=ROWS_PER_BUCKET)
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("drop_sparse_rows", f"""
    SELECT * FROM ({HOLEY_SQL}) WHERE (CASE WHEN c_name IS NULL THEN 1 ELSE 0 END
        + CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END + CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END
        + CASE WHEN c_nationkey IS NULL THEN 1 ELSE 0 END) / 5.0 <= 0.3""")
def drop_sparse_rows(spark, sf):
    return tw.drop_sparse_rows(holey_customer(spark, sf), 0.3)


@query("drop_total_rows", "SELECT CAST(c_custkey AS VARCHAR) AS no, c_name, c_acctbal FROM customer")
def drop_total_rows(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("no"), "c_name", "c_acctbal")
    return tw.drop_total_rows(tw.with_total_row(c).unionByName(tw.with_total_row(c).where("no = 'TOTAL'").select(
        F.lit(" total ").alias("no"), "c_name", F.lit(None).cast("double").alias("c_acctbal")
    )).select("no", "c_name", F.when(F.upper(F.trim("no")) != "TOTAL", F.col("c_acctbal")).alias("c_acctbal")))


# ------------------------------------------------------------ duplicates


@query("dedupe_first", """
    SELECT event_id, ts, user_id, event_type, value, props FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_first(spark, sf):
    return tw.dedupe(table(spark, sf, "events"), ["user_id", "event_type"], "first", ["event_id"])


@query("dedupe_last", """
    SELECT event_id, ts, user_id, event_type, value, props FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedupe_last(spark, sf):
    return tw.dedupe(table(spark, sf, "events"), ["user_id", "event_type"], "last", ["event_id"])


@query("dedupe_none", """
    SELECT event_id, ts, user_id, event_type, value, props FROM
      (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, props) AS n FROM events) WHERE n = 1""")
def dedupe_none(spark, sf):
    return tw.dedupe(table(spark, sf, "events"), ["user_id", "event_type", "props"], "none")


@query("dedupe_rows", """
    SELECT DISTINCT l_partkey, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS l_suppkey, l_returnflag FROM lineitem""")
def dedupe_rows(spark, sf):
    d = table(spark, sf, "lineitem").select("l_partkey", null_every("l_suppkey", "l_suppkey", 3).alias("l_suppkey"), "l_returnflag")
    return tw.dedupe(d)


@query("duplicate_counts", """
    WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT 'first' AS keep, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g
    UNION ALL SELECT 'none', CAST(sum(n) AS BIGINT), count(*), CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM g""")
def duplicate_counts(spark, sf):
    d = table(spark, sf, "lineitem")
    parts = [
        tw.count_duplicates(d, ["l_orderkey", "l_linenumber"], keep).select(F.lit(keep).alias("keep"), "*")
        for keep in ("first", "none")
    ]
    return parts[0].unionByName(parts[1])


def customer_parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The customer table as three overlapping files that cover it: all rows, a
    segment once more, and a third file that repeats rows of its own."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    extra = c.where("c_mktsegment = 'MACHINERY'")
    return {
        "jan.csv": c.where("c_mktsegment <> 'BUILDING'"),
        "feb.csv": c.where("c_mktsegment IN ('BUILDING', 'FURNITURE')"),
        "mar.csv": extra.unionByName(extra),
    }


PARTS_SQL = """
    SELECT 0 AS f, 'jan.csv' AS src, c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 1, 'feb.csv', c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')
    UNION ALL SELECT 2, 'mar.csv', c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT 2, 'mar.csv', c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'"""


@query("stack_tagged", f"""SELECT c_custkey, c_name, c_mktsegment, c_acctbal, src AS "Sumber File" FROM ({PARTS_SQL})""")
def stack_tagged(spark, sf):
    return tw.stack(customer_parts(spark, sf))


FIRST_SEEN_SQL = f"""
    SELECT *, first_value(f) OVER (PARTITION BY c_custkey ORDER BY f) AS ff,
           row_number() OVER (PARTITION BY c_custkey ORDER BY f) AS rn FROM ({PARTS_SQL})"""


@query("duplicate_provenance", f"""
    SELECT f AS source, count(*) AS "rows",
           count(*) FILTER (WHERE ff = f AND rn > 1) AS duplicates_inside,
           count(*) FILTER (WHERE ff <> f) AS duplicates_across
    FROM ({FIRST_SEEN_SQL}) GROUP BY f""")
def duplicate_provenance(spark, sf):
    d = combine.stack(customer_parts(spark, sf), number=True)
    return tw.duplicate_provenance(d, combine.FILE_NO, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


@query("first_seen", f"""
    SELECT c_custkey, c_name, c_mktsegment, c_acctbal, min(f) AS first_source, count(*) AS "rows", count(DISTINCT f) AS sources
    FROM ({PARTS_SQL}) GROUP BY ALL""")
def first_seen(spark, sf):
    d = combine.stack(customer_parts(spark, sf), number=True)
    return tw.first_seen(d, combine.FILE_NO, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


# ------------------------------------------------------------ text


@query("text_squeeze", r"""
    SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM documents""")
def text_squeeze(spark, sf):
    t = F.col("text")
    messy = F.concat(
        F.lit("  \t"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.regexp_replace(t, " ", "  ")).otherwise(F.regexp_replace(t, " ", " 　")),
        F.lit("  "),
    )
    return table(spark, sf, "documents").select("doc_id", messy.alias("text")).select(
        "doc_id", text.squeeze(F.col("text")).alias("text")
    )


PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)


@query("text_nfkc", "SELECT doc_id, text FROM documents")
def text_nfkc(spark, sf):
    d = table(spark, sf, "documents")
    wide = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.translate("text", PLAIN, WIDE)).otherwise(F.col("text"))
    return d.select("doc_id", text.nfkc(wide).alias("text"))


@query("text_ascii_only", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents")
def text_ascii_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.ascii_only(F.col("text")).alias("text"))


@query("text_upper", "SELECT conv_id, turn, upper(replace(text, 'ß', 'SS')) AS text FROM conversations")
def text_upper(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.apply_case(F.col("text"), "upper").alias("text"))


@query("text_lower", "SELECT conv_id, turn, lower(text) AS text FROM conversations")
def text_lower(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.apply_case(F.col("text"), "lower").alias("text"))


@query("text_sentence", "SELECT conv_id, turn, upper(text[1]) || lower(text[2:]) AS text FROM conversations")
def text_sentence(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.apply_case(F.col("text"), "sentence").alias("text"))


@query("text_smart_title", """
    SELECT p_partkey, CASE p_partkey % 4
        WHEN 0 THEN t WHEN 1 THEN t || ' [' || p_type || ' live]' WHEN 2 THEN 'PT ' || t || ' VIP' ELSE 'O''' || t || '-hub''s' END AS name
    FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t FROM part)""")
def text_smart_title(spark, sf):
    n, k = F.col("p_name"), F.pmod(F.col("p_partkey"), F.lit(4))
    messy = (
        F.when(k == 0, F.upper(n))
        .when(k == 1, F.concat(n, F.lit(" ["), F.col("p_type"), F.lit(" live]")))
        .when(k == 2, F.concat(F.lit("pt "), n, F.lit(" VIP")))
        .otherwise(F.concat(F.lit("o'"), n, F.lit("-hub's")))
    )
    return table(spark, sf, "part").select("p_partkey", text.smart_title(messy).alias("name"))


@query("text_smart_title_documents")
def text_smart_title_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.smart_title(F.col("text")).alias("text"))


LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@query("text_smart_title_words", f"""
    SELECT doc_id, array_to_string(list_transform(string_split(words, ' '), lambda w:
        CASE WHEN list_contains({list(fv.ACRONYMS)}, upper(w)) THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') AS text
    FROM (SELECT doc_id, trim(regexp_replace(translate(text, '{LETTERS[0]}', '{LETTERS[1]}'), '[^a-z]+', ' ', 'g')) AS words FROM documents)""")
def text_smart_title_words(spark, sf):
    """Whole documents, folded to words of plain letters first."""
    words = F.trim(F.regexp_replace(F.translate("text", *LETTERS), "[^a-z]+", " "))
    return table(spark, sf, "documents").select("doc_id", text.smart_title(words).alias("text"))


# ------------------------------------------------------------ joins


def join_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """customer ← orders ← lineitem with keys that lost their partner and null keys."""
    c = table(spark, sf, "customer").select(
        F.when(F.pmod("c_custkey", F.lit(10)) == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("cust"), "c_name"
    )
    o = table(spark, sf, "orders").select(
        null_every("o_custkey", "o_orderkey", 13).alias("cust"), F.col("o_orderkey").alias("order"),
        F.col("o_orderstatus").alias("status"),
    )
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order"), "l_linenumber", "l_quantity", F.col("l_linestatus").alias("status")
    )
    return {"customer.csv": c, "orders.csv": o, "lineitem.csv": li}


JOIN_SQL = """
    c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS cust, c_name FROM customer),
    o AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS cust, o_orderkey AS "order", o_orderstatus AS status FROM orders),
    l AS (SELECT l_orderkey AS "order", l_linenumber, l_quantity, l_linestatus AS status_lineitem FROM lineitem),
    co AS (SELECT c.cust, c_name, "order", status FROM c LEFT JOIN o ON c.cust = o.cust),
    col AS (SELECT co.*, l_linenumber, l_quantity, status_lineitem FROM co LEFT JOIN l ON co."order" = l."order")"""


@query("join_chain", f"""
    WITH {JOIN_SQL}
    SELECT co.*, l_linenumber, l_quantity, status_lineitem FROM co LEFT JOIN l ON co."order" = l."order" """)
def join_chain(spark, sf):
    li = join_tables(spark, sf)
    # null keys meet null keys by definition; the last table has none
    return tw.join_chain(li, "cust,order").data


@query("join_stage_rates", f"""
    WITH {JOIN_SQL}
    SELECT 1 AS stage, 'customer.csv' AS left_name, 'orders.csv' AS right_name, 'cust' AS key,
           n AS left_rows, m AS matched_rows, n - m AS unmatched_rows, round(m * 100.0 / n, 2) AS match_rate
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE cust IN (SELECT cust FROM o WHERE cust IS NOT NULL)) AS m FROM c)
    UNION ALL
    SELECT 2, 'hasil gabungan', 'lineitem.csv', 'order', n, m, n - m, round(m * 100.0 / n, 2)
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE "order" IN (SELECT "order" FROM l)) AS m FROM co)""")
def join_stage_rates(spark, sf):
    return tw.join_chain(join_tables(spark, sf), ["cust", "order"]).stages


@query("join_orphans", f"""
    WITH {JOIN_SQL}
    SELECT cust, "order", status, NULL::INTEGER AS l_linenumber, NULL::DOUBLE AS l_quantity, 1 AS "Tahap", 'orders.csv' AS "File Asal",
           'cust ' || coalesce(CAST(cust AS VARCHAR), '<kosong>') || ' tidak ditemukan di customer.csv' AS "Alasan"
    FROM o WHERE cust IS NULL OR cust NOT IN (SELECT cust FROM c)
    UNION ALL
    SELECT NULL, "order", status_lineitem, l_linenumber, l_quantity, 2, 'lineitem.csv',
           'order ' || "order" || ' tidak ditemukan di hasil gabungan'
    FROM l WHERE "order" NOT IN (SELECT "order" FROM co WHERE "order" IS NOT NULL)""")
def join_orphans(spark, sf):
    return tw.join_chain(join_tables(spark, sf), ["cust", "order"]).orphans


# ------------------------------------------------------------ append


def append_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Base: finished orders.  First file: all urgent orders.  Second file: all
    orders, and every order of one priority a second time with other content."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    clean_ = o.select(key.alias("order_no"), cents("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
                      F.lit(0).alias("version"), "o_orderstatus", "o_orderpriority")
    dirty = o.select(
        key.alias("order_no"), F.concat(F.lit("Rp "), commas(cents("o_totalprice"))).alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"), F.lit(0).alias("version"), "o_orderstatus", "o_orderpriority",
    )
    dirty = materialise(dirty, "dirty")
    again = dirty.where("o_orderpriority = '5-LOW'").withColumn("version", F.lit(1))
    cols = ["order_no", "price", "order_date", "version"]
    return (
        clean_.where("o_orderstatus = 'F'").select(cols),
        {
            "urgent.csv": dirty.where("o_orderpriority = '1-URGENT'").select("price", "order_date", "version", "order_no"),
            "all.csv": dirty.unionByName(again).select(cols),
        },
    )


def append_run(spark: SparkSession, sf: str):
    base, new = append_inputs(spark, sf)
    return tw.append_tables(base, new, keys=["order_no"], source_col="Sumber File", base_name="base.csv", order_by=["version"])


@query("append_rows", f"""
    SELECT o_orderkey AS order_no, {ORDER_CENTS}::DOUBLE AS price, o_orderdate AS order_date, 0 AS version,
           CASE WHEN o_orderstatus = 'F' THEN 'base.csv' WHEN o_orderpriority = '1-URGENT' THEN 'urgent.csv' ELSE 'all.csv' END AS "Sumber File"
    FROM orders""")
def append_rows(spark, sf):
    return append_run(spark, sf).data


APPEND_SKIP_SQL = f"""
    SELECT o_orderkey AS order_no, {ORDER_CENTS}::DOUBLE AS price, o_orderdate AS order_date, 0 AS version,
           'urgent.csv' AS src, 'sudah ada di file dasar' AS why FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT o_orderkey, {ORDER_CENTS}::DOUBLE, o_orderdate, 0, 'all.csv', 'sudah ada di file dasar'
    FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT o_orderkey, {ORDER_CENTS}::DOUBLE, o_orderdate, 1, 'all.csv',
           CASE WHEN o_orderstatus = 'F' THEN 'sudah ada di file dasar' ELSE 'duplikat di file baru' END
    FROM orders WHERE o_orderpriority = '5-LOW'"""


@query("append_skipped", f"""
    SELECT order_no, price, order_date, version, src AS "Sumber File", src AS "File Asal", why AS "Alasan" FROM ({APPEND_SKIP_SQL})""")
def append_skipped(spark, sf):
    return append_run(spark, sf).skipped


@query("append_file_counts", f"""
    WITH s AS (SELECT src, count(*) FILTER (WHERE why LIKE 'sudah%') AS b, count(*) FILTER (WHERE why LIKE 'dup%') AS d
               FROM ({APPEND_SKIP_SQL}) GROUP BY src)
    SELECT 0 AS _file_no, 'urgent.csv' AS file,
           (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS rows_read,
           (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS added,
           b AS skipped_in_base, d AS skipped_in_file FROM s WHERE src = 'urgent.csv'
    UNION ALL
    SELECT 1, 'all.csv', (SELECT count(*) + count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders),
           (SELECT count(*) FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'), b, d
    FROM s WHERE src = 'all.csv'""")
def append_file_counts(spark, sf):
    return append_run(spark, sf).file_counts


@query("append_summary", f"""
    WITH s AS (SELECT count(*) AS n FROM ({APPEND_SKIP_SQL}))
    SELECT 'base_rows' AS metric, count(*) AS value FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'rows_read', count(*) FILTER (WHERE o_orderpriority = '1-URGENT') + count(*) + count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders
    UNION ALL SELECT 'rows_added', count(*) FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'rows_skipped', n FROM s
    UNION ALL SELECT 'final_rows', count(*) FROM orders
    UNION ALL SELECT 'base_total_rows_removed', 0""")
def append_summary(spark, sf):
    return append_run(spark, sf).summary()


@query("append_cleaning_summary", """
    SELECT 0 AS _file_no, 'urgent.csv' AS file, count(*) AS rows_before, count(*) AS rows_after, 0::BIGINT AS duplicates_removed,
           0::BIGINT AS rows_dropped, '''price'': currency → float; ''order_date'' → datetime' AS actions
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT 1, 'all.csv', n, n, 0, 0, '''price'': currency → float; ''order_date'' → datetime'
    FROM (SELECT count(*) + count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n FROM orders)""")
def append_cleaning_summary(spark, sf):
    return append_run(spark, sf).cleaning_summary()


@query("append_stream", f"""
    SELECT cust, o_orderkey AS order_no, price FROM (
        SELECT o_custkey AS cust, o_orderkey, {ORDER_CENTS}::DOUBLE AS price,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
        WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
    WHERE rn = 1
    UNION ALL SELECT o_custkey, o_orderkey, {ORDER_CENTS}::DOUBLE FROM orders WHERE o_orderstatus = 'P'""")
def append_stream(spark, sf):
    from tablewright.plans.result import clean

    o = table(spark, sf, "orders")
    incoming = scratch_path(spark, "incoming")
    o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("order_no"),
             F.concat(F.lit("Rp "), commas(cents("o_totalprice"))).alias("price")).write.parquet(incoming)
    base = o.where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("order_no"),
        F.concat(F.lit("Rp "), dots(cents("o_totalprice"))).alias("price"))
    store = scratch_path(spark, "store")
    stream = tw.AppendStream(spark, store, clean(base).plan, ["cust"], order_by=["order_no"]).start_from(base)
    stream.run(incoming, base.schema, f"{store}/checkpoint").awaitTermination()
    return stream.kept()


# ------------------------------------------------------------ whole cleanings (C1-C8) and audit tables


def repeated_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty orders where every order of one status occurs twice."""
    d = dirty_orders(spark, sf)
    return d.unionByName(d.where("status = 'F'"))


REPEATED_SQL = f"""
    SELECT o_orderkey AS no_order, CASE WHEN o_orderkey % 11 <> 0 THEN {MONEY_SQL.format(k='o_orderkey', v=ORDER_CENTS)} END AS harga,
           (o_orderkey % 40) / 100.0::DOUBLE AS diskon, (o_custkey * 1000 + 1000)::DOUBLE AS poin,
           lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS nomor_hp,
           CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS tanggal_order, o_orderdate AS kirim,
           CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS keterangan,
           CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS status FROM orders"""
REPEATED_SQL = f"SELECT * FROM ({REPEATED_SQL}) UNION ALL SELECT * FROM ({REPEATED_SQL}) WHERE status = 'F'"


@query("clean_orders", f"""
    WITH d AS ({REPEATED_SQL})
    SELECT DISTINCT no_order, round(coalesce(harga, (SELECT median(harga) FROM d)), 6) AS harga, diskon, poin, nomor_hp,
           tanggal_order, kirim, keterangan, coalesce(status, 'Unknown') AS status FROM d""")
def clean_orders(spark, sf):
    return tw.clean(repeated_orders(spark, sf)).data.withColumn("harga", F.round("harga", 6))


@query("run_metrics", f"""
    WITH d AS ({REPEATED_SQL}), u AS (SELECT DISTINCT * FROM d),
    m AS (SELECT count(*) FILTER (WHERE harga IS NULL) + count(*) FILTER (WHERE status IS NULL) AS filled,
                 count(*) FILTER (WHERE tanggal_order IS NULL) AS kept_empty, count(*) AS n FROM d)
    SELECT 'orders' AS source, metric, value FROM (
        SELECT 'rows_in' AS metric, n AS value FROM m
        UNION ALL SELECT 'columns_in', 9 UNION ALL SELECT 'rows_dropped', 0
        UNION ALL SELECT 'duplicates_removed', n - (SELECT count(*) FROM u) FROM m
        UNION ALL SELECT 'missing_found', filled + kept_empty FROM m
        UNION ALL SELECT 'missing_repaired', filled FROM m
        UNION ALL SELECT 'unparsed', 0
        UNION ALL SELECT 'rows_out', count(*) FROM u
        UNION ALL SELECT 'columns_out', 9)""")
def run_metrics(spark, sf):
    return tw.clean(repeated_orders(spark, sf), source="orders").run_metrics()


@query("column_status", f"""
    WITH d AS ({REPEATED_SQL}),
    h AS (SELECT count(*) FILTER (WHERE harga IS NULL) AS n, median(harga) AS m FROM d)
    SELECT 1 AS no, 'no_order' AS "column", 'bigint' AS type, 0::BIGINT AS missing_found, 'Data already clean' AS actions
    UNION ALL SELECT 2, 'harga', 'double', n, '''harga'': currency → float; ''harga'' (numeric): ' || n || ' missing → constant (0)' FROM h
    UNION ALL SELECT 3, 'diskon', 'double', 0, '''diskon'': percentage → float (decimal)'
    UNION ALL SELECT 4, 'poin', 'double', 0, '''poin'': numeric string → float'
    UNION ALL SELECT 5, 'nomor_hp', 'string', 0, '''nomor_hp'': normalize unicode, strip whitespace'
    UNION ALL SELECT 6, 'tanggal_order', 'timestamp_ntz', count(*) FILTER (WHERE tanggal_order IS NULL),
        '''tanggal_order'' → datetime; ''tanggal_order'' (datetime): ' || count(*) FILTER (WHERE tanggal_order IS NULL) || ' missing → left empty (valid datetime)' FROM d
    UNION ALL SELECT 7, 'kirim', 'timestamp_ntz', 0, '''kirim'' → datetime'
    UNION ALL SELECT 8, 'keterangan', 'string', 0, '''keterangan'': normalize unicode, strip whitespace'
    UNION ALL SELECT 9, 'status', 'string', count(*) FILTER (WHERE status IS NULL),
        '''status'' (text): ' || count(*) FILTER (WHERE status IS NULL) || ' missing → ''Unknown''; ''status'': normalize unicode, strip whitespace' FROM d""")
def column_status(spark, sf):
    cfg = CleanConfig.from_dict({"missing": {"numeric_strategy": "constant"}})
    return tw.clean(repeated_orders(spark, sf), cfg).column_status()


@query("cleaning_warnings", """
    SELECT 'bill_date' AS "column", 'ambiguous_date' AS kind,
           count(*) FILTER (WHERE (day(l_shipdate) - 1) % 12 + 1 <> month(l_shipdate)) AS "rows" FROM lineitem
    UNION ALL SELECT 'amount', 'unparsed', count(*) FROM lineitem WHERE l_partkey % 10 = 0""")
def cleaning_warnings(spark, sf):
    ts = F.col("l_shipdate")
    folded = F.concat(
        ((F.dayofmonth(ts) - 1) % 12 + 1).cast("string"), F.lit("/"), F.month(ts).cast("string"), F.lit("/"), F.year(ts).cast("string")
    )
    amount = F.when(F.pmod("l_partkey", F.lit(10)) == 0, F.lit("n.v.t.")).otherwise(F.concat(F.lit("$"), commas(cents("l_extendedprice"))))
    d = table(spark, sf, "lineitem").select(folded.alias("bill_date"), amount.alias("amount"))
    return tw.clean(materialise(d, "dirty")).warnings()


@query("clean_interpolated", f"""
    WITH d AS ({EVENTS_SQL}),
    p AS (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM d),
    n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
                 first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np,
                 last_value(event_type IGNORE NULLS) OVER b AS et
          FROM p WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        a AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, pv + (nv - pv) * (pos - pp) / (np - pp), pv, nv), 6) AS value,
           upper(coalesce(et, 'Unknown')) AS event_type FROM n""")
def clean_interpolated(spark, sf):
    cfg = CleanConfig.from_dict({
        "missing": {"numeric_strategy": "interpolate", "text_strategy": "ffill"},
        "text": {"case_format": "upper"},
    })
    d = holey_events(spark, sf).select("event_id", "value", "event_type")
    return tw.clean(d, cfg, order_by=["event_id"]).data.withColumn("value", F.round("value", 6))


@query("clean_simple", """
    WITH d AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS gaji, o_orderdate, o_orderpriority FROM orders)
    SELECT o_orderkey, o_custkey, round(coalesce(gaji, (SELECT median(gaji) FROM d)), 6) AS gaji,
           CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS tanggal,
           CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'Unknown' END AS note FROM d""")
def clean_simple(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    d = o.select(
        "o_orderkey", "o_custkey", null_every("o_totalprice", "o_orderkey", 4).alias("gaji"),
        F.when(F.pmod(key, F.lit(6)) == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("tanggal"),
        null_every(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")), "o_orderkey", 5).alias("note"),
    )
    return tw.clean_simple(d.unionByName(d)).data.withColumn("gaji", F.round("gaji", 6))


@query("clean_merged", f"""
    SELECT c_custkey, c_name, c_mktsegment, c_acctbal, src AS "Sumber File" FROM ({FIRST_SEEN_SQL}) WHERE rn = 1""")
def clean_merged(spark, sf):
    return tw.clean_merged(customer_parts(spark, sf)).data


@query("merge_file_counts", f"""
    SELECT f AS no, src AS file, count(*) AS "rows", count(*) FILTER (WHERE ff = f AND rn > 1) AS duplicates_inside,
           count(*) FILTER (WHERE ff <> f) AS duplicates_across FROM ({FIRST_SEEN_SQL}) GROUP BY f, src""")
def merge_file_counts(spark, sf):
    return tw.clean_merged(customer_parts(spark, sf)).file_counts


@query("merge_summary", f"""
    WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE ff = f AND rn > 1) AS i, count(*) FILTER (WHERE ff <> f) AS x,
                      count(DISTINCT c_custkey) AS u FROM ({FIRST_SEEN_SQL}))
    SELECT 'files' AS metric, 3::BIGINT AS value UNION ALL SELECT 'rows_in', n FROM s
    UNION ALL SELECT 'duplicates_inside', i FROM s UNION ALL SELECT 'duplicates_across', x FROM s
    UNION ALL SELECT 'duplicates_removed', n - u FROM s UNION ALL SELECT 'rows_dropped', 0
    UNION ALL SELECT 'rows_out', u FROM s UNION ALL SELECT 'columns_out', 5""")
def merge_summary(spark, sf):
    return tw.clean_merged(customer_parts(spark, sf)).summary()


@query("clean_joined", f"""
    WITH {JOIN_SQL}
    SELECT DISTINCT cust, c_name, coalesce("order", -1) AS "order", coalesce(status, 'Unknown') AS status, coalesce(l_linenumber, -1) AS l_linenumber,
           coalesce(l_quantity, -1) AS l_quantity, coalesce(status_lineitem, 'Unknown') AS status_lineitem FROM col""")
def clean_joined(spark, sf):
    cfg = CleanConfig.from_dict({"missing": {"numeric_strategy": "constant", "numeric_constant": -1}, "text": {"case_format": None}})
    return tw.clean_joined(join_tables(spark, sf), "cust,order", cfg).data


@query("join_summary", f"""
    WITH {JOIN_SQL},
    r AS (SELECT count(*) AS n, 2 * count(*) FILTER (WHERE "order" IS NULL) + 3 * count(*) FILTER (WHERE l_linenumber IS NULL) AS e FROM col),
    u AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM col)),
    w AS (SELECT (SELECT count(*) FROM o WHERE cust IS NULL OR cust NOT IN (SELECT cust FROM c))
               + (SELECT count(*) FROM l WHERE "order" NOT IN (SELECT "order" FROM co WHERE "order" IS NOT NULL)) AS n)
    SELECT 'rows_in' AS metric, n AS value FROM r UNION ALL SELECT 'columns_in', 7 UNION ALL SELECT 'rows_dropped', 0
    UNION ALL SELECT 'duplicates_removed', r.n - u.n FROM r, u
    UNION ALL SELECT 'missing_found', e FROM r UNION ALL SELECT 'missing_repaired', e FROM r
    UNION ALL SELECT 'unparsed', 0 UNION ALL SELECT 'rows_out', n FROM u UNION ALL SELECT 'columns_out', 7
    UNION ALL SELECT 'orphans', n FROM w""")
def join_summary(spark, sf):
    return tw.clean_joined(join_tables(spark, sf), "cust,order").summary()


@query("join_stage_summary", f"""
    WITH {JOIN_SQL},
    s AS (SELECT 1 AS stage, 'customer.csv' AS left_name, 'orders.csv' AS right_name, 'cust' AS key,
                 count(*) AS n, count(*) FILTER (WHERE cust IN (SELECT cust FROM o WHERE cust IS NOT NULL)) AS m FROM c
          UNION ALL SELECT 2, 'hasil gabungan', 'lineitem.csv', 'order', count(*), count(*) FILTER (WHERE "order" IN (SELECT "order" FROM l)) FROM co)
    SELECT stage, left_name, right_name, key, n AS left_rows, m AS matched_rows,
           n - m AS unmatched_rows, round(m * 100.0 / n, 2) AS match_rate, printf('%.2f%%', round(m * 100.0 / n, 2)) AS rate_text,
           left_name || ' + ' || right_name || ' (key: ' || key || ') → ' || printf('%.2f%%', round(m * 100.0 / n, 2)) || ' match' AS flow FROM s""")
def join_stage_summary(spark, sf):
    return tw.clean_joined(join_tables(spark, sf), "cust,order").stage_summary()


@query("auto_merge", f"""
    SELECT c_custkey, c_name, c_mktsegment, c_acctbal, src AS "Sumber File" FROM ({FIRST_SEEN_SQL}) WHERE rn = 1""")
def auto_merge(spark, sf):
    return tw.combine_auto(customer_parts(spark, sf))[1].data


@query("auto_join", """
    SELECT DISTINCT n_name, coalesce(s_name, 'Unknown') AS s_name, coalesce(s_acctbal, -1) AS s_acctbal, coalesce(s_suppkey, -1) AS s_suppkey,
           coalesce(l_linenumber, -1) AS l_linenumber, coalesce(l_quantity, -1) AS l_quantity, n_nationkey FROM nation
    LEFT JOIN supplier ON n_nationkey = s_nationkey LEFT JOIN lineitem ON s_suppkey = l_suppkey""")
def auto_join(spark, sf):
    parts = {
        "nation.csv": table(spark, sf, "nation").select("n_nationkey", "n_name"),
        "supplier.csv": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name", "s_acctbal"),
        "lineitem.csv": table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_linenumber", "l_quantity"),
    }
    cfg = CleanConfig.from_dict({
        "text": {"case_format": None}, "number": {"auto_detect": False}, "date": {"auto_detect": False},
        "missing": {"numeric_strategy": "constant", "numeric_constant": -1},
    })
    return tw.combine_auto(parts, cfg)[1].data


@query("tables_summary", """
    SELECT source, metric, value, source AS table_name FROM (
        SELECT 'customer' AS source, count(*) AS n, 5 AS k FROM customer
        UNION ALL SELECT 'supplier', count(*), 4 FROM supplier),
    LATERAL (SELECT unnest(['rows_in', 'columns_in', 'rows_dropped', 'duplicates_removed', 'missing_found', 'missing_repaired',
                            'unparsed', 'rows_out', 'columns_out']) AS metric,
                    unnest([n, k, 0, 0, 0, 0, 0, n, k]) AS value)""")
def tables_summary(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("customer", "supplier", "part")}
    return tw.tables_summary(tw.clean_tables(tables, "customer, supplier"))[0]


@query("totals", """
    SELECT 'TOTAL' AS c_name, NULL::DOUBLE AS umur, round(sum(c_acctbal), 2) AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM customer""")
def totals(spark, sf):
    d = table(spark, sf, "customer").select("c_name", (F.col("c_custkey") % 90).cast("double").alias("umur"), "c_acctbal", "c_mktsegment")
    return tw.totals(d).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("with_total_row", """
    SELECT CAST(o_orderkey AS VARCHAR) AS no, o_custkey AS cust_id, CAST(round(o_totalprice * 100) AS BIGINT) AS nilai FROM orders
    UNION ALL SELECT 'TOTAL', NULL, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders""")
def with_total_row(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("cust_id"), cents("o_totalprice").alias("nilai"))
    return tw.with_total_row(d)


@query("display_format", """
    SELECT o_orderkey, 'Rp ' || format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) AS harga,
           printf('%.1f%%', o_orderkey % 40 * 1.0) AS diskon, strftime(o_orderdate, '%Y-%m-%d') AS tanggal,
           format('{:,}', o_custkey) AS qty FROM orders""")
def display_format(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), cents("o_totalprice").cast("double").alias("harga"),
        (F.pmod("o_orderkey", F.lit(40)) / 100).alias("diskon"), F.col("o_orderdate").alias("tanggal"), F.col("o_custkey").alias("qty"),
    )
    return tw.display_format(d).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("list_sources", f"""SELECT src AS "Sumber File", count(*) AS "rows" FROM ({PARTS_SQL}) GROUP BY src""")
def list_sources(spark, sf):
    return tw.list_sources(tw.stack(customer_parts(spark, sf)))


@query("filter_source", f"""
    SELECT c_custkey, c_name, c_mktsegment, c_acctbal, src AS "Sumber File" FROM ({PARTS_SQL}) WHERE src = 'feb.csv'""")
def filter_source(spark, sf):
    return tw.filter_source(tw.stack(customer_parts(spark, sf)), "feb.csv")


@query("preview", """
    SELECT no_order, round(harga, 6) AS harga, status FROM (
        SELECT o_orderkey AS no_order, CASE WHEN o_orderkey % 7 = 6 THEN v / 100.0 ELSE v END::DOUBLE AS harga, o_orderstatus AS status
        FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)) ORDER BY no_order LIMIT 15""")
def preview(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("no_order"), money_text(cents("o_totalprice"), F.col("o_orderkey")).alias("harga"),
        F.col("o_orderstatus").alias("status"))
    return tw.preview(d, tw.clean(d).data, 15, ["no_order"])[1].withColumn("harga", F.round("harga", 6))


@query("table_shape", """SELECT count(*) AS "rows", 6 AS columns FROM orders""")
def table_shape(spark, sf):
    return tw.table_shape(table(spark, sf, "orders"))


# ------------------------------------------------------------ sources and sinks


@query("csv_round_trip", """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 'He said "' || o_orderpriority || '", ok' AS o_orderpriority FROM orders""")
def csv_round_trip(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.pmod("o_orderkey", F.lit(10)) == 0, F.lit("n/a")).when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("NULL"))
        .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", "o_orderdate", F.concat(F.lit('He said "'), F.col("o_orderpriority"), F.lit('", ok')).alias("o_orderpriority"),
    )
    path = scratch_path(spark, "csv")
    tw.write_csv(o, path, "%Y-%m-%d")
    return tw.read_folder(spark, path).drop("Sumber File")


@query("csv_quoted_newlines", "SELECT doc_id, nullif(text, '') AS text, 'first' || chr(10) || lang AS lang, source, n_chars FROM documents")
def csv_quoted_newlines(spark, sf):
    """Whole texts as cells: records go over many lines and over the splits of a file."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("first\n"), "lang").alias("lang"), "source", "n_chars")
    path = scratch_path(spark, "csv")
    plain = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    d.write.options(**plain).csv(path)
    return tw.read_folder(spark, path).drop("Sumber File")


@query("csv_ordered_append", f"""
    SELECT o_orderkey AS order_no, {ORDER_CENTS} + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 2 END AS cents FROM orders""")
def csv_ordered_append(spark, sf):
    """Two rows for each new order: the one that stands first in the files is added, whatever it holds."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_no"), cents("o_totalprice").alias("cents"))
    copies = F.array(F.col("order_no") % 2, 1 - F.col("order_no") % 2)
    twice = o.select("order_no", "cents", F.posexplode(copies).alias("copy", "more"))
    path = scratch_path(spark, "csv")
    line = twice.repartitionByRange("order_no").sortWithinPartitions("order_no", "copy")
    line.select("order_no", (F.col("cents") + F.col("more")).alias("cents")).write.option("header", True).csv(path)
    new = tw.read_csv(spark, list_tables(spark, path), with_order=True)
    return tw.append_tables(o.where("order_no % 3 = 0"), new, keys=["order_no"]).data


@query("csv_latin_encoding", "SELECT c_custkey, 'José ' || c_name AS c_name FROM customer")
def csv_latin_encoding(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("José "), F.col("c_name")).alias("c_name"))
    path = scratch_path(spark, "csv")
    c.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tw.read_folder(spark, path).drop("Sumber File")
