"""Duplicates: removal with a defined survivor, counts and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators.order import ROW_ORDER, file_order, order_key, quoted


def duplicate_keys(df: DataFrame, subset: Sequence[str] | None, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that make two rows duplicates: those of ``subset``, or all but the place in the files."""
    if subset is None:
        return [c for c in df.columns if c not in exclude and c != ROW_ORDER]
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise KeyError(f"Unknown duplicate columns: {missing}")
    return list(subset)


def dedupe(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Keep the first, the last or none of the rows that share a key; null equals null.

    The order is ``order_by`` (the place in the files where it is known), then all remaining columns, so the survivor is
    defined (``dropDuplicates`` would pick any).  Comparing whole rows needs no
    order at all and is a plain partial aggregate.  Otherwise ``row_number() <= k``
    is pushed below the shuffle (window group limit): each task sends at most one
    row per key (two for ``keep="none"``), so a key holding a third of the table
    costs no more than any other.
    """
    keys = duplicate_keys(df, subset, exclude)
    if not keys or not df.columns:
        return df
    if keep in ("none", False):
        return _keep_none(df, keys)
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or 'none'")
    if set(keys) == set(df.columns):
        return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n")).drop("_n")
    leaves = order_key(df, file_order(df, order_by))
    order = [c.asc_nulls_first() if keep == "first" else c.desc_nulls_last() for c in leaves]
    w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def _keep_none(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cols = [quoted(k) for k in keys]
    if set(keys) == set(df.columns):
        return df.groupBy(*cols).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    # two rows per key are enough to see that a key is not alone
    w = Window.partitionBy(*cols)
    return (
        df.withColumn("_rank", F.row_number().over(w.orderBy(*cols)))
        .where(F.col("_rank") <= 2)
        .withColumn("_n", F.count("*").over(w))
        .where(F.col("_n") == 1)
        .drop("_rank", "_n")
    )


def count_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", exclude: Sequence[str] = ()
) -> DataFrame:
    """One row: total rows, distinct keys and the rows ``keep`` would remove (A5).

    ``keep="none"`` counts every member of a duplicate group.
    """
    keys = duplicate_keys(df, subset, exclude)
    groups = df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("n"))
    removed = F.sum(F.when(F.col("n") > 1, F.col("n"))) if keep in ("none", False) else F.sum(F.col("n") - 1)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(removed, F.lit(0)).alias("duplicates"),
    )


def _per_source(df: DataFrame, source: str, keys: Sequence[str], order_by: Sequence[str] | None) -> DataFrame:
    """Rows and first position of every (key, source); one row each from here on."""
    order = F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order_by)]) if order_by else quoted(source)
    per = df.groupBy(*[quoted(k) for k in keys], quoted(source)).agg(
        F.count("*").alias("_n"), F.min(order).alias("_at")
    )
    # at most one row per source is left for any key, however frequent it is
    w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy("_at", quoted(source))
    return per.withColumn("_first", F.first(quoted(source)).over(w))


def first_seen(
    df: DataFrame, source: str, cols: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Per distinct raw row: the source it was first seen in and how often it occurs.

    ``order_by`` names the columns that order the sources (by default the source
    itself); raw values are compared, before any cleaning.
    """
    keys = list(cols) if cols else [c for c in df.columns if c != source and c not in (order_by or ())]
    per = _per_source(df, source, keys, order_by)
    return per.groupBy(*[quoted(k) for k in keys], F.col("_first").alias("first_source")).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("sources")
    )


def duplicate_provenance(
    df: DataFrame, source: str, cols: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Per source: rows, repeats of rows first seen in the same source, and repeats
    of rows first seen in another one (A7)."""
    keys = list(cols) if cols else [c for c in df.columns if c != source and c not in (order_by or ())]
    same = quoted(source) == F.col("_first")
    return (
        _per_source(df, source, keys, order_by)
        .groupBy(quoted(source).alias("source"))
        .agg(
            F.sum("_n").alias("rows"),
            F.sum(F.when(same, F.col("_n") - 1).otherwise(0)).alias("duplicates_inside"),
            F.sum(F.when(same, 0).otherwise(F.col("_n"))).alias("duplicates_across"),
        )
    )
