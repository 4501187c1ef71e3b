"""Totals, previews and source filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import fixed_values as fv
from tablewright.functions.names import name_matches
from tablewright.functions.numbers import trim_all
from tablewright.operators.order import ROW_ORDER, order_key, quoted


def total_columns(df: DataFrame, match: str = "word") -> list[str]:
    """Number columns that are summed: not the first one, no ids, ages or years."""
    kinds = (T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType)
    return [
        f.name for f in df.schema.fields[1:]
        if isinstance(f.dataType, kinds) and not name_matches(f.name, fv.NOT_IN_TOTAL, match)
    ]


def totals(df: DataFrame, match: str = "word") -> DataFrame:
    """The TOTAL row: label in the first column, sums in the summed ones.

    One partial aggregate.  The first column is text, as it holds the label.
    """
    summed = total_columns(df, match)
    row = df.agg(F.count("*").alias("_rows"), *[F.sum(quoted(c)).alias(f"t{i}") for i, c in enumerate(summed)])
    cols = []
    for n, f in enumerate(df.schema.fields):
        if n == 0:
            cols.append(F.lit(fv.TOTAL_LABEL).alias(f.name))
        elif f.name in summed:
            cols.append(F.col(f"t{summed.index(f.name)}").alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return row.where("_rows > 0").select(*cols)


def with_total_row(df: DataFrame, match: str = "word", add_total_row: bool | None = None) -> DataFrame:
    """The table with its TOTAL row appended; ``add_total_row=False`` leaves it out."""
    if add_total_row is False:
        return df
    first = df.columns[0]
    total = totals(df, match)
    widened = df.select(
        quoted(first).cast("string").alias(first),
        *[quoted(c).cast(total.schema[c].dataType).alias(c) for c in df.columns[1:]],
    )
    return widened.unionByName(total)


def is_total_row(df: DataFrame) -> Column:
    """"TOTAL" in the first column and nothing in the others."""
    first, *rest = [c for c in df.columns if c != ROW_ORDER]
    test = F.upper(trim_all(quoted(first).cast("string"))) == fv.TOTAL_LABEL
    for c in rest:
        test = test & quoted(c).isNull()
    return F.coalesce(test, F.lit(False))


def drop_total_rows(df: DataFrame) -> DataFrame:
    """Remove footer rows (P2); a row-wise filter."""
    return df.where(~is_total_row(df)) if df.columns else df


def filter_source(df: DataFrame, value: str, source: str = fv.SOURCE_COLUMN) -> DataFrame:
    """Rows that came from one source."""
    return df.where(quoted(source) == F.lit(value))


def list_sources(df: DataFrame, source: str = fv.SOURCE_COLUMN) -> DataFrame:
    """Distinct sources in name order."""
    return df.where(quoted(source).isNotNull()).groupBy(quoted(source).alias(source)).agg(F.count("*").alias("rows")).orderBy(source)


def preview(before: DataFrame, after: DataFrame, n: int = 15, order_by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of both tables in the same order (P12, O4): a distributed top-n."""

    def head(df: DataFrame) -> DataFrame:
        names = [c for c in (order_by or ()) if c in df.columns]
        order = order_key(df, names) if names else [quoted(c) for c in df.columns]
        return df.orderBy(*[k.asc_nulls_first() for k in order]).limit(n)

    return head(before), head(after)
