"""Filling and dropping rows with missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.order import quoted
from tablewright.operators.profile import measure
from tablewright.operators.quantiles import means, means_by, medians, medians_by, modes, modes_by


def drop_sparse_rows(df: DataFrame, threshold: float | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose share of empty cells is above ``threshold``.

    Only 0 < threshold <= 1 has an effect.  A row-wise filter: no shuffle.
    """
    columns = list(columns or df.columns)
    if threshold is None or not 0 < threshold <= 1 or not columns:
        return df
    empty = sum((quoted(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.where(empty / F.lit(len(columns)) <= F.lit(threshold))


def fill_type(dtype: T.DataType, strategy: str, value=None) -> T.DataType:
    """Type of a number column after filling: a whole-number column becomes double
    when the filling may be fractional."""
    if not isinstance(dtype, T.IntegralType):
        return dtype
    if strategy in ("median", "mean", "interpolate"):
        return T.DoubleType()
    if isinstance(value, float) and not value.is_integer():
        return T.DoubleType()
    return dtype


def fill_values(
    df: DataFrame, cols: Sequence[str], strategy: str, counts: Mapping[str, int] | None = None, small: int | None = None
) -> dict[str, object]:
    """The constant each column is filled with under median, mean or mode.

    ``counts`` (non-null rows per column) is measured when it is not given.  An
    empty column has no median and no mean; its mode is 0.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    if strategy == "mean":
        return means(df, cols)
    if strategy == "mode":
        found = modes(df, cols)
        return {c: found.get(c, 0) for c in cols}
    if counts is None:
        measured = measure(df, {(c, "n"): F.count(quoted(c)) for c in cols})[None]
        counts = {c: measured[(c, "n")] for c in cols}
    return medians(df, cols, counts, **({"small": small} if small else {}))


def fill_values_by(
    df: DataFrame, by: str | None, wanted: Mapping[object, Mapping[str, int]], strategy: str
) -> dict[object, dict[str, object]]:
    """:func:`fill_values` for every table of a stack; ``wanted[table][column]`` holds
    the non-null rows.  The number of passes does not grow with the tables."""
    if not any(wanted.values()):
        return {g: {} for g in wanted}
    if by is None:
        return {g: fill_values(df, list(cols), strategy, cols) for g, cols in wanted.items()}
    columns = list(dict.fromkeys(c for cols in wanted.values() for c in cols))
    if strategy == "mean":
        found = means_by(df, by, columns)
    elif strategy == "mode":
        found = modes_by(df, by, columns)
    else:
        found = medians_by(df, by, wanted)
    empty = 0 if strategy == "mode" else None
    return {g: {c: found.get(g, {}).get(c, empty) for c in cols} for g, cols in wanted.items()}


def fill_constants(df: DataFrame, values: Mapping[str, object], strategy: str = "constant") -> DataFrame:
    """Replace nulls by one value per column; other columns are untouched."""
    out = {}
    for c, v in values.items():
        if c not in df.columns or v is None:
            continue
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.NumericType):
            dtype = fill_type(dtype, strategy, v)
        out[c] = F.coalesce(quoted(c).cast(dtype), F.lit(v).cast(dtype))
    return df.withColumns(out) if out else df


def fill_numeric(df: DataFrame, cols: Sequence[str], strategy: str = "median", constant: float = 0) -> DataFrame:
    """Fill number columns by median, mean, mode or a constant; any other word means median."""
    if strategy == "constant":
        return fill_constants(df, dict.fromkeys(cols, constant))
    if strategy not in ("mean", "mode"):
        strategy = "median"
    return fill_constants(df, fill_values(df, cols, strategy), strategy)


def fill_datetime(df: DataFrame, cols: Sequence[str], strategy: str = "keep_nat") -> DataFrame:
    """Fill date columns by their mode; ``keep_nat`` leaves them empty.

    Forward and backward fill are in :mod:`tablewright.operators.carry`.
    """
    if strategy != "mode":
        return df
    return fill_constants(df, modes(df, [c for c in cols if c in df.columns]), "mode")
