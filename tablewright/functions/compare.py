"""Values and rows made comparable across types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import fixed_values as fv
from tablewright.functions.binding import let
from tablewright.functions.dates import parse_date
from tablewright.functions.numbers import trim_all


def _number_text(c: Column) -> Column:
    """One spelling for a double, shared by all number types; -0 equals 0."""
    return F.concat(F.lit("n:"), (c + F.lit(0.0)).cast("string"))


def _canonical_string(c: Column) -> Column:
    return let(trim_all(c), _canonical_trimmed)


def _canonical_trimmed(v: Column) -> Column:
    day = F.when(v.rlike(fv.COMPARE_DATE), F.date_format(parse_date(v), "yyyy-MM-dd"))

    bare = F.regexp_replace(v, r"(?iu)^" + fv.COMPARE_CURRENCIES + r"\s*", "")
    bare = F.regexp_replace(bare, r"(?iu)\s*" + fv.COMPARE_CURRENCIES + "$", "")
    bare = F.translate(trim_all(F.regexp_replace(bare, fv.COMPARE_FOOTNOTES, "")), " ", "")
    number = F.when(v.rlike(r"\d"), let(bare, _plain_number))
    return F.when(v != "", F.coalesce(F.concat(F.lit("d:"), day), _number_text(number), F.lower(v)))


def _plain_number(bare: Column) -> Column:
    """The number a bare figure stands for, whatever its separators."""
    no_dots = F.translate(bare, ".", "")
    no_commas = F.translate(bare, ",", "")
    comma_as_dot = F.translate(bare, ",", ".")
    plain = (
        F.when(bare.rlike(r"\..*,[^.]*$"), F.translate(no_dots, ",", "."))
        .when(bare.rlike(r",.*\."), no_commas)
        .when(bare.rlike(r"^\d{1,3}(,\d{3})+(,\d+)?$"), no_commas)
        .when(F.contains(bare, F.lit(",")), comma_as_dot)
        .when(bare.rlike(r"^\d{1,3}(\.\d{3})+$"), no_dots)
        .otherwise(bare)
    )
    return F.when(bare.rlike(r"^[+-]?\d[\d.,]*$"), F.regexp_extract(plain, r"^[+-]?\d+\.?\d*$", 0).try_cast("double"))


def canonical(c: Column, dtype: T.DataType) -> Column:
    """One text per meaning, so values of different types can be compared.

    Empty text is null; a date in any spelling becomes its day (the time of day
    is dropped); a number with optional currency or footnote becomes the number;
    all numeric types and booleans compare as doubles; other text is trimmed and
    lower-cased.  "1.500", "1,500" and 1500 agree; "ORD-10641" stays text.
    """
    if isinstance(dtype, T.StringType):
        return _canonical_string(c)
    if isinstance(dtype, T.BooleanType):
        return _number_text(c.cast("int").cast("double"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), _number_text(c.cast("double")))
    if isinstance(dtype, T.NumericType):
        return _number_text(c.cast("double"))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("d:"), F.date_format(c, "yyyy-MM-dd"))
    return F.lower(trim_all(F.to_json(F.struct(c.alias("v")))))


def signature_keys(columns: Sequence[str], keys: Sequence[str] | None, exclude: Sequence[str] = ()) -> list[str]:
    """Existing key columns, or every column when none of the keys exists."""
    usable = [c for c in columns if c not in exclude]
    wanted = [k for k in (keys or ()) if k in usable]
    return wanted or usable


def row_signature(df: DataFrame, keys: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> Column:
    """The comparison key of a row.

    One key column gives its canonical text; several are digested with SHA-256
    so that a shuffle moves a few bytes instead of a second copy of the row.
    Provenance columns are named in ``exclude`` and never take part.
    """
    names = signature_keys(df.columns, keys, exclude)
    texts = [canonical(F.col(f"`{n}`"), df.schema[n].dataType) for n in names]
    if len(texts) == 1:
        return F.coalesce(texts[0], F.lit("null:"))
    packed = F.to_json(F.array(*texts))
    return F.sha2(packed, 256)
