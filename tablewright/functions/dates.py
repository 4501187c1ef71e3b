"""Reading dates without guessing the order of day and month.

A value is classified by its shape, split into parts once, and the shape decides
which part is the year, the month and the day.  Day/month order comes from the
column's own evidence, collected per separator, so a column is read in one
consistent way.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as fv
from tablewright.functions.binding import let
from tablewright.functions.numbers import trim_all

SEPARATORS = ("-", "/", ".")
NUMERIC_DATE = r"^\d{1,4}([-/.])\d{1,2}\1\d{1,4}$"
YEAR_FIRST = r"^\d{4}([-/.])\d{1,2}\1\d{1,4}$"
YEAR_LAST = r"^\d{1,2}([-/.])\d{1,2}\1\d{4}$"
ISO_DATETIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}(:?\d{2}(:?\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_NAME = r"([A-Za-z]{3,9})"
_BREAK = r"[-/ ,.]+"
DAY_NAME_YEAR = rf"^(\d{{1,2}}){_BREAK}{_NAME}{_BREAK}(\d{{4}})(?=$|[ T]\d{{1,2}}:\d{{2}}(?::\d{{2}})?$)"
NAME_DAY_YEAR = rf"^{_NAME}{_BREAK}(\d{{1,2}}){_BREAK}(\d{{4}})(?=$|[ T]\d{{1,2}}:\d{{2}}(?::\d{{2}})?$)"
NAME_YEAR = rf"^{_NAME}{_BREAK}(\d{{4}})$"
# day/month-first with a clock time, or with a two-digit year
DAY_MONTH_OTHER = r"^\d{1,2}([-/.])\d{1,2}\1(\d{4}[ T]\d{1,2}:\d{2}(:\d{2})?|\d{2})$"
_MONTHS = " ".join((*(m[:3] for m in fv.MONTH_NAMES), *fv.MONTH_NAMES, "sept"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _part(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _month_number(s: Column) -> Column:
    """Number of the English month name in a text, null for any other word."""
    at = F.array_position(F.split(F.lit(_MONTHS), " "), F.lower(F.regexp_extract(s, _NAME, 1)))
    # positions 1-12 are the short names, 13-24 the full ones, 25 is "sept"
    return F.when(at == 25, "9").when(at > 0, ((at - 1) % 12 + 1).cast("string"))


def date_parts(c: Column) -> tuple[Column, Column, Column, Column]:
    """(separator, first, second, third) of a numeric date, null elsewhere."""
    s = trim_all(c)
    ok = s.rlike(NUMERIC_DATE)
    parts = F.split(s, "[-/.]")
    return (F.when(ok, F.regexp_extract(s, "[-/.]", 0)), *(F.when(ok, _part(parts, i)) for i in range(3)))


def _stamp(text: Column) -> Column:
    """Spark's own reading of year-month-day text with an optional time; an offset
    is ignored, as the column has no zone and keeps the wall-clock time."""
    return text.try_cast("timestamp_ntz")


def _read_ymd(s: Column) -> Column:
    return _stamp(F.translate(s, "/.", "--"))


def _read_day_month(s: Column, month_first: Mapping[str, bool] | None) -> Column:
    month_leads = r"^(0?\d|1[0-2])[-/.](1[3-9]|[2-9]\d)"
    swapped = "".join(f"\\{sep}" for sep in SEPARATORS if (month_first or {}).get(sep))
    if swapped:
        month_leads += rf"|^(0?\d|1[0-2])[{swapped}]"
    figures = r"^(\d{1,2})[-/.](\d{1,2})[-/.]"
    return F.when(s.rlike(month_leads), _stamp(F.regexp_replace(s, figures + r"(\d{4})", "$3-$1-$2"))).otherwise(
        _stamp(F.regexp_replace(s, figures + r"(\d{4})", "$3-$2-$1"))
    )


def _read_iso(s: Column) -> Column:
    # a bare hour and the compact clock 1030 are spelled out for a second try
    spelled = F.regexp_replace(s, r"([T ]\d{1,2})$", "$1:00")
    spelled = F.regexp_replace(spelled, r"([T ]\d{2})(\d{2})(\d{2})?$", "$1:$2:$3")
    return F.coalesce(_stamp(s), _stamp(F.regexp_replace(spelled, ":$", "")))


def _read_other(s: Column) -> Column:
    named = (
        F.when(s.rlike(DAY_NAME_YEAR), F.regexp_replace(s, DAY_NAME_YEAR, "$3-#-$1"))
        .when(s.rlike(NAME_DAY_YEAR), F.regexp_replace(s, NAME_DAY_YEAR, "$3-#-$2"))
        .when(s.rlike(NAME_YEAR), F.regexp_replace(s, NAME_YEAR, "$2-#-1"))
    )
    long_year = F.regexp_replace(
        F.regexp_replace(s, r"(?<=\D)(?=([0-5]\d|6[0-8])$)", "20"), r"(?<=\D)(?=(69|[7-9]\d)$)", "19"
    )
    clock_or_short = F.when(F.contains(s, F.lit(":")), s).otherwise(long_year)
    return (
        F.when(s.rlike("[A-Za-z]{3}"), _stamp(F.replace(named, F.lit("#"), _month_number(s))))
        .when(s.rlike(DAY_MONTH_OTHER), let(clock_or_short, lambda t: _read_day_month(t, None)))
        .when(s.rlike(r"^\d{8}$"), _stamp(F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")))
        .when(s.rlike(r"^\d{4}$"), _stamp(F.concat(s, F.lit("-01-01"))))
    )


def parse_ymd(c: Column) -> Column:
    """Year-first dates; day and month are never swapped."""
    return let(trim_all(c), lambda s: F.when(s.rlike(YEAR_FIRST), _read_ymd(s)))


def parse_day_month(c: Column, month_first: Mapping[str, bool] | None = None) -> Column:
    """Day/month-first dates with a four-digit year (F8).

    A figure above 12 settles the order of its own row; otherwise the column's
    convention for that separator (``month_first[sep]``) holds, else day first.
    """
    return let(trim_all(c), lambda s: F.when(s.rlike(YEAR_LAST), _read_day_month(s, month_first)))


def parse_iso_datetime(c: Column) -> Column:
    """``yyyy-MM-dd`` followed by a time; never read day first."""
    return let(trim_all(c), lambda s: F.when(s.rlike(ISO_DATETIME), _read_iso(s)))


def parse_named_date(c: Column) -> Column:
    """Everything else: month names, two-digit years, clock times, bare years.

    Month names are English; a bare clock time is not a date and gives null, so
    the result never depends on the day it runs.  Two-digit years below 69 belong
    to this century.
    """
    return let(trim_all(c), _read_other)


def parse_date(c: Column, month_first: Mapping[str, bool] | None = None) -> Column:
    """All date readings, each value routed by its shape."""
    return let(
        trim_all(c),
        lambda s: F.when(s.rlike(YEAR_FIRST), _read_ymd(s))
        .when(s.rlike(YEAR_LAST), _read_day_month(s, month_first))
        .when(s.rlike(ISO_DATETIME), _read_iso(s))
        .otherwise(_read_other(s)),
    )


# fixed values: strftime fields in Spark's notation
_JAVA_FIELDS = {"%Y": "yyyy", "%m": "M", "%d": "d", "%B": "MMMM", "%b": "MMM", "%H": "H", "%M": "m", "%S": "s"}


def java_format(fmt: str, padded: bool = False) -> str:
    """A strftime pattern in Spark's notation; ``padded`` writes two digits."""
    for field, java in _JAVA_FIELDS.items():
        fmt = fmt.replace(field, java * 2 if padded and len(java) == 1 else java)
    return fmt


def parse_with_format(c: Column, fmt: str) -> Column:
    """One strftime pattern, whole value, null when it does not fit."""
    return F.try_to_timestamp(trim_all(c), F.lit(java_format(fmt))).cast("timestamp_ntz")


def year_last_text(c: Column) -> Column:
    """The trimmed value if it is a day/month-first date, else null."""
    s = trim_all(c)
    return F.when(s.rlike(YEAR_LAST), s)


def day_month_columns(known: Column) -> dict[str, Column]:
    """Separator and the first two figures of :func:`year_last_text`."""
    parts = F.split(known, "[-/.]")
    return {
        "sep": F.regexp_extract(known, "[-/.]", 0),
        "a": _int(_part(parts, 0)),
        "b": _int(_part(parts, 1)),
    }


def evidence_measures(sep: Column, a: Column, b: Column) -> dict[str, Column]:
    """Aggregates that show a column's day/month order, per separator.

    A first figure above 12 proves day first, a second one month first.  Rows that
    could be read either way are counted in the same pass.
    """
    out = {}
    for i, mark in enumerate(SEPARATORS):
        here = sep == mark
        out[f"rows{i}"] = F.count_if(here)
        out[f"day{i}"] = F.coalesce(F.max(here & (a > 12)), F.lit(False))
        out[f"month{i}"] = F.coalesce(F.max(here & (b > 12)), F.lit(False))
        out[f"either{i}"] = F.count_if(here & (a <= 12) & (b <= 12) & (a != b))
    return out


def month_first_by_separator(measures: Mapping[str, object]) -> dict[str, bool]:
    """Convention per separator: month first only on one-sided evidence."""
    return {
        mark: bool(measures[f"month{i}"]) and not bool(measures[f"day{i}"])
        for i, mark in enumerate(SEPARATORS)
    }


def ambiguous_rows(measures: Mapping[str, object]) -> int:
    """Rows readable both ways under separators without one-sided evidence."""
    return sum(
        int(measures[f"either{i}"] or 0)
        for i in range(len(SEPARATORS))
        if bool(measures[f"day{i}"]) == bool(measures[f"month{i}"])
    )


def looks_like_date(c: Column) -> Column:
    """Content test of P7: one of four shapes anywhere in the value."""
    return c.rlike("|".join(fv.DATE_CONTENT_PATTERNS))
