"""Reading money, percentages and plain numbers out of text.

All helpers are ``Column -> Column`` and stay in generated JVM code.  Casts are
guarded by a pattern because Spark's own cast also accepts "1d" or "nan".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as fv
from tablewright.functions.binding import let

# fixed values: every character that counts as white space
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# day-month-year or year-month-day figures: never a number
DATE_SHAPED = r"^\d{1,4}([-/.])\d{1,2}\1\d{1,4}$"
GROUPED_BY_DOTS = r"^[+-]?\d+\.\d{3}"
DECIMAL_COMMA = r"^([+-]?\d*),(\d{1,2}|\d{4,})$"
_NOISE = r"(?i)\[[^\]]*\]|" + fv.CURRENCY_MARKS + r"[\s\xa0]*"
# a value without any of these characters has nothing to strip
NOISY = r"[A-Za-z\[$€£¥]"
NUMERIC = r"^[+-]?[.,\s\xa0]*\d[\d.,\s\xa0]*$"


def trim_all(c: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITE))


def guarded_double(c: Column) -> Column:
    """Double, or null for anything that is not a plain decimal number."""
    return F.regexp_extract(c, FLOAT, 0).try_cast("double")


def strip_noise(c: Column) -> Column:
    """Remove footnotes like ``[a]`` and currency marks, then trim (F1)."""
    return trim_all(F.when(c.rlike(NOISY), F.regexp_replace(c, _NOISE, "")).otherwise(c))


def has_currency(c: Column) -> Column:
    """Does the text carry a currency mark? (F2)"""
    return c.rlike(NOISY) & c.rlike(r"(?i)" + fv.CURRENCY_MARKS)


def _blank_to_null(c: Column) -> Column:
    return F.when(~c.isin(*fv.NUMBER_NULLS), c)


def parse_number(c: Column, decimal_style: str = "id") -> Column:
    """Text to double, after removing footnotes and currency marks.

    * digits, a dot and three digits: dots group thousands, a comma is decimal
      ("1.500.000,50"); ``decimal_style="us"`` switches this rule off;
    * a single comma that is not followed by exactly three digits is a decimal
      comma ("0,5"); all other commas group thousands ("1,500.50");
    * a leading sign is accepted everywhere.

    Deviates on purpose from tools that lose the sign of "-1.500.000" and that
    read "0,5" as 5.
    """
    def read(v: Column) -> Column:
        text = F.translate(F.regexp_replace(v, DECIMAL_COMMA, "$1.$2"), ",", "")
        if decimal_style == "id":
            text = F.when(v.rlike(GROUPED_BY_DOTS), F.translate(v, ",.", ".")).otherwise(text)
        return guarded_double(text)

    return let(strip_noise(_blank_to_null(c)), read)


def parse_currency(c: Column, decimal_style: str = "id") -> Column:
    """Money text to double; the same grammar as :func:`parse_number`."""
    return parse_number(c, decimal_style)


def parse_percent(c: Column) -> Column:
    """"15%" to 0.15.

    A comma is a decimal comma.  Where dots and commas both occur, the last one
    is the decimal mark, so "1.234,5%" reads as 12.345.
    """
    def read(v: Column) -> Column:
        text = (
            F.when(v.rlike(r"\..*,"), F.translate(v, ",.", "."))
            .when(v.rlike(r",.*\."), F.translate(v, ",", ""))
            .otherwise(F.translate(v, ",", "."))
        )
        return guarded_double(text) / F.lit(100.0)

    return let(trim_all(F.translate(_blank_to_null(c), "%", "")), read)


def numeric_like(c: Column) -> Column:
    """Trimmed text made of digits, separators and blanks, at most one leading sign,
    and not a date.

    Hyphens between digits and date-shaped figures do not count, so ISO dates
    and dashed phone numbers are never taken for numbers.
    """
    return c.rlike(NUMERIC) & ~c.rlike(DATE_SHAPED)


def percent_like(c: Column) -> Column:
    return F.contains(c, F.lit("%")) & c.rlike(r"(?U)^[\d.,\s]+%$")
