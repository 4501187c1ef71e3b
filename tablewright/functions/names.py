"""Decisions taken from a column's name alone (no data is read)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from tablewright.functions import fixed_values as fv


def _words(name: str) -> str:
    """Lower-case words of a name, each wrapped in single spaces."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return " " + " ".join(re.findall(r"[^\W_]+", spaced.lower())) + " "


def name_matches(name: str, keywords: Iterable[str], match: str = "word") -> bool:
    """Does a column name contain one of ``keywords``?

    ``match="word"`` compares whole words, so "id" does not fire on "width" nor
    "date" on "candidate".  ``match="substring"`` looks anywhere in the name.
    """
    if match == "substring":
        lowered = name.strip().lower()
        return any(k in lowered for k in keywords)
    words = _words(name)
    return any(_words(k) in words for k in keywords)


def is_name_or_title_column(name: str, match: str = "word") -> bool:
    """True for columns that hold people, places or titles.

    The list of exclusions is asked first, so "nama_kode" is no name.
    """
    if not isinstance(name, str):
        return False
    return not name_matches(name, fv.NOT_A_NAME, match) and name_matches(name, fv.NAME_WORDS, match)


def column_role(name: str, dtype: str, currency: str = "IDR", match: str = "word") -> tuple[str, str | None]:
    """(role, display mask) of a column by its name, then by its Spark type (P10)."""
    if name_matches(name, fv.MONEY_NAMES, match):
        return "currency", fv.MASKS["currency_usd" if currency.upper() == "USD" else "currency_idr"]
    if name_matches(name, fv.PERCENT_NAMES, match):
        return "percent", fv.MASKS["percent"]
    if name_matches(name, fv.DATE_MASK_NAMES, match) or dtype.startswith(("timestamp", "date")):
        return "date", fv.MASKS["date_iso"]
    if name_matches(name, fv.INTEGER_NAMES, match) or dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer", fv.MASKS["integer"]
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "decimal", fv.MASKS["decimal"]
    return "text", None


def file_stem(path: str) -> str:
    """Base name of a path without its last extension."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base[1:] else base
