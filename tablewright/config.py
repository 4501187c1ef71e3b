"""Typed, immutable configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class MissingConfig:
    numeric_strategy: str = "median"  # median | mean | mode | constant | interpolate
    text_strategy: str = "constant"  # constant | ffill | bfill
    datetime_strategy: str = "keep_nat"  # keep_nat | mode | ffill | bfill
    numeric_constant: float = 0
    text_constant: str = "Unknown"
    drop_threshold: float | None = None  # 0 < t <= 1


@dataclass(frozen=True)
class DuplicateConfig:
    subset: tuple[str, ...] | None = None  # None = all columns
    keep: str = "first"  # first | last | none
    after_text: bool = False  # compare rows after text has been normalised


@dataclass(frozen=True)
class NumberConfig:
    auto_detect: bool = True
    number_columns: tuple[str, ...] = ()
    currency_columns: tuple[str, ...] = ()
    percent_columns: tuple[str, ...] = ()
    decimal_style: str = "id"  # id: "1.234" groups thousands; us: it does not
    on_unparsed: str = "null"  # null | keep_raw_column


@dataclass(frozen=True)
class DateConfig:
    auto_detect: bool = True
    date_columns: tuple[str, ...] = ()
    output_format: str | None = None  # strftime pattern used by the CSV sink
    min_rate: float = 0.5


@dataclass(frozen=True)
class TextConfig:
    case_format: str | None = "title"  # title | upper | lower | sentence | None
    only_name_columns: bool = True
    case_columns: tuple[str, ...] = ()
    preserve_brackets: bool = True
    preserve_acronyms: bool = True
    custom_acronyms: tuple[str, ...] = ()
    strip_whitespace: bool = True
    collapse_whitespace: bool = True  # with strip_whitespace: inner runs become one blank
    normalize_unicode: bool = True
    remove_non_ascii: bool = False
    exclude_columns: tuple[str, ...] = ("email", "e-mail")


@dataclass(frozen=True)
class OutputConfig:
    currency: str = "IDR"
    add_total_row: bool | None = None


# fixed values: section and key names accepted from existing configuration files
_KEY_ALIASES = {
    "kolom_angka": "number_columns",
    "kolom_currency": "currency_columns",
    "kolom_persen": "percent_columns",
    "kolom_tanggal": "date_columns",
    "kolom_case": "case_columns",
    "kolom_exclude": "exclude_columns",
}
_SECTIONS = {
    "missing": MissingConfig,
    "duplicate": DuplicateConfig,
    "number": NumberConfig,
    "date": DateConfig,
    "text": TextConfig,
    "formatting": OutputConfig,
}


def _section(cls: type, values: Mapping[str, Any] | None):
    known = {f.name for f in fields(cls)}
    given = {}
    for key, value in (values or {}).items():
        key = _KEY_ALIASES.get(key, key)
        if key not in known:
            continue
        if isinstance(value, list):
            value = tuple(value)
        if key == "keep" and value is False:
            value = "none"
        if key.endswith("_columns") and value is None:
            value = ()
        given[key] = value
    return cls(**given)


@dataclass(frozen=True)
class CleanConfig:
    """Everything that decides how a table is cleaned.

    ``exempt`` columns (provenance) are touched by no rule and never compared.
    ``match`` is ``"word"`` or ``"substring"`` and governs all name tests.
    Detection takes its shares over the whole column.
    """

    missing: MissingConfig = field(default_factory=MissingConfig)
    duplicate: DuplicateConfig = field(default_factory=DuplicateConfig)
    number: NumberConfig = field(default_factory=NumberConfig)
    date: DateConfig = field(default_factory=DateConfig)
    text: TextConfig = field(default_factory=TextConfig)
    formatting: OutputConfig = field(default_factory=OutputConfig)
    exempt: tuple[str, ...] = ()
    match: str = "word"

    @classmethod
    def from_dict(cls, values: Mapping[str, Any] | None = None) -> "CleanConfig":
        """Section-wise shallow merge over the defaults; unknown sections are ignored."""
        values = values or {}
        parts = {name: _section(c, values.get(name)) for name, c in _SECTIONS.items()}
        extra = {k: values[k] for k in ("exempt", "match") if k in values}
        if "exempt" in extra:
            extra["exempt"] = tuple(extra["exempt"])
        return cls(**parts, **extra)

    @classmethod
    def from_yaml(cls, path: str) -> "CleanConfig":
        """Read a YAML file; an unreadable or missing file means the defaults, a missing YAML package is an error."""
        import yaml

        try:
            with open(path, encoding="utf-8") as handle:
                return cls.from_dict(yaml.safe_load(handle))
        except (OSError, ValueError):
            return cls()
        except Exception as error:  # a malformed document, whatever yaml calls it
            if type(error).__module__.startswith("yaml"):
                return cls()
            raise

    @classmethod
    def simple(cls) -> "CleanConfig":
        """Preset of the short script (C8): median / "Unknown", keep first, trim
        and title case, dates only where the name says so.

        Dates are read before filling, so an empty date stays empty.
        """
        return cls.from_dict({
            "number": {"auto_detect": False},
            "date": {"auto_detect": False},
            "text": {"normalize_unicode": False, "collapse_whitespace": False, "exclude_columns": []},
        })

    def without(self, *columns: str) -> "CleanConfig":
        """Exempt provenance columns from every rule."""
        return replace(self, exempt=tuple(dict.fromkeys((*self.exempt, *columns))))

    def with_(self, **sections) -> "CleanConfig":
        """A copy with single settings changed: ``cfg.with_(missing={"numeric_strategy": "mean"})``."""
        changed = {
            name: replace(getattr(self, name), **values) if isinstance(values, Mapping) else values
            for name, values in sections.items()
        }
        return replace(self, **changed)
