"""The frozen outcome of looking at a table: what to do with each column.

A :class:`CleanPlan` is a value.  It holds no data and no reference to a
session, can be stored as JSON and applied to other tables with the same
columns, which is what the streaming append does.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from tablewright.config import DuplicateConfig, TextConfig
from tablewright.functions import fixed_values as fv


@dataclass(frozen=True)
class DateRule:
    """Day/month order per separator, or one fixed format for the whole column."""

    month_first: Mapping[str, bool] = field(default_factory=dict)
    fixed_format: str | None = None
    ambiguous: int = 0


@dataclass(frozen=True)
class FillRule:
    """``strategy`` as configured; ``value`` is the constant it led to, if any."""

    kind: str  # numeric | datetime | text
    strategy: str
    value: object = None
    missing: int = 0


@dataclass(frozen=True)
class TextRule:
    normalize_unicode: bool
    needs_unicode: bool  # False: the column is pure ASCII, NFKC would change nothing
    strip_whitespace: bool
    collapse_whitespace: bool
    remove_non_ascii: bool
    case_format: str | None


@dataclass(frozen=True)
class Action:
    column: str | None  # None: the table as a whole
    step: str  # number | date | drop | missing | text
    code: str
    detail: str = ""
    rows: int = 0


@dataclass(frozen=True)
class CleanPlan:
    """All decisions for one table."""

    columns: tuple[str, ...]
    numbers: Mapping[str, str] = field(default_factory=dict)
    decimal_style: str = "id"
    keep_raw: bool = False
    dates: Mapping[str, DateRule] = field(default_factory=dict)
    drop_threshold: float | None = None
    fills: Mapping[str, FillRule] = field(default_factory=dict)
    duplicate: DuplicateConfig = field(default_factory=DuplicateConfig)
    text: Mapping[str, TextRule] = field(default_factory=dict)
    title: TextConfig = field(default_factory=TextConfig)
    exempt: tuple[str, ...] = ()
    rows_in: int = 0
    rows_dropped: int = 0
    missing: Mapping[str, int] = field(default_factory=dict)
    unparsed: Mapping[str, int] = field(default_factory=dict)

    @property
    def subject(self) -> tuple[str, ...]:
        """Columns the rules may look at and compare."""
        return tuple(c for c in self.columns if c not in self.exempt)

    def with_duplicate(self, **changes) -> "CleanPlan":
        return replace(self, duplicate=replace(self.duplicate, **changes))

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "CleanPlan":
        raw = json.loads(text)
        raw["dates"] = {c: DateRule(**r) for c, r in raw["dates"].items()}
        raw["fills"] = {c: FillRule(**r) for c, r in raw["fills"].items()}
        raw["text"] = {c: TextRule(**r) for c, r in raw["text"].items()}
        for key, kind in (("duplicate", DuplicateConfig), ("title", TextConfig)):
            raw[key] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw[key].items()})
        for key in ("columns", "exempt"):
            raw[key] = tuple(raw[key])
        return cls(**raw)

    def actions(self) -> list[Action]:
        """What was done, step by step and column by column."""
        out = [Action(c, "number", kind) for c, kind in self.numbers.items()]
        for c, rule in self.dates.items():
            out.append(Action(c, "date", "datetime"))
            if rule.ambiguous:
                out.append(Action(c, "date", "ambiguous", rows=rule.ambiguous))
        if self.rows_dropped:
            out.append(Action(None, "drop", "sparse", rows=self.rows_dropped))
        for c, rule in self.fills.items():
            if rule.missing:
                detail = "" if rule.value is None else str(rule.value)
                out.append(Action(c, "missing", f"{rule.kind}:{rule.strategy}", detail, rule.missing))
        for c, rule in self.text.items():
            done = [code for code, on in (
                ("unicode", rule.normalize_unicode), ("strip", rule.strip_whitespace),
                ("ascii", rule.remove_non_ascii), (rule.case_format, rule.case_format),
            ) if on]
            if done:
                out.append(Action(c, "text", ",".join(done)))
        return out


# fixed values: texts of the audit report, English and Indonesian
ACTION_TEXTS = {
    "en": {
        "currency": "'{c}': currency → float",
        "percent": "'{c}': percentage → float (decimal)",
        "number": "'{c}': numeric string → float",
        "datetime": "'{c}' → datetime",
        "numeric": "'{c}' (numeric): {n} missing → {how}",
        "datetime_fill": "'{c}' (datetime): {n} missing → {how}",
        "text_fill": "'{c}' (text): {n} missing → {how}",
        "sparse": "{n} sparse rows dropped",
        "keep_nat": "left empty (valid datetime)",
        "interpolate": "linear interpolation",
        "ffill": "forward fill",
        "bfill": "backward fill",
        "unicode": "normalize unicode",
        "strip": "strip whitespace",
        "ascii": "remove non-ASCII",
        "title": "Smart Title Case",
        "upper": "UPPERCASE",
        "lower": "lowercase",
        "sentence": "Sentence case",
        "clean": fv.ALREADY_CLEAN,
    },
    "id": {
        "currency": "'{c}': currency → float",
        "percent": "'{c}': persen → float (desimal)",
        "number": "'{c}': string angka → float",
        "datetime": "'{c}' → datetime",
        "numeric": "'{c}' (numerik): {n} missing → {how}",
        "datetime_fill": "'{c}' (datetime): {n} missing → {how}",
        "text_fill": "'{c}' (teks): {n} missing → {how}",
        "sparse": "{n} baris terlalu kosong dihapus",
        "keep_nat": "dibiarkan NaT (valid datetime)",
        "interpolate": "interpolasi linear",
        "ffill": "forward fill",
        "bfill": "backward fill",
        "unicode": "normalize unicode",
        "strip": "strip spasi",
        "ascii": "hapus non-ASCII",
        "title": "Smart Title Case",
        "upper": "UPPERCASE",
        "lower": "lowercase",
        "sentence": "Sentence case",
        "clean": "Data sudah bersih",
    },
}


def action_text(action: Action, lang: str = "en") -> str:
    """One action in words."""
    words = ACTION_TEXTS[lang]
    if action.code == "ambiguous":
        return "⚠️ " + fv.AMBIGUOUS_WARNING.format(column=action.column, n=action.rows)
    if action.step in ("number", "date"):
        return words[action.code].format(c=action.column)
    if action.step == "drop":
        return words[action.code].format(n=action.rows)
    if action.step == "text":
        return f"'{action.column}': " + ", ".join(words[p] for p in action.code.split(","))
    kind, strategy = action.code.split(":")
    if strategy in ("keep_nat", "interpolate", "ffill", "bfill"):
        how = words[strategy]
    elif kind == "text":
        how = f"'{action.detail}'"
    elif strategy == "mean":
        how = f"mean ({float(action.detail):.2f})" if action.detail else "mean (nan)"
    else:
        how = f"{strategy} ({action.detail or 'nan'})"
    key = {"numeric": "numeric", "datetime": "datetime_fill", "text": "text_fill"}[kind]
    return words[key].format(c=action.column, n=action.rows, how=how)
