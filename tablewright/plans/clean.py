"""Cleaning a table: numbers, dates, missing values, duplicates, text (C1, C1a-C1e).

The work is split in two.  :func:`plan_tables` looks at the data with a few
aggregates and returns frozen plans; :func:`apply_plans` is lazy and turns a
plan into column expressions, at most one shuffle for the duplicates, and a
bucketed window where a fill needs the row order.

Several tables can be planned together: rows carry a table number in the column
``by``, the aggregates are grouped by it, and the expressions choose between the
rule variants found.  A thousand files thus cost as many passes as one.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.config import CleanConfig
from tablewright.functions import dates, numbers, text
from tablewright.functions import fixed_values as fv
from tablewright.functions.names import is_name_or_title_column
from tablewright.operators import profile
from tablewright.operators.carry import carry_fill
from tablewright.operators.dedupe import dedupe
from tablewright.operators.impute import drop_sparse_rows, fill_type, fill_values_by
from tablewright.operators.order import quoted
from tablewright.plans.rules import CleanPlan, DateRule, FillRule, TextRule

CARRIED = ("ffill", "bfill", "interpolate")
RAW_SUFFIX = "__raw"
Plans = Mapping[object, CleanPlan]


# ------------------------------------------------------------------ planning


def plan_clean(df: DataFrame, cfg: CleanConfig | None = None, order_by: Sequence[str] | None = None) -> CleanPlan:
    """Decisions for one table."""
    return plan_tables(df, cfg or CleanConfig(), order_by=order_by)[None]


def plan_tables(
    df: DataFrame, cfg: CleanConfig, by: str | None = None, order_by: Sequence[str] | None = None
) -> dict[object, CleanPlan]:
    """Decisions per table number in ``by`` (the key is None without ``by``)."""
    return plan_and_parse(df, cfg, by, order_by)[0]


def plan_and_parse(
    df: DataFrame, cfg: CleanConfig, by: str | None = None, order_by: Sequence[str] | None = None
) -> tuple[dict[object, CleanPlan], DataFrame]:
    """Plans, and the table with its numbers and dates read (lazily).

    Pass 1 measures the raw text columns, pass 2 counts what the parsed columns
    look like; fill statistics are one more aggregate over the columns that have
    nulls.  What reaches the driver grows with columns and tables, not with rows.
    """
    hidden = {by} if by else set()
    columns = tuple(c for c in df.columns if c not in hidden)
    df = profile.nan_to_null(df)
    texts = [c for c in profile.string_columns(df) if c in columns and c not in cfg.exempt]
    shapes = profile.shape_profile(df, texts, by) or ({} if by else {None: {}})
    plans, parsed = _plan_parsing(df, shapes, texts, columns, cfg, by)
    plans = _plan_fills(parsed, plans, by, cfg)
    return _plan_text(plans, texts, shapes, cfg), parsed


def read_dates(df: DataFrame, cfg: CleanConfig, order_by: Sequence[str] | None = None) -> DataFrame:
    """The date step alone, for a table that is otherwise left as it is."""
    cfg = cfg.with_(number={"auto_detect": False, "number_columns": (), "currency_columns": (), "percent_columns": ()})
    df = profile.nan_to_null(df)
    texts = [c for c in profile.string_columns(df) if c not in cfg.exempt]
    shapes = profile.shape_profile(df, texts, None) or {None: {}}
    return _plan_parsing(df, shapes, texts, tuple(df.columns), cfg, None)[1]


def _plan_parsing(
    df: DataFrame, shapes: Mapping, texts: Sequence[str], columns: tuple[str, ...], cfg: CleanConfig, by: str | None
) -> tuple[dict, DataFrame]:
    """Number kinds and date rules from the measured shapes, then one pass over the
    parsed columns that counts what is missing and what could not be read."""
    blank = CleanPlan(
        columns=columns,
        decimal_style=cfg.number.decimal_style,
        keep_raw=cfg.number.on_unparsed == "keep_raw_column",
        drop_threshold=cfg.missing.drop_threshold,
        duplicate=cfg.duplicate,
        title=cfg.text,
        exempt=cfg.exempt,
    )
    plans = {}
    for group, measures in shapes.items():
        found = profile.decide(texts, measures, cfg)
        rules = {
            c: DateRule(dates.month_first_by_separator(measures[c]), None, dates.ambiguous_rows(measures[c]))
            for c in found.dates
        }
        plans[group] = replace(blank, numbers=dict(found.numbers), dates=rules)
    plans, parsed = _count_missing(df, _one_type_per_column(plans, shapes), by, shapes, blank)
    checked = _check_dates(df, plans, by, cfg, shapes)
    return (plans, parsed) if checked is plans else _count_missing(df, checked, by, shapes, blank)


def _known(shapes: Mapping, group, column: str) -> int:
    return shapes.get(group, {}).get(column, {}).get("known", 0)


def _one_type_per_column(plans: dict, shapes: Mapping) -> dict:
    """Tables that are stacked must agree on a column's type.

    Where some read a column as numbers (or dates) and others hold text in it, it
    stays text in all; tables without a value in the column have no say and follow.
    """
    if len(plans) < 2:
        return plans
    out = dict(plans)
    for c in next(iter(plans.values())).columns:
        voters = {g: p for g, p in plans.items() if _known(shapes, g, c)}
        kinds = {("n" if c in p.numbers else "d" if c in p.dates else "t") for p in voters.values()}
        leader = next(iter(voters.values()), None)
        for g, p in out.items():
            numbers_ = {k: v for k, v in p.numbers.items() if k != c}
            dates_ = {k: v for k, v in p.dates.items() if k != c}
            if len(kinds) == 1:
                own = p if g in voters else leader
                numbers_.update({c: own.numbers[c]} if c in own.numbers else {})
                dates_.update({c: own.dates[c]} if c in own.dates else {})
            out[g] = replace(p, numbers=numbers_, dates=dates_)
    return out


def _check_dates(df: DataFrame, plans: dict, by: str | None, cfg: CleanConfig, shapes: Mapping) -> dict:
    """Keep a date reading only if it reads at least half of the known values.

    Otherwise the known formats are tried one by one, and a column none of them
    fits stays text.  Without a failing column no further pass is made.
    """

    def rate(g, c) -> float:
        known = _known(shapes, g, c)
        return (known - plans[g].unparsed[c]) / known if known else 1.0

    failing = [c for c in dict.fromkeys(c for p in plans.values() for c in p.dates)
               if any(c in p.dates and rate(g, c) < cfg.date.min_rate for g, p in plans.items())]
    if not failing:
        return plans

    def share(c: str, f: str) -> Column:
        return F.avg(F.when(quoted(c).isNotNull(), dates.parse_with_format(quoted(c), f).isNotNull().cast("double")))

    formats = profile.measure(df, {(c, f): share(c, f) for c in failing for f in fv.DATE_FORMATS}, by)
    out = {}
    for g, p in plans.items():
        rules = {}
        for c, rule in p.dates.items():
            if rate(g, c) >= cfg.date.min_rate:
                rules[c] = rule
                continue
            fitting = [f for f in fv.DATE_FORMATS if (formats[g][(c, f)] or 0.0) >= cfg.date.min_rate]
            if fitting:
                rules[c] = DateRule(fixed_format=fitting[0])
        out[g] = replace(p, dates=rules)
    return _one_type_per_column(out, shapes)


def _count_missing(df: DataFrame, plans: dict, by: str | None, shapes: Mapping, blank: CleanPlan) -> tuple[dict, DataFrame]:
    """Rows, nulls after parsing, and values that could not be read (pass 2).

    Tables that held no text value appear here first and get the ``blank`` plan,
    with the columns' types of the others."""
    any_plan = next(iter(plans.values()), blank)
    plans = plans or {None: blank}
    measures = {("", "rows"): F.count("*")}
    for c in any_plan.columns:
        measures[(c, "nulls")] = F.count_if(quoted(c).isNull())
    parsed = parse_columns(df, plans, by)
    after = profile.measure(parsed, measures, by)
    out = {}
    for g in sorted(after, key=str):
        p = plans.get(g) or replace(blank, numbers=any_plan.numbers, dates=any_plan.dates)
        rows = after[g][("", "rows")]
        nulls = {c: after[g][(c, "nulls")] for c in p.columns}
        # a value that was known before and is null now could not be read
        unparsed = {c: nulls[c] - (rows - _known(shapes, g, c)) for c in (*p.numbers, *p.dates)}
        out[g] = replace(p, rows_in=rows, missing=nulls, unparsed=unparsed)
    return out, parsed


def _plan_fills(parsed: DataFrame, plans: dict, by: str | None, cfg: CleanConfig) -> dict:
    wanted = cfg.missing
    if not any(any(p.missing[c] for c in p.subject) for p in plans.values()):
        return {g: replace(p, drop_threshold=None) for g, p in plans.items()}
    parsed = drop_rows(parsed, plans, by)
    kinds = {
        f.name: "numeric" if isinstance(f.dataType, (T.NumericType, T.BooleanType))
        else "datetime" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        else "text" if isinstance(f.dataType, T.StringType) else None
        for f in parsed.schema.fields
    }
    numeric = wanted.numeric_strategy
    if numeric not in ("mean", "mode", "constant", "interpolate"):
        numeric = "median"
    kept, missing = _after_drop(parsed, plans, by)
    # a table without a single null is left alone, as a whole
    holes = {g: [c for c in p.subject if missing[g][c] and kinds[c]] for g, p in plans.items()}

    def needs(test: Callable[[str], bool]) -> dict[object, dict[str, int]]:
        return {g: {c: kept[g] - missing[g][c] for c in holes[g] if test(c)} for g in plans}

    flags = {c for c, k in kinds.items() if k == "numeric" and isinstance(parsed.schema[c].dataType, T.BooleanType)}
    values: dict[object, dict[str, object]] = {g: {} for g in plans}
    wishes = [(numeric, lambda c: kinds[c] == "numeric" and c not in flags and numeric in ("median", "mean", "mode")),
              ("mode", lambda c: c in flags and numeric != "constant"),
              ("mode", lambda c: kinds[c] == "datetime" and wanted.datetime_strategy == "mode")]
    for strategy, test in wishes:
        for g, found in fill_values_by(parsed, by, needs(test), strategy).items():
            # an empty date column has no mode, so nothing replaces its gaps
            values[g].update({c: v for c, v in found.items() if kinds[c] != "datetime" or v != 0})
    out = {}
    for g, p in plans.items():
        fills = {}
        for c in holes[g]:
            if kinds[c] == "numeric":
                strategy = "mode" if c in flags and numeric != "constant" else numeric
                value = wanted.numeric_constant if strategy == "constant" else values[g].get(c)
            elif kinds[c] == "datetime":
                strategy, value = wanted.datetime_strategy, values[g].get(c)
                if strategy not in ("mode", "ffill", "bfill"):
                    strategy = "keep_nat"
            else:
                strategy = wanted.text_strategy if wanted.text_strategy in ("ffill", "bfill") else "constant"
                value = wanted.text_constant
            fills[c] = FillRule(kinds[c], strategy, value, missing[g][c])
        out[g] = replace(p, fills=fills, rows_dropped=p.rows_in - kept[g])
    return out


def _after_drop(parsed: DataFrame, plans: dict, by: str | None) -> tuple[dict, dict]:
    """Rows, and nulls per column, that sparse rows leave behind in each table."""
    if not any(p.drop_threshold and 0 < p.drop_threshold <= 1 for p in plans.values()):
        return {g: p.rows_in for g, p in plans.items()}, {g: p.missing for g, p in plans.items()}
    columns = list(dict.fromkeys(c for p in plans.values() for c in p.columns))
    measures = {("", "rows"): F.count("*")} | {(c, "nulls"): F.count_if(quoted(c).isNull()) for c in columns}
    counted = profile.measure(parsed, measures, by)
    found = {g: counted.get(g, {}) for g in plans}
    return (
        {g: found[g].get(("", "rows"), 0) for g in plans},
        {g: {c: found[g].get((c, "nulls"), 0) for c in p.columns} for g, p in plans.items()},
    )


def _plan_text(plans: dict, texts: Sequence[str], shapes: Mapping, cfg: CleanConfig) -> dict:
    t = cfg.text
    out = {}
    for g, p in plans.items():
        rules = {}
        for c in texts:
            if c in p.numbers or c in p.dates or c in t.exclude_columns:
                continue
            if not _known(shapes, g, c) and p.fills.get(c) is None:
                continue
            if t.case_columns:
                cased = c in t.case_columns
            elif t.case_format == "title" and t.only_name_columns:
                cased = is_name_or_title_column(c, cfg.match)
            else:
                cased = True
            foreign = bool(shapes.get(g, {}).get(c, {}).get("non_ascii")) or not _ascii_fill(p.fills.get(c))
            rules[c] = TextRule(
                t.normalize_unicode, t.normalize_unicode and foreign, t.strip_whitespace,
                t.collapse_whitespace, t.remove_non_ascii, t.case_format if cased else None,
            )
        out[g] = replace(p, text=rules)
    return out


def _ascii_fill(fill: FillRule | None) -> bool:
    return fill is None or fill.value is None or str(fill.value).isascii()


# ------------------------------------------------------------------ applying


def _choose(plans: Plans, by: str | None, variant: Callable[[CleanPlan], Hashable], build: Callable[[object], Column]) -> Column:
    """The expression of each table's rule variant; a plain one when all agree."""
    groups: dict[Hashable, list] = {}
    for g, p in plans.items():
        groups.setdefault(variant(p), []).append(g)
    variants = sorted(groups.items(), key=lambda item: len(item[1]))
    if by is None or len(variants) == 1:
        return build(variants[-1][0])
    expr = None
    for value, members in variants[:-1]:
        test = quoted(by).isin(*members)
        expr = F.when(test, build(value)) if expr is None else expr.when(test, build(value))
    return expr.otherwise(build(variants[-1][0]))


def _date_variant(rule: DateRule | None) -> Hashable:
    if rule is None:
        return None
    return rule.fixed_format, tuple(s for s, flag in rule.month_first.items() if flag)


def _parsed_date(column: str, plans: Plans, by: str | None) -> Column:
    def build(variant):
        if variant is None:
            return F.lit(None).cast("timestamp_ntz")
        fixed, month_first = variant
        if fixed:
            return dates.parse_with_format(quoted(column), fixed)
        return dates.parse_date(quoted(column), dict.fromkeys(month_first, True))

    return _choose(plans, by, lambda p: _date_variant(p.dates.get(column)), build)


def _parsed_number(column: str, plans: Plans, by: str | None) -> Column:
    style = next(iter(plans.values())).decimal_style

    def build(kind):
        if kind == "percent":
            return numbers.parse_percent(quoted(column))
        return numbers.parse_number(quoted(column), style)

    return _choose(
        plans, by, lambda p: "percent" if p.numbers.get(column) == "percent" else "number", build
    )


def parse_columns(df: DataFrame, plans: Plans, by: str | None = None) -> DataFrame:
    """Number and date steps (C1a, C1b): text columns become doubles and timestamps.

    A column read as money or percentage carries its role in the column metadata.
    """
    df = profile.nan_to_null(df)
    first = next(iter(plans.values()))
    number_columns = {c: k for p in plans.values() for c, k in p.numbers.items()}
    date_columns = list(dict.fromkeys(c for p in plans.values() for c in p.dates))
    if not number_columns and not date_columns:
        return df
    cols, raws = [], []
    for c in df.columns:
        if c in number_columns:
            value = _parsed_number(c, plans, by)
            cols.append(value.alias(c, metadata={"role": number_columns[c]}))
        elif c in date_columns:
            value = _parsed_date(c, plans, by)
            cols.append(value.alias(c))
        else:
            cols.append(quoted(c))
            continue
        if first.keep_raw:
            raws.append(F.when(value.isNull(), quoted(c)).alias(c + RAW_SUFFIX))
    return df.select(*cols, *raws)


def drop_rows(df: DataFrame, plans: Plans, by: str | None = None) -> DataFrame:
    """Row drop of the missing step; tables without any null keep all their rows."""
    first = next(iter(plans.values()))
    return drop_sparse_rows(df, first.drop_threshold, first.subject)


def fill_missing(
    df: DataFrame, plans: Plans, by: str | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Missing step (C1c): constants by expression, neighbours by bucketed windows."""
    carried: dict[str, str] = {}
    for p in plans.values():
        carried.update({c: r.strategy for c, r in p.fills.items() if r.strategy in CARRIED})
    if carried:
        # order-based fills never reach across tables
        df = carry_fill(df, carried, order_by, within=by)
    filled = {}
    columns = list(dict.fromkeys(c for p in plans.values() for c in p.fills))
    for c in columns:
        rules = {g: p.fills[c] for g, p in plans.items() if c in p.fills}
        if all(r.value is None for r in rules.values()):
            continue
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.NumericType):
            for r in rules.values():
                dtype = fill_type(dtype, r.strategy, r.value)
        value = _fill_value(rules, by, dtype)
        filled[c] = F.coalesce(quoted(c).cast(dtype), value)
    return df.withColumns(filled) if filled else df


def _fill_value(rules: Mapping[object, FillRule], by: str | None, dtype: T.DataType) -> Column:
    values = {g: r.value for g, r in rules.items() if r.value is not None}
    if by is None or (len(set(map(str, values.values()))) == 1 and len(values) == len(rules)):
        return F.lit(next(iter(values.values()))).cast(dtype)
    pairs = [x for g, v in values.items() for x in (F.lit(g), F.lit(str(v)))]
    return F.element_at(F.create_map(*pairs), quoted(by)).cast(dtype)


def remove_duplicates(
    df: DataFrame, plans: Plans, by: str | None = None, order_by: Sequence[str] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Duplicate step (C1d).  ``by`` keeps tables apart; ``carry`` columns travel
    with the surviving row but are not compared."""
    p = next(iter(plans.values()))
    keys = list(p.duplicate.subset) if p.duplicate.subset else list(p.subject)
    return dedupe(df, [*keys, *([by] if by else [])], p.duplicate.keep, order_by, exclude=carry)


def normalise_text(df: DataFrame, plans: Plans, by: str | None = None) -> DataFrame:
    """Text step (C1e): NFKC, white space, non-ASCII, case - in this order."""
    columns = list(dict.fromkeys(c for p in plans.values() for c in p.text))
    title = next(iter(plans.values())).title
    options = dict(
        preserve_brackets=title.preserve_brackets,
        preserve_acronyms=title.preserve_acronyms,
        custom_acronyms=title.custom_acronyms,
    )
    out = {}
    for c in columns:
        rules = [p.text[c] for p in plans.values() if c in p.text]
        value = quoted(c)
        rule = rules[0]
        if any(r.needs_unicode for r in rules):
            value = text.nfkc(value)
        if rule.strip_whitespace:
            value = text.squeeze(value) if rule.collapse_whitespace else numbers.trim_all(value)
        if rule.remove_non_ascii:
            value = text.ascii_only(value)
        if rule.case_format == "title":
            value = text.smart_title(value, **options)
        else:
            value = text.apply_case(value, rule.case_format)
        out[c] = value
    return df.withColumns(out) if out else df


def apply_plans(
    df: DataFrame,
    plans: Plans,
    by: str | None = None,
    order_by: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    between: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All five steps, lazily."""
    return finish(parse_columns(df, plans, by), plans, by, order_by, carry, between)


def finish(
    parsed: DataFrame,
    plans: Plans,
    by: str | None = None,
    order_by: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    between: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The steps after parsing.  ``between`` may add columns before anything is
    filled (the append takes its row signatures there)."""
    out = between(parsed) if between is not None else parsed
    out = drop_rows(out, plans, by)
    out = fill_missing(out, plans, by, order_by)
    duplicate = next(iter(plans.values())).duplicate
    if duplicate.after_text:
        return remove_duplicates(normalise_text(out, plans, by), plans, by, order_by, carry)
    return normalise_text(remove_duplicates(out, plans, by, order_by, carry), plans, by)
