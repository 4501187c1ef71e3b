"""What is in the columns: one pass of aggregates for all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.config import CleanConfig, DateConfig, NumberConfig
from tablewright.functions import dates, fixed_values as fv, numbers
from tablewright.functions.names import name_matches
from tablewright.operators.order import quoted

COLUMNS_PER_PASS = 100


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one notion of "missing" here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def resolve_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Configured names that exist, in the given order; unknown ones are ignored."""
    return [n for n in dict.fromkeys(names) if n in df.columns]


def measure(df: DataFrame, measures: Mapping[tuple[str, str], Column], by: str | None = None) -> dict:
    """Run many aggregates in as few passes as possible.

    ``measures`` is keyed by (column, measure).  The result maps the group value
    (None without ``by``) to a dictionary with the same keys.  What reaches the
    driver grows with the number of columns and groups, never with rows.
    """
    out: dict = {}
    columns = list(dict.fromkeys(c for c, _ in measures))
    for at in range(0, len(columns), COLUMNS_PER_PASS):
        block = set(columns[at : at + COLUMNS_PER_PASS])
        keys = [k for k in measures if k[0] in block]
        aggs = [measures[k].alias(f"m{i}") for i, k in enumerate(keys)]
        grouped = df.groupBy(quoted(by).alias("_by")).agg(*aggs) if by else df.agg(*aggs)
        for row in grouped.collect():
            bucket = out.setdefault(row["_by"] if by else None, {})
            bucket.update({k: row[f"m{i}"] for i, k in enumerate(keys)})
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) for every column, from one aggregate (A1)."""
    row = nan_to_null(df).agg(
        F.count("*").alias("rows"),
        *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col("rows"))
        for i, c in enumerate(df.columns)
    ])
    return row.select(F.inline(pairs))


def table_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def _melt(df: DataFrame, cols: Sequence[str], by: str | None) -> DataFrame:
    """(group, column number, value) rows of text columns.

    One set of measures then serves all columns, so the generated code stays
    small however wide the table is; the rows are combined where they are made.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("no"), quoted(c).alias("v")) for i, c in enumerate(cols)])
    group = [quoted(by).alias("_by")] if by else []
    return df.select(*group, F.inline(pairs))


def _shape_features(melted: DataFrame) -> DataFrame:
    """What is asked about a single value.

    The tests are built up in steps, from cheap to costly: a value without letters
    or currency marks has nothing to strip, one without digits is no number and no
    date, and only a date-like value is split.
    """
    v, s = F.col("v"), F.col("s")
    step = melted.where(v.isNotNull()).withColumns({
        "s": numbers.trim_all(v), "noisy": v.rlike(numbers.NOISY), "digit": v.rlike(r"\d"),
    })
    step = step.withColumn("bare", F.when(F.col("noisy") & F.col("digit"), numbers.strip_noise(v)).otherwise(s))
    step = step.withColumns({
        "stripped_numeric": F.col("digit") & numbers.numeric_like(F.col("bare")),
        "date": F.col("digit") & dates.looks_like_date(s),
        "currency": F.col("noisy") & numbers.has_currency(v),
        "percent": F.col("digit") & numbers.percent_like(v),
        "non_ascii": F.length(v) != F.octet_length(v),
    })
    step = step.withColumns({
        "numeric": ~F.col("noisy") & F.col("stripped_numeric"),
        "day_month": F.when(F.col("date"), dates.year_last_text(s)),
    })
    return step.withColumns(dates.day_month_columns(F.col("day_month")))


def _shape_aggregates() -> dict[str, Column]:
    """Shares that tell money, percentages, numbers and dates apart (P6, P7), and the
    evidence for the order of day and month (A9)."""
    def share(flag: str) -> Column:
        return F.avg(F.col(flag).cast("double"))

    return {
        "known": F.count("*"),
        "stripped_numeric": share("stripped_numeric"),
        "currency": F.max("currency"),
        "percent": share("percent"),
        "numeric": share("numeric"),
        "date": share("date"),
        "non_ascii": F.max("non_ascii"),
        **dates.evidence_measures(F.col("sep"), F.col("a"), F.col("b")),
    }


# measures of a column without a single value
_EMPTY = {
    "known": 0, "stripped_numeric": 0.0, "currency": False, "percent": 0.0, "numeric": 0.0, "date": 0.0,
    "non_ascii": False,
    **{f"{k}{i}": z for i in range(len(dates.SEPARATORS)) for k, z in (("rows", 0), ("day", False), ("month", False), ("either", 0))},
}


def number_kind(name: str, m: Mapping[str, object], cfg: NumberConfig, match: str) -> str | None:
    """currency, percent or number - asked in this order - or None.

    The name test for phones and identifiers protects plain numbers only.
    """
    if name in cfg.currency_columns:
        return "currency"
    if name in cfg.percent_columns:
        return "percent"
    if name in cfg.number_columns:
        return "number"
    if not cfg.auto_detect or not m["known"]:
        return None
    if m["currency"] and m["stripped_numeric"] > 0.7:
        return "currency"
    if m["percent"] > 0.5:
        return "percent"
    if m["numeric"] > 0.7 and not name_matches(name, fv.IDENTIFIER_NAMES, match):
        return "number"
    return None


def is_date_candidate(name: str, m: Mapping[str, object], cfg: DateConfig, match: str) -> bool:
    """Date by configuration, by name, or because most values look like one."""
    if name in cfg.date_columns:
        return True
    if not cfg.auto_detect or not m["known"]:
        return False
    return name_matches(name, fv.DATE_NAMES, match) or m["date"] > 0.5


def shape_profile(
    df: DataFrame,
    cols: Sequence[str],
    by: str | None = None,
) -> dict:
    """Shape shares and date evidence of text columns, per group of ``by`` if given;
    groups without any text value are left out.

    One pass over the text columns; the whole column counts.
    """
    if not cols:
        return {}
    aggregates = _shape_aggregates()

    def run(table: DataFrame, group: str | None) -> dict:
        keys = ["no", *(["_by"] if group else [])]
        out: dict = {} if group else {None: {}}
        aggs = [a.alias(k) for k, a in aggregates.items()]
        for row in _shape_features(_melt(table, cols, group)).groupBy(*keys).agg(*aggs).collect():
            found = out.setdefault(row["_by"] if group else None, {})
            found[cols[row["no"]]] = {k: row[k] for k in aggregates}
        return out

    full = run(df, by)
    return {g: {c: {**_EMPTY, **found.get(c, {})} for c in cols} for g, found in full.items()}


@dataclass(frozen=True)
class Detected:
    """Kinds found per column, and the date evidence behind them."""

    numbers: Mapping[str, str]
    dates: tuple[str, ...]
    measures: Mapping[str, Mapping[str, object]]


def decide(cols: Sequence[str], measures: Mapping[str, Mapping[str, object]], cfg: CleanConfig) -> Detected:
    kinds = {c: number_kind(c, measures[c], cfg.number, cfg.match) for c in cols}
    kinds = {c: k for c, k in kinds.items() if k}
    candidates = tuple(
        c for c in cols if c not in kinds and is_date_candidate(c, measures[c], cfg.date, cfg.match)
    )
    return Detected(kinds, candidates, measures)


def detect_columns(df: DataFrame, cfg: CleanConfig | None = None, order_by: Sequence[str] | None = None) -> Detected:
    """Which text columns are money, percentages, numbers or dates.

    Only text columns are ever converted; a number rule wins over a date rule.
    """
    cfg = cfg or CleanConfig()
    cols = [c for c in string_columns(df) if c not in cfg.exempt]
    if not cols:
        return Detected({}, (), {})
    found = shape_profile(df, cols)
    return decide(cols, found[None], cfg)


def detected_table(df: DataFrame, cfg: CleanConfig | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, known) of the detected columns."""
    found = detect_columns(df, cfg, order_by)
    rows = [(c, k, int(found.measures[c]["known"])) for c, k in found.numbers.items()]
    rows += [(c, "date", int(found.measures[c]["known"])) for c in found.dates]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, known bigint")


def date_evidence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, separator, rows, day_first_proof, month_first_proof, either_way).

    Lazy: one aggregate over the melted columns, grouped by column and separator.
    """
    names = F.array(*[F.lit(c) for c in cols])
    known = _melt(df, cols, None).select("no", dates.year_last_text(F.col("v")).alias("v")).where("v is not null")
    return (
        known.withColumns(dates.day_month_columns(F.col("v")))
        .groupBy("no", "sep")
        .agg(
            F.count("*").alias("rows"),
            F.max(F.col("a") > 12).alias("day_first_proof"),
            F.max(F.col("b") > 12).alias("month_first_proof"),
            F.count_if((F.col("a") <= 12) & (F.col("b") <= 12) & (F.col("a") != F.col("b"))).alias("either_way"),
        )
        .select(F.get(names, F.col("no")).alias("column"), F.col("sep").alias("separator"),
                "rows", "day_first_proof", "month_first_proof", "either_way")
    )


def count_ambiguous(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, ambiguous): rows readable both ways where the evidence is not one-sided (A10)."""
    one_sided = F.col("day_first_proof") != F.col("month_first_proof")
    return (
        date_evidence(df, cols)
        .groupBy("column")
        .agg(F.sum(F.when(one_sided, 0).otherwise(F.col("either_way"))).alias("ambiguous"))
    )
