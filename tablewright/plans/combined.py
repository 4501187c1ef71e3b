"""Combining several tables and cleaning the outcome."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.config import CleanConfig
from tablewright.functions import fixed_values as fv
from tablewright.functions.compare import row_signature, signature_keys
from tablewright.operators import profile
from tablewright.operators.combine import (
    FILE_NO,
    SIGNATURE,
    JoinResult,
    align_columns,
    append_file_counts,
    check_column_set,
    classify_new,
    join_chain,
    stack,
    unite,
)
from tablewright.operators.dedupe import duplicate_provenance
from tablewright.operators.order import ROW_ORDER, file_order, quoted
from tablewright.operators.recommend import Recommendation, recommend_combine
from tablewright.operators.totals import drop_total_rows, is_total_row
from tablewright.plans.clean import finish, parse_columns, plan_and_parse, read_dates
from tablewright.plans.result import CleanResult, clean
from tablewright.plans.rules import CleanPlan, action_text
from tablewright.session import materialise

Tables = Mapping[str, DataFrame]


def _base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def metric_rows(df: DataFrame, pairs: Sequence[tuple[str, object]]) -> DataFrame:
    """(metric, value) rows out of a one-row table."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), (F.col(v) if isinstance(v, str) else F.lit(v)).cast("bigint").alias("value"))
        for name, v in pairs
    ])))


# ---------------------------------------------------------------- merge


@dataclass(frozen=True)
class MergeResult:
    cleaned: CleanResult
    file_counts: DataFrame  # per file: rows, duplicates inside, duplicates across
    files: int

    @property
    def data(self) -> DataFrame:
        return self.cleaned.data

    def summary(self) -> DataFrame:
        """(metric, value) of the merge."""
        dup = self.file_counts.agg(
            F.sum("rows").alias("rows"), F.sum("duplicates_inside").alias("inside"), F.sum("duplicates_across").alias("across")
        )
        return metric_rows(dup, [
            ("files", self.files), ("rows_in", "rows"), ("duplicates_inside", "inside"), ("duplicates_across", "across"),
        ]).unionByName(
            self.cleaned.run_metrics().select("metric", "value").where(
                F.col("metric").isin("duplicates_removed", "rows_dropped", "rows_out", "columns_out")
            )
        )


def clean_merged(
    tables: Tables,
    cfg: CleanConfig | None = None,
    source_col: str = fv.SOURCE_COLUMN,
    order_by: Sequence[str] | None = None,
) -> MergeResult:
    """Stack tables of equal columns, tag their source, count raw duplicates, clean.

    The source takes part in no rule.  Duplicate counts per file are taken on raw
    values, the number of removed rows on cleaned ones, so the two may differ.
    """
    raw = stack(tables, source_col, number=True)
    feature = [c for c in raw.columns if c not in (source_col, FILE_NO, ROW_ORDER)]
    counts = duplicate_provenance(raw, FILE_NO, feature)
    files = raw.sparkSession.createDataFrame(
        [(no, _base_name(name)) for no, name in enumerate(tables)], "no int, file string"
    )
    file_counts = (
        files.join(counts, F.col("no") == F.col("source"), "left")
        .select("no", "file", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
                                for c in ("rows", "duplicates_inside", "duplicates_across")])
    )
    cfg = (cfg or CleanConfig()).without(source_col, FILE_NO)
    result = clean(raw, cfg, [FILE_NO, *(file_order(raw, order_by) or ())], source=f"Merged ({len(tables)} files)")
    result = replace(result, data=result.data.drop(FILE_NO))
    return MergeResult(result, file_counts, len(tables))


# ---------------------------------------------------------------- join


@dataclass(frozen=True)
class JoinedResult:
    cleaned: CleanResult
    join: JoinResult

    @property
    def data(self) -> DataFrame:
        return self.cleaned.data

    @property
    def orphans(self) -> DataFrame:
        return self.join.orphans

    def stage_summary(self) -> DataFrame:
        """Stages with the rate and the flow in words."""
        rate = F.format_string("%.2f%%", F.col("match_rate"))
        return self.join.stages.select(
            "*", rate.alias("rate_text"),
            F.concat(F.col("left_name"), F.lit(" + "), F.col("right_name"), F.lit(" (key: "), F.col("key"),
                     F.lit(") → "), rate, F.lit(" match")).alias("flow"),
        )

    def summary(self) -> DataFrame:
        """(metric, value) of the join; rows in are those of the joined table."""
        orphans = metric_rows(self.join.orphans.agg(F.count("*").alias("n")), [("orphans", "n")])
        return self.cleaned.run_metrics().select("metric", "value").unionByName(orphans)


def clean_joined(
    tables: Tables,
    keys: str | Sequence[str],
    cfg: CleanConfig | None = None,
    how: str = "left",
    order_by: Sequence[str] | None = None,
) -> JoinedResult:
    """Chained left join, then clean the joined table (C4).

    The joined table feeds the statistics and the output, so it is written once
    to the shared scratch folder instead of being joined again for every pass.
    """
    joined = join_chain(tables, keys, how)
    data = materialise(joined.data, "joined")
    return JoinedResult(clean(data, cfg, order_by, source=f"Joined ({len(tables)} files)"), joined)


# ---------------------------------------------------------------- append


@dataclass(frozen=True)
class AppendResult:
    data: DataFrame  # base and added rows
    added: DataFrame
    skipped: DataFrame
    file_counts: DataFrame
    base: DataFrame
    classified: DataFrame
    plans: Mapping[int, CleanPlan]
    names: Mapping[int, str]
    base_total_rows: DataFrame

    def summary(self) -> DataFrame:
        """(metric, value) of the append."""
        counts = self.file_counts.agg(
            F.sum("rows_read").alias("read"), F.sum("added").alias("added"),
            F.sum(F.col("skipped_in_base") + F.col("skipped_in_file")).alias("skipped"),
        )
        new = metric_rows(counts, [("rows_read", "read"), ("rows_added", "added"), ("rows_skipped", "skipped")])
        base = metric_rows(self.base.agg(F.count("*").alias("n")), [("base_rows", "n")])
        footer = metric_rows(self.base_total_rows.agg(F.count("*").alias("n")), [("base_total_rows_removed", "n")])
        final = (
            base.unionByName(new.where("metric = 'rows_added'"))
            .agg(F.sum("value").alias("n")).select(F.lit("final_rows").alias("metric"), F.col("n").alias("value"))
        )
        return base.unionByName(new).unionByName(final).unionByName(footer)

    def cleaning_summary(self, lang: str = "en") -> DataFrame:
        """Per new file: rows before and after cleaning, what was removed and done."""
        spark = self.data.sparkSession
        rows = []
        for no, plan in self.plans.items():
            done = "; ".join(action_text(a, lang) for a in plan.actions()) or fv.ALREADY_CLEAN
            rows.append((no, self.names[no], plan.rows_in, plan.rows_dropped, done))
        told = spark.createDataFrame(rows, f"{FILE_NO} int, file string, rows_before bigint, rows_dropped bigint, actions string")
        left = self.classified.groupBy(FILE_NO).agg(F.count("*").alias("n"))
        after = F.coalesce("n", F.lit(0).cast("bigint"))
        return told.join(left, FILE_NO, "left").select(
            FILE_NO, "file", "rows_before", after.alias("rows_after"),
            (F.col("rows_before") - F.col("rows_dropped") - after).alias("duplicates_removed"),
            "rows_dropped", "actions",
        )


def stack_new(base_name: str, columns: Sequence[str], new: Tables, source_col: str | None) -> DataFrame:
    """New tables in base column order, footers removed, numbered and tagged."""
    parts = []
    for no, (name, df) in enumerate(new.items()):
        check_column_set(base_name, columns, _base_name(name), df.columns)
        part = align_columns(drop_total_rows(df), columns).withColumn(FILE_NO, F.lit(no))
        parts.append(part.withColumn(source_col, F.lit(_base_name(name))) if source_col else part)
    return unite(*parts)


def _match_base_types(base: DataFrame, plans: Mapping[int, CleanPlan]) -> DataFrame:
    """Read a text column of the base as numbers where the new files are read so
    and every base value can be read too; otherwise the base stays as it is."""
    kinds = {c: k for p in plans.values() for c, k in p.numbers.items()}
    texts = [c for c in profile.string_columns(base) if c in kinds]
    if not texts:
        return base
    plan = CleanPlan(tuple(base.columns), numbers={c: kinds[c] for c in texts},
                     decimal_style=next(iter(plans.values())).decimal_style)
    both = parse_columns(base.withColumns({f"_raw{i}": quoted(c) for i, c in enumerate(texts)}), {None: plan})
    lost = profile.measure(
        both, {(c, "lost"): F.count_if(quoted(c).isNull() & F.col(f"_raw{i}").isNotNull()) for i, c in enumerate(texts)}
    )[None]
    whole = [c for c in texts if not lost[(c, "lost")]]
    return parse_columns(base, {None: replace(plan, numbers={c: kinds[c] for c in whole})}) if whole else base


def append_tables(
    base: DataFrame,
    new: Tables | DataFrame,
    cfg: CleanConfig | None = None,
    keys: Sequence[str] | None = None,
    source_col: str | None = None,
    base_name: str = "base",
    order_by: Sequence[str] | None = None,
    compare: str = "parsed",
    hot_rows: int = 1_000_000,
) -> AppendResult:
    """Add to ``base`` the rows of new tables that are not there yet.

    The base only has its dates read and TOTAL footers removed.  New tables are
    cleaned each with its own statistics, but all in one plan.  Rows are compared
    by the canonical values of ``keys`` (all columns without them); a file's rows
    count as base rows for the files after it.

    Signatures of new rows are taken after parsing and before empty cells are
    filled, so appending the same file twice adds nothing the second time;
    ``compare="filled"`` compares the filled values instead.  The source column
    is never compared, nor is the place in the files: where all new tables were read with it (``_ord``)
    it tells which of equal rows comes first.
    """
    if isinstance(new, DataFrame):
        new = {"new": new}
    if not new:
        raise ValueError("Append needs at least one new table.")
    cfg = cfg or CleanConfig()
    base, placed = base.drop(ROW_ORDER), all(ROW_ORDER in d.columns for d in new.values())
    columns = [c for c in base.columns if c != source_col]
    if source_col:
        cfg = cfg.without(source_col)
    cfg = cfg.without(FILE_NO, ROW_ORDER)

    raw_base = base
    base = drop_total_rows(base)
    base = read_dates(base, cfg, order_by)
    if source_col and source_col not in base.columns:
        base = base.withColumn(source_col, F.lit(base_name))

    names = {no: _base_name(n) for no, n in enumerate(new)}
    aside = [c for c in (source_col, None if placed else ROW_ORDER) if c]
    incoming = stack_new(base_name, [*columns, *([ROW_ORDER] if placed else [])], {n: d.drop(*aside) for n, d in new.items()}, source_col)
    order_by = file_order(incoming, order_by)
    plans, parsed = plan_and_parse(incoming, cfg, FILE_NO, order_by)
    for no in names:  # a file without rows
        plans.setdefault(no, CleanPlan(tuple(c for c in incoming.columns if c != FILE_NO), exempt=cfg.exempt))
    active = {g: p for g, p in plans.items() if p.rows_in} or plans
    base = _match_base_types(base, active)
    compared = signature_keys(columns, keys)

    def sign(df: DataFrame) -> DataFrame:
        return df.withColumn(SIGNATURE, row_signature(df, compared))

    cleaned = finish(
        parsed, active, FILE_NO, order_by, carry=[SIGNATURE], between=sign if compare == "parsed" else None
    )
    if compare == "filled":
        cleaned = sign(cleaned)
    signed_base = sign(base)
    classified = classify_new(signed_base, cleaned, order_by, hot_rows)

    visible = [c for c in cleaned.columns if c not in (FILE_NO, SIGNATURE, ROW_ORDER)]
    added = classified.where(F.col("reason").isNull()).select(*[quoted(c) for c in visible])
    file_names = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(FILE_NO))
    skipped = classified.where(F.col("reason").isNotNull()).select(
        *[quoted(c) for c in visible], file_names.alias(fv.ORIGIN_COLUMN), F.col("reason").alias(fv.REASON_COLUMN)
    )
    shown = [c for c in base.columns if c in visible]
    final = unite(align_columns(base, shown), align_columns(added, shown))
    counts = append_file_counts(classified, names, {no: p.rows_in for no, p in plans.items()})
    return AppendResult(
        final, added, skipped, counts, base, classified, plans, names, raw_base.where(is_total_row(raw_base))
    )


# ---------------------------------------------------------------- others


def combine_auto(
    tables: Tables, cfg: CleanConfig | None = None, order_by: Sequence[str] | None = None
) -> tuple[Recommendation, MergeResult | JoinedResult]:
    """Choose stack or join from the headers and run it; undecided is an error."""
    advice = recommend_combine({n: df.columns for n, df in tables.items()})
    if advice.mode == "unknown":
        raise ValueError(advice.reason)
    if advice.mode == "merge":
        return advice, clean_merged(tables, cfg, order_by=order_by)
    chain = {n: tables[n] for n in advice.chain}
    return advice, clean_joined(chain, advice.keys, cfg, order_by=order_by)


def clean_batch(
    sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
    cfg: CleanConfig | None = None,
    sink: Callable[[str, DataFrame], None] | None = None,
) -> tuple[dict[str, CleanResult], list[tuple[str, bool, str]]]:
    """Clean each table on its own and go on after a failure.

    Returns the results and a status line (name, ok, error) per table.  A source
    may be a function, so that a file that cannot be read is one failed line.
    """
    results, status = {}, []
    for name, source in sources.items():
        try:
            result = clean(source() if callable(source) else source, cfg, source=name)
            if sink is not None:
                sink(name, result.data)
            results[name] = result
            status.append((name, True, ""))
        except Exception as error:  # noqa: BLE001 - one bad file must not stop the others
            status.append((name, False, f"{type(error).__name__}: {error}".splitlines()[0]))
    return results, status


def clean_simple(df: DataFrame, order_by: Sequence[str] | None = None) -> CleanResult:
    """The short cleaning (C8): median and "Unknown", first of duplicates, trim, title
    case for names; text columns named "tanggal" or "date" become dates and what
    cannot be read there becomes null."""
    named = tuple(
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and any(w in f.name.lower() for w in ("tanggal", "date"))
    )
    cfg = CleanConfig.simple().with_(date={"date_columns": named, "min_rate": 0.0})
    return clean(df, cfg, order_by)
