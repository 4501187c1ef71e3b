"""The result of cleaning one table, with its audit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.config import CleanConfig
from tablewright.functions.names import column_role
from tablewright.operators.order import ROW_ORDER, file_order, quoted
from tablewright.plans.clean import apply_plans, finish, plan_and_parse
from tablewright.plans.rules import CleanPlan, action_text


@dataclass(frozen=True)
class CleanResult:
    """Cleaned data (lazy) and the plan that produced it."""

    data: DataFrame
    plan: CleanPlan
    source: str = "DataFrame"

    def run_metrics(self) -> DataFrame:
        """(metric, value) - rows and columns in and out, what was removed.

        Rows in, dropped and repaired are known from the plan; only the rows out
        are counted here, by one aggregate.
        """
        p = self.plan
        kept = p.rows_in - p.rows_dropped
        repaired = sum(r.missing for r in p.fills.values() if r.value is not None or r.strategy in ("ffill", "bfill", "interpolate"))
        out = self.data.agg(F.count("*").alias("n"))
        pairs = [
            ("rows_in", F.lit(p.rows_in)), ("columns_in", F.lit(len(p.columns))),
            ("rows_dropped", F.lit(p.rows_dropped)), ("duplicates_removed", F.lit(kept) - F.col("n")),
            ("missing_found", F.lit(sum(p.missing.values()))), ("missing_repaired", F.lit(repaired)),
            ("unparsed", F.lit(sum(p.unparsed.values()))),
            ("rows_out", F.col("n")), ("columns_out", F.lit(len(self.data.columns))),
        ]
        entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("bigint").alias("value")) for k, v in pairs])
        return out.select(F.lit(self.source).alias("source"), F.inline(entries))

    def actions(self, lang: str = "en") -> DataFrame:
        """(column, step, code, rows, text): everything that was done, from the plan."""
        rows = [
            (i, a.column, a.step, a.code, a.rows, action_text(a, lang)) for i, a in enumerate(self.plan.actions())
        ]
        return self.data.sparkSession.createDataFrame(
            rows, "no int, column string, step string, code string, rows bigint, text string"
        )

    def column_status(self, lang: str = "en") -> DataFrame:
        """(no, column, type, missing_found, actions): one row per column."""
        from tablewright.plans.rules import ACTION_TEXTS

        schema = self.data.sparkSession.createDataFrame(
            [
                (i, f.name, f.dataType.simpleString(), int(self.plan.missing.get(f.name, 0)))
                for i, f in enumerate((f for f in self.data.schema.fields if f.name != ROW_ORDER), start=1)
            ],
            "no int, column string, type string, missing_found bigint",
        )
        done = self.actions(lang).groupBy("column").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda a: a["text"]), "; "
            ).alias("actions")
        )
        return (
            schema.join(done, "column", "left")
            .select(
                "no", "column", "type", "missing_found",
                F.coalesce("actions", F.lit(ACTION_TEXTS[lang]["clean"])).alias("actions"),
            )
            .orderBy("no")
        )

    def warnings(self) -> DataFrame:
        """(column, kind, rows): ambiguous dates and values that could not be read."""
        rows = [(c, "ambiguous_date", int(r.ambiguous)) for c, r in self.plan.dates.items() if r.ambiguous]
        rows += [(c, "unparsed", int(n)) for c, n in self.plan.unparsed.items() if n]
        return self.data.sparkSession.createDataFrame(rows, "column string, kind string, rows bigint")

    def roles(self, currency: str = "IDR", match: str = "word") -> DataFrame:
        return column_roles(self.data, currency, match)


def clean(
    df: DataFrame,
    cfg: CleanConfig | None = None,
    order_by: Sequence[str] | None = None,
    source: str = "DataFrame",
) -> CleanResult:
    """Numbers, dates, missing values, duplicates, text - in this order.

    The median is taken before duplicates are removed, and duplicates are compared
    before text is normalised (``duplicate.after_text`` changes that).  ``order_by``
    defines "first", "last", forward and backward; without it the place in the files does (a
    column ``_ord``, which no rule touches), else all columns.
    """
    cfg, order_by = (cfg or CleanConfig()).without(ROW_ORDER), file_order(df, order_by)
    plans, parsed = plan_and_parse(df, cfg, order_by=order_by)
    return CleanResult(finish(parsed, plans, order_by=order_by), plans[None], source)


def clean_with_plan(df: DataFrame, plan: CleanPlan, order_by: Sequence[str] | None = None) -> DataFrame:
    """Apply a stored plan to a table with the same columns; reads no statistics."""
    return apply_plans(df, {None: plan}, order_by=file_order(df, order_by))


def clean_tables(
    tables: Mapping[str, DataFrame],
    select: str | Sequence[str] | None = None,
    every: bool = False,
    cfg: CleanConfig | None = None,
    order_by: Sequence[str] | None = None,
) -> dict[str, CleanResult]:
    """Clean chosen tables of a set, each on its own.

    ``select`` is a list or a comma-separated text; without it only the first
    table is cleaned, with ``every`` all of them.  Unknown names are an error.
    """
    names = list(tables)
    if every:
        wanted = names
    elif select is None:
        wanted = names[:1]
    elif isinstance(select, str):
        wanted = [s.strip() for s in select.split(",") if s.strip()]
    else:
        wanted = list(select)
    wanted = [names[w] if isinstance(w, int) else w for w in wanted]
    unknown = [w for w in wanted if w not in tables]
    if unknown:
        raise ValueError(f"Unknown tables {unknown}; available: {', '.join(names)}")
    return {w: clean(tables[w], cfg, order_by, source=w) for w in wanted}


def tables_summary(results: Mapping[str, CleanResult]) -> tuple[DataFrame, DataFrame]:
    """One metrics row set and one column status per table, stacked."""
    metrics = status = None
    for name, result in results.items():
        m = result.run_metrics().withColumn("table_name", F.lit(name))
        s = result.column_status().withColumn("table_name", F.lit(name))
        metrics = m if metrics is None else metrics.unionByName(m)
        status = s if status is None else status.unionByName(s)
    return metrics, status


def column_roles(df: DataFrame, currency: str = "IDR", match: str = "word") -> DataFrame:
    """(no, column, type, role, mask): how each column is shown (P10)."""
    rows = []
    for i, f in enumerate(df.schema.fields, start=1):
        kind = f.dataType.simpleString()
        role, mask = column_role(f.name, kind, currency, match)
        rows.append((i, f.name, kind, role, mask))
    return df.sparkSession.createDataFrame(rows, "no int, column string, type string, role string, mask string")


def display_format(df: DataFrame, currency: str = "IDR", match: str = "word") -> DataFrame:
    """Every number and date as the text its mask would show (P10)."""
    from pyspark.sql import types as T

    out = []
    for f in df.schema.fields:
        role, mask = column_role(f.name, f.dataType.simpleString(), currency, match)
        c = quoted(f.name)
        if isinstance(f.dataType, T.NumericType):
            if role == "currency":
                usd = currency.upper() == "USD"
                shown = F.concat(F.lit("$" if usd else "Rp "), F.format_number(c.cast("double"), 2 if usd else 0))
            elif role == "percent":
                shown = F.concat(F.format_number(c.cast("double") * 100, 1), F.lit("%"))
            elif role == "integer":
                shown = F.format_number(c.cast("double"), 0)
            elif role == "decimal":
                shown = F.format_number(c.cast("double"), 2)
            else:
                shown = c.cast("string")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            shown = F.date_format(c, "yyyy-MM-dd")
        else:
            shown = c
        out.append(shown.alias(f.name))
    return df.select(*out)
