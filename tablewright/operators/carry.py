"""Forward fill, backward fill and interpolation over a whole table.

A window without a partition would move the table into one task.  Instead the
order is cut into buckets; one pass keeps the first and last known value of each
bucket, a tiny table carries them across buckets, and the fill itself runs in a
window per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators.order import (
    BUCKET,
    HOT,
    Bucketed,
    expand_copies,
    file_order,
    key_struct,
    quoted,
    with_buckets,
)

CARRY = "_carry_"  # prefix of all helper columns


def carry_fill(
    df: DataFrame,
    how: Mapping[str, str],
    order_by: Sequence[str] | None,
    rows_per_bucket: int = 1_000_000,
    max_buckets: int = 16384,
    within: str | None = None,
) -> DataFrame:
    """Fill nulls from neighbouring rows; ``how`` maps a column to ``ffill``,
    ``bfill`` or ``interpolate``.

    ``within`` names a column (a table number) whose values are filled separately;
    it leads the order, so all tables share the same passes.

    Passes: a bounded sample for the cut points, one summary pass (two when
    interpolating), and one shuffle of the table by bucket.
    """
    how = {c: h for c, h in how.items() if c in df.columns}
    if not how:
        return df
    order_by = file_order(df, order_by)
    if not order_by:
        raise ValueError("Filling from neighbouring rows needs order_by: a Spark table has no row order.")
    group = [within] if within else []
    b = with_buckets(df, [*group, *(c for c in order_by if c != within)], rows_per_bucket, max_buckets)
    names = df.columns
    if b.single:
        # fewer rows than one bucket takes: there is nothing to carry
        return _fill_cold(b.df, b, how, None, names, group)
    carry = _carry_table(b, how, group)
    cold = b.df.where(~F.col(HOT)) if b.has_hot else b.df
    out = _fill_cold(cold, b, how, carry, names, group)
    if b.has_hot:
        out = out.unionByName(_fill_hot(b.df.where(F.col(HOT)), how, carry, names, group))
    return out


def fill_forward(df: DataFrame, cols: Sequence[str], order_by: Sequence[str] | None, fallback=None, **kw) -> DataFrame:
    """Last known value in the order; ``fallback`` for what stays empty."""
    return _with_fallback(carry_fill(df, dict.fromkeys(cols, "ffill"), order_by, **kw), cols, fallback)


def fill_backward(df: DataFrame, cols: Sequence[str], order_by: Sequence[str] | None, fallback=None, **kw) -> DataFrame:
    """Next known value in the order; ``fallback`` for what stays empty."""
    return _with_fallback(carry_fill(df, dict.fromkeys(cols, "bfill"), order_by, **kw), cols, fallback)


def interpolate_linear(df: DataFrame, cols: Sequence[str], order_by: Sequence[str] | None, **kw) -> DataFrame:
    """Straight line by row position; the edges take the nearest known value."""
    return carry_fill(df, dict.fromkeys(cols, "interpolate"), order_by, **kw)


def _with_fallback(df: DataFrame, cols: Sequence[str], fallback) -> DataFrame:
    if fallback is None:
        return df
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(fallback)) for c in cols if c in df.columns})


def _carry_table(b: Bucketed, how: Mapping[str, str], group: Sequence[str]) -> DataFrame:
    """Per bucket: rows before it, and the nearest known values outside it.

    At most two rows per bucket (and one more per table), hence safe to sort in
    one task.  Values may be long texts: whether the table is broadcast is left to its measured size.
    """
    place = [BUCKET, *group]
    key = key_struct(b.leaves)
    lines = [c for c, h in how.items() if h == "interpolate"]
    measures = [F.count("*").alias(f"{CARRY}rows")]
    for i, c in enumerate(how):
        known = F.when(quoted(c).isNotNull(), key)
        measures += [F.min_by(quoted(c), known).alias(f"{CARRY}first{i}"), F.max_by(quoted(c), known).alias(f"{CARRY}last{i}")]
        if c in lines:
            measures += [F.min(known).alias(f"{CARRY}firstkey{i}"), F.max(known).alias(f"{CARRY}lastkey{i}")]
    summary = b.df.groupBy(*place).agg(*measures)

    if lines:
        # where the outermost known values stand inside their bucket
        index = {c: i for i, c in enumerate(how)}
        keyed = b.df.join(F.broadcast(summary.select(*place, *[f"{CARRY}{k}key{index[c]}" for k in ("first", "last") for c in lines])), place)
        gaps = keyed.groupBy(*place).agg(
            *[F.count_if(key < F.col(f"{CARRY}firstkey{index[c]}")).alias(f"{CARRY}lead{index[c]}") for c in lines],
            *[F.count_if(key > F.col(f"{CARRY}lastkey{index[c]}")).alias(f"{CARRY}trail{index[c]}") for c in lines],
        )
        summary = summary.join(gaps, place)

    tables = Window.partitionBy(*group)
    back = tables.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ahead = tables.orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(f"{CARRY}rows").over(back), F.lit(0))
    cols = [*map(F.col, place), start.alias(f"{CARRY}start")]
    for i, c in enumerate(how):
        cols += [
            F.last(f"{CARRY}last{i}", ignorenulls=True).over(back).alias(f"{CARRY}prev{i}"),
            F.last(f"{CARRY}first{i}", ignorenulls=True).over(ahead).alias(f"{CARRY}next{i}"),
        ]
        if c in lines:
            known = F.col(f"{CARRY}last{i}").isNotNull()
            last_at = F.when(known, start + F.col(f"{CARRY}rows") - F.col(f"{CARRY}trail{i}"))
            first_at = F.when(known, start + F.col(f"{CARRY}lead{i}") + 1)
            cols += [last_at.alias(f"{CARRY}lastat{i}"), first_at.alias(f"{CARRY}firstat{i}")]
    carried = summary.select(*cols)
    for i, c in enumerate(how):
        if c in lines:
            carried = carried.withColumns({
                f"{CARRY}prevat{i}": F.last(f"{CARRY}lastat{i}", ignorenulls=True).over(back),
                f"{CARRY}nextat{i}": F.last(f"{CARRY}firstat{i}", ignorenulls=True).over(ahead),
            }).drop(f"{CARRY}lastat{i}", f"{CARRY}firstat{i}")
    return carried


def _line(value: Column, at: Column, prev: Column, prev_at: Column, nxt: Column, next_at: Column) -> Column:
    on_line = prev + (nxt - prev) * (at - prev_at) / (next_at - prev_at)
    return F.coalesce(value, on_line, prev, nxt)


def _fill_cold(df: DataFrame, b: Bucketed, how: Mapping[str, str], carry: DataFrame | None, names: Sequence[str], group: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy(BUCKET, *group)
    upward = inside.orderBy(*[c.asc_nulls_first() for c in b.leaves])
    downward = inside.orderBy(*[c.desc_nulls_last() for c in b.leaves])
    # a frame that ends at the last row would be quadratic; reading the bucket
    # in reverse with a growing frame is linear
    back = upward.rowsBetween(Window.unboundedPreceding, 0)
    ahead = downward.rowsBetween(Window.unboundedPreceding, 0)

    work = df
    if "interpolate" in how.values():
        work = work.withColumn(f"{CARRY}n", F.row_number().over(upward))
    near = {}
    for i, (c, h) in enumerate(how.items()):
        value = quoted(c)
        if h in ("ffill", "interpolate"):
            near[f"{CARRY}own_prev{i}"] = F.last(value, ignorenulls=True).over(back)
        if h in ("bfill", "interpolate"):
            near[f"{CARRY}own_next{i}"] = F.last(value, ignorenulls=True).over(ahead)
        if h == "interpolate":
            at = F.when(value.isNotNull(), F.col(f"{CARRY}n"))
            near[f"{CARRY}own_prevat{i}"] = F.last(at, ignorenulls=True).over(back)
            near[f"{CARRY}own_nextat{i}"] = F.last(at, ignorenulls=True).over(ahead)
    work = work.withColumns(near)
    if carry is not None:
        work = work.join(carry, [BUCKET, *group], "left")
    start = F.lit(0) if carry is None else F.col(f"{CARRY}start")

    def known(inside: Column, outside: str) -> Column:
        return inside if carry is None else F.coalesce(inside, F.col(outside))

    filled = {}
    for i, (c, h) in enumerate(how.items()):
        if h == "ffill":
            filled[c] = known(F.col(f"{CARRY}own_prev{i}"), f"{CARRY}prev{i}")
        elif h == "bfill":
            filled[c] = known(F.col(f"{CARRY}own_next{i}"), f"{CARRY}next{i}")
        else:
            filled[c] = _line(
                quoted(c).cast("double"), start + F.col(f"{CARRY}n"),
                known(F.col(f"{CARRY}own_prev{i}"), f"{CARRY}prev{i}").cast("double"),
                known(start + F.col(f"{CARRY}own_prevat{i}"), f"{CARRY}prevat{i}"),
                known(F.col(f"{CARRY}own_next{i}"), f"{CARRY}next{i}").cast("double"),
                known(start + F.col(f"{CARRY}own_nextat{i}"), f"{CARRY}nextat{i}"),
            )
    return work.select(*[filled[n].alias(n) if n in filled else quoted(n) for n in names])


def _fill_hot(df: DataFrame, how: Mapping[str, str], carry: DataFrame, names: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Buckets made of copies of one row: nothing to sort.

    Forward and backward fill need the carried value only.  For interpolation
    the copies are counted, then laid out again with their positions.
    """
    if "interpolate" in how.values():
        df = df.groupBy(*[quoted(n) for n in names], F.col(BUCKET)).agg(F.count("*").alias(f"{CARRY}copies"))
        df = expand_copies(df, f"{CARRY}copies", f"{CARRY}n")
    work = df.join(carry, [BUCKET, *group], "left")
    filled = {}
    for i, (c, h) in enumerate(how.items()):
        if h == "interpolate":
            filled[c] = _line(
                quoted(c).cast("double"), F.col(f"{CARRY}start") + F.col(f"{CARRY}n") + 1,
                F.col(f"{CARRY}prev{i}").cast("double"), F.col(f"{CARRY}prevat{i}"),
                F.col(f"{CARRY}next{i}").cast("double"), F.col(f"{CARRY}nextat{i}"),
            )
        else:
            filled[c] = F.coalesce(quoted(c), F.col(f"{CARRY}prev{i}" if h == "ffill" else f"{CARRY}next{i}"))
    return work.select(*[filled[n].alias(n) if n in filled else quoted(n) for n in names])
