"""Row order without one big partition.

Spark tables have no order, so every order-based operator takes ``order_by``.
The content of the remaining columns breaks ties, which makes results
reproducible: rows that are still equal are copies and interchangeable.

:func:`with_buckets` cuts that order into contiguous buckets of similar size.
The cut points come from a bounded sample and stand in the plan as literals, so
every pass over the table (and every retry of a task) agrees on them.  A key
that is so frequent that it spans several cut points gets a bucket of its own
holding nothing but copies of one row; operators treat such buckets without
sorting them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.binding import let

ROW_ORDER = "_ord"  # where a row stands in its files; sorted by, but touched by no rule and never compared
BUCKET = "_bucket"
HOT = "_hot"
SAMPLE_PER_BUCKET = 32

_JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
}


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def file_order(df: DataFrame, order_by: Sequence[str] | None) -> list[str] | None:
    """``order_by``; without it the place in the files, for a table that was read with it."""
    return list(order_by) if order_by else [ROW_ORDER] if ROW_ORDER in df.columns else None


def _hashable(c: Column, dtype: T.DataType) -> Column:
    """Maps and variants have no hash of their own; their JSON text has."""
    simple = not any(k in dtype.simpleString() for k in ("map<", "variant"))
    return c if simple else F.to_json(F.struct(c.alias("v")))


def _leaves(c: Column, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return [leaf for f in dtype.fields for leaf in _leaves(c.getField(f.name), f.dataType)]
    if isinstance(dtype, T.AtomicType) and not isinstance(dtype, T.BinaryType):
        return [c]
    raise TypeError(f"Cannot order by a column of type {dtype.simpleString()}.")


def order_key(df: DataFrame, order_by: Sequence[str] | None, extra: Sequence[str] = ()) -> list[Column]:
    """Sort columns: ``order_by`` first, then two hashes of all other columns.

    The hashes break ties by content, so the order is the same on every run and
    only copies of a row share a place.  They keep the key short even where the
    other columns hold long texts.
    """
    first = list(order_by or ())
    rest = [_hashable(quoted(f.name), f.dataType) for f in df.schema.fields if f.name not in first and f.name not in extra]
    leaves = [leaf for n in first for leaf in _leaves(quoted(n), df.schema[n].dataType)]
    return [*leaves, F.xxhash64(*rest), F.xxhash64(F.lit(1), *rest)] if rest else leaves


def key_struct(leaves: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(leaves)])


@dataclass(frozen=True)
class Bucketed:
    """A table with its bucket column, and what is known about the buckets."""

    df: DataFrame
    leaves: tuple[Column, ...]
    rows: int
    has_hot: bool
    single: bool = False


def with_buckets(
    df: DataFrame,
    order_by: Sequence[str] | None,
    rows_per_bucket: int = 1_000_000,
    max_buckets: int = 16384,
) -> Bucketed:
    """Add ``_bucket`` (ascending in the order) and ``_hot`` to ``df``.

    The driver receives at most ``max_buckets`` cut points, whatever the size of
    the table; at most 32 sampled keys per bucket are ranked to find them.
    """
    leaves = tuple(order_key(df, order_by))
    rows = df.count()
    buckets = min(max_buckets, math.ceil(rows / rows_per_bucket))
    if buckets <= 1:
        return Bucketed(df.withColumn(BUCKET, F.lit(0)), leaves, rows, has_hot=False, single=True)

    cuts, hot, schema = _cut_points(df, leaves, rows, buckets)
    key = key_struct(leaves)
    bucket = _position(key, cuts, schema)
    if any(hot):
        flags = F.array(*[F.lit(h) for h in hot])
        start = F.get(_literal(cuts, schema), F.col(BUCKET) - 1)
        is_hot = F.coalesce(F.get(flags, F.col(BUCKET) - 1) & (start == key), F.lit(False))
        out = df.withColumn(BUCKET, bucket).withColumn(HOT, is_hot)
        # copies of a hot key come first, then the rest of the bucket it opens
        out = out.withColumn(BUCKET, F.col(BUCKET) * 2 + F.when(F.col(HOT), 0).otherwise(1))
    else:
        out = df.withColumn(BUCKET, bucket).withColumn(HOT, F.lit(False))
    return Bucketed(out, leaves, rows, any(hot))


def _cut_points(df: DataFrame, leaves: Sequence[Column], rows: int, buckets: int):
    """Distinct cut keys in order, and whether each of them is hot."""
    sample = df.select(key_struct(leaves).alias("key")).sample(
        fraction=min(1.0, SAMPLE_PER_BUCKET * buckets / rows), seed=17
    )
    schema = sample.schema["key"].dataType
    # the sample is bounded (32 keys per bucket), so ranking it in one task is safe
    ranked = sample.select(
        "key", F.row_number().over(Window.orderBy("key")).alias("n"), F.count("*").over(Window.partitionBy()).alias("of")
    )
    step = F.floor((F.col("n") - 1) * buckets / F.col("of"))
    before = F.floor((F.col("n") - 2) * buckets / F.col("of"))
    picked = ranked.where((F.col("n") > 1) & (step != before)).orderBy("n").select(
        F.to_json("key", {**_JSON_OPTIONS, "ignoreNullFields": "false"}).alias("key")
    )
    keys = [r["key"] for r in picked.collect()]
    times = Counter(keys)
    return list(times), [n > 1 for n in times.values()], schema


def _literal(cuts: Sequence[str], schema: T.StructType) -> Column:
    """The cut keys as one constant array (folded at planning time)."""
    return F.from_json(F.lit("[" + ",".join(cuts) + "]"), T.ArrayType(schema), _JSON_OPTIONS)


def _position(key: Column, cuts: Sequence[str], schema: T.StructType) -> Column:
    """Number of cut keys that are not above ``key``, found in two short scans of
    about the square root of their number.  The key and the place of the first scan are computed once for a row,
    not once for each cut key they meet."""
    every = _literal(cuts, schema)
    if len(cuts) <= 32:
        return let(key, lambda k: F.size(F.filter(every, lambda x: x <= k)))
    width = math.isqrt(len(cuts)) + 1
    heads = _literal(cuts[::width], schema)

    def inside(k: Column, block: Column) -> Column:
        return block * width + F.size(F.filter(F.slice(every, block * width + 1, F.lit(width)), lambda x: x <= k))

    return let(key, lambda k: let(
        F.greatest(F.size(F.filter(heads, lambda x: x <= k)) - 1, F.lit(0)), lambda block: inside(k, block)
    ))


def expand_copies(df: DataFrame, count_column: str, index_column: str, chunk: int = 1_000_000) -> DataFrame:
    """Turn (row, n) into n rows numbered 0 to n-1.

    Chunks are shuffled apart before the second step, so that even a third of a
    large table held in one folded row is written by many tasks.
    """
    n = F.col(count_column)
    return (
        df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), ((n - 1) / chunk).cast("bigint"))))
        .repartition(F.col("_chunk"))
        .withColumn(
            index_column,
            F.explode(F.sequence(F.col("_chunk") * chunk, F.least((F.col("_chunk") + 1) * chunk, n) - 1)),
        )
        .drop("_chunk")
    )
