"""Stacking, joining and appending tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import fixed_values as fv
from tablewright.functions.names import file_stem
from tablewright.operators.order import order_key, quoted
from tablewright.session import materialise, scratch_path

FILE_NO = "_file_no"
SIGNATURE = "_signature"
MOST_HOT = 1 << 16  # a key is frequent only above this part of all rows
FEW_ROWS = 1 << 16  # a side of more rows is shuffled, however small its files are

Tables = Mapping[str, DataFrame]


# ---------------------------------------------------------------- checks


def column_diff(base: Sequence[str], other: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns of ``other`` against ``base`` (U4)."""
    return [c for c in base if c not in set(other)], [c for c in other if c not in set(base)]


def _structure_error(base_name: str, base: Sequence[str], name: str, columns: Sequence[str]) -> ValueError:
    missing, extra = column_diff(base, columns)
    parts = [f"lacks {missing}"] * bool(missing) + [f"also has {extra}"] * bool(extra)
    told = " and ".join(parts) or f"has them in another order: {list(columns)}"
    return ValueError(f"{name} must have the columns of {base_name} ({', '.join(base)}), but {told}.")


def check_same_columns(tables: Tables) -> list[str]:
    """All tables must have the same columns in the same order (P4); runs no job."""
    if len(tables) < 2:
        raise ValueError("Stacking needs at least 2 tables.")
    (base_name, base), *others = tables.items()
    for name, df in others:
        if df.columns != base.columns:
            raise _structure_error(base_name, base.columns, name, df.columns)
    return base.columns


def check_column_set(base_name: str, base: Sequence[str], name: str, columns: Sequence[str]) -> None:
    """Both tables must have the same set of columns, in any order (P5)."""
    if set(base) != set(columns):
        raise _structure_error(base_name, base, name, columns)


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in the order of the base table."""
    return df.select(*[quoted(c) for c in columns])


def parse_keys(keys: str | Sequence[str]) -> list[str]:
    names = keys.split(",") if isinstance(keys, str) else [str(k) for k in keys]
    return [k.strip() for k in names if k.strip()]


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    return a == b or (isinstance(a, T.NumericType) and isinstance(b, T.NumericType))


def joined_columns(left: Sequence[str], right_name: str, right: Sequence[str], key: str) -> dict[str, str]:
    """New names of the right columns: those that exist already get ``_<stem>``."""
    names = {}
    for c in right:
        if c == key:
            continue
        names[c] = f"{c}_{file_stem(right_name)}" if c in left else c
        if names[c] in left or list(names.values()).count(names[c]) > 1:
            raise ValueError(f"Column '{names[c]}' of '{right_name}' exists already.")
    return names


def check_join(tables: Tables, keys: str | Sequence[str], how: str = "left") -> list[str]:
    """Number of keys, their presence and their types at every stage, before any job."""
    keys = parse_keys(keys)
    if len(tables) < 2:
        raise ValueError("A join needs at least 2 tables.")
    if len(keys) != len(tables) - 1:
        raise ValueError(
            f"A chain of {len(tables)} tables is joined by {len(tables) - 1} keys; {len(keys)} given."
        )
    if how != "left":
        raise ValueError(f"Only left joins are chained, not {how!r}.")
    items = list(tables.items())
    types = {f.name: f.dataType for f in items[0][1].schema.fields}
    for stage, key in enumerate(keys, start=1):
        left_name = items[0][0] if stage == 1 else fv.JOINED_NAME
        right_name, right = items[stage]
        for name, columns in ((left_name, list(types)), (right_name, right.columns)):
            if key not in columns:
                raise ValueError(
                    f"Stage {stage} joins by '{key}', which {name} does not have; it has {', '.join(columns)}."
                )
        if not _comparable(types[key], right.schema[key].dataType):
            raise ValueError(
                f"Key '{key}' is {types[key].simpleString()} on the left but "
                f"{right.schema[key].dataType.simpleString()} in '{right_name}'."
            )
        for old, new in joined_columns(list(types), right_name, right.columns, key).items():
            types[new] = right.schema[old].dataType
    return keys


# ---------------------------------------------------------------- stack


def stack(tables: Tables, source_col: str = fv.SOURCE_COLUMN, number: bool = False) -> DataFrame:
    """Bag union of tables with equal columns, tagged with the source name.

    Sources are told apart by their full name, so two files with the same base
    name stay two.  ``number`` adds the position of the source as ``_file_no``.
    """
    check_same_columns(tables)
    parts = []
    for no, (name, df) in enumerate(tables.items()):
        part = df.withColumn(source_col, F.lit(name.rsplit("/", 1)[-1]))
        parts.append(part.withColumn(FILE_NO, F.lit(no)) if number else part)
    return unite(*parts)


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return T.StringType()
    return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DoubleType()


def unite(*tables: DataFrame) -> DataFrame:
    """Union by name after making column types equal (U2), in the columns of the first table.

    Two numeric types meet in double (or stay, if equal); anything else that
    differs meets in text.  Spark's own rule would turn text and double into
    double and fail on the first word.  Types meet in the order of the tables; all
    casts are known before the tables are joined, and these are joined in halves, so
    a thousand of them make a plan ten unions deep.
    """
    own = [{f.name: f.dataType for f in t.schema.fields} for t in tables]
    met = {name: list(accumulate((types[name] for types in own), _common)) for name in own[0]}
    # the few tables at which the common type of a column changes
    turns = {name: [i for i in range(1, len(types)) if types[i] != types[i - 1]] for name, types in met.items()}
    parts = []
    for i, (t, mine) in enumerate(zip(tables, own)):
        casts = {}
        for name, types in met.items():
            steps = [mine[name], types[i], *[types[k] for k in turns[name] if k > i]]
            c = quoted(name)
            for before, now in pairwise(steps):
                c = c if before == now else c.cast(now)
            if steps[0] != steps[-1]:
                casts[name] = c
        parts.append(t.withColumns(casts) if casts else t)
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


# ---------------------------------------------------------------- join


@dataclass(frozen=True)
class JoinResult:
    data: DataFrame
    stages: DataFrame  # per stage: rows, matched, unmatched, rate
    orphans: DataFrame  # right rows without a left partner


def key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(k, n, m): one line per key with its rows on the left and on the right, counted where the rows are read."""
    n = left.groupBy(quoted(key).alias("_left")).agg(F.count("*").alias("n"))
    m = right.groupBy(quoted(key).alias("_right")).agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("bigint")
    return n.join(m, F.col("_left").eqNullSafe(F.col("_right")), "full").select(
        F.coalesce("_left", "_right").alias("k"), F.coalesce("n", zero).alias("n"), F.coalesce("m", zero).alias("m")
    )


def frequent_keys(counts: DataFrame, hot_rows: int) -> DataFrame | None:
    """(_hot, _lefts, _rights) of the keys with more than ``hot_rows`` rows on a side, or None without any.

    ``_lefts`` and ``_rights`` say over how many shares the rows of a side are dealt; zero means no row.
    A null key meets nothing, so it has no share on the right.  A key must also hold more than one in
    ``MOST_HOT`` of all rows: this bounds the lines that are broadcast, and what is left to the
    plain join is at most that part of the table per key.
    """
    m = F.when(F.col("k").isNotNull(), F.col("m")).otherwise(0)
    rows, top = counts.agg(F.sum(F.col("n") + m), F.max(F.greatest("n", m))).first()
    least = max(hot_rows, (rows or 0) / MOST_HOT)
    if (top or 0) <= least:
        return None
    shares = [F.ceil(side / F.lit(hot_rows)).alias(name) for side, name in ((F.col("n"), "_lefts"), (m, "_rights"))]
    return counts.where(F.greatest("n", m) > least).select(F.col("k").alias("_hot"), *shares)


def long_sides(counts: DataFrame) -> tuple[bool, bool]:
    """(right rows, left keys): which of them are more than ``FEW_ROWS``.

    The size of compressed files says little about the rows in them: ten megabytes of Parquet may hold
    a million keys, of which the driver would build a table in memory before it sends them.
    """
    known = F.col("k").isNotNull()
    rows, keys = counts.agg(F.sum(F.when(known, F.col("m"))), F.count_if(known & (F.col("n") > 0))).first()
    return (rows or 0) > FEW_ROWS, (keys or 0) > FEW_ROWS


def _shuffled(df: DataFrame, long: bool) -> DataFrame:
    return df.hint("merge") if long else df


def _share(df: DataFrame, of: str) -> Column:
    """A share of the row that is the same when its task runs again: task number and values hashed."""
    plain = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.col(of))


def join_stage(
    left: DataFrame,
    right_name: str,
    right: DataFrame,
    key: str,
    hot: DataFrame | None = None,
    long: bool = False,
) -> DataFrame:
    """left ⟕ right on one key; null keys stay unmatched, clashing names get a suffix.

    The strategy of the plain join is left to Spark, which broadcasts a small right side;
    one that is ``long`` (as of :func:`long_sides`) is shuffled.  Rows of the keys in
    ``hot`` (as of :func:`frequent_keys`) are joined apart.  Without a partner they need no join;
    with one, the left rows are dealt over their shares and repeated for each share of the
    right side, and the other way round, so every pair meets once in a task of its own.
    """
    names = joined_columns(left.columns, right_name, right.columns, key)
    renamed = right.where(quoted(key).isNotNull()).select(quoted(key).alias("_right_key"), *[quoted(o).alias(n) for o, n in names.items()])
    same = quoted(key) == F.col("_right_key")
    if hot is None:
        return left.join(_shuffled(renamed, long), same, "left").drop("_right_key")

    lines = F.broadcast(hot)  # at most 2 * MOST_HOT lines
    tell = ("_hot", "_lefts", "_rights")
    left_marked = left.join(lines, quoted(key).eqNullSafe(F.col("_hot")), "left")
    right_marked = renamed.join(lines, F.col("_right_key") == F.col("_hot"), "left")
    plain = left_marked.where("_rights IS NULL").drop(*tell).join(_shuffled(right_marked.where("_lefts IS NULL").drop(*tell), long), same, "left").drop("_right_key")
    alone = left_marked.where("_rights = 0").drop(*tell).select(
        "*", *[F.lit(None).cast(renamed.schema[n].dataType).alias(n) for n in names.values()]
    )
    numbers = [F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)) for c in ("_rights", "_lefts")]
    dealt = left_marked.where("_rights > 0").withColumn("_a", _share(left, "_lefts")).withColumn("_b", numbers[0]).drop(*tell)
    spread = right_marked.where("_lefts > 0").withColumn("_y", _share(renamed, "_rights")).withColumn("_x", numbers[1]).drop(*tell)
    pairs = dealt.join(_shuffled(spread, long), same & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))).drop("_a", "_b", "_x", "_y", "_right_key")
    return plain.unionByName(alone).unionByName(pairs)


def stage_rates(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """One row: left rows, matched, unmatched, rate in percent.

    Null keys count as unmatched.  Both sides are reduced to one row per key
    before they meet, so neither a frequent key nor a wide row is shuffled.
    """
    counts = key_counts(left, right, key) if counts is None else counts
    zero = F.lit(0).cast("bigint")
    return (
        counts.agg(
            F.coalesce(F.sum("n"), zero).alias("left_rows"),
            F.coalesce(F.sum(F.when((F.col("m") > 0) & F.col("k").isNotNull(), F.col("n"))), zero).alias("matched_rows"),
        )
        .select(
            "left_rows", "matched_rows",
            (F.col("left_rows") - F.col("matched_rows")).alias("unmatched_rows"),
            F.when(F.col("left_rows") > 0, F.round(F.col("matched_rows") * 100 / F.col("left_rows"), 2))
            .otherwise(F.lit(0.0)).alias("match_rate"),
        )
    )


def find_orphans(
    left: DataFrame, left_name: str, right: DataFrame, right_name: str, key: str, stage: int,
    counts: DataFrame | None = None, hot: DataFrame | None = None, long: bool = False,
) -> DataFrame:
    """Right rows whose key is not among the left keys, with stage, origin and reason.

    Rows with a null key are always orphans; they are filtered out on the spot
    instead of being sent to the one partition that nulls hash to.  The keys in ``hot`` are
    decided by a broadcast of their lines, without moving their rows.  Left keys that are ``long``
    (as of :func:`long_sides`) are shuffled.
    """
    counts = key_counts(left, right, key) if counts is None else counts
    keys = counts.where("k IS NOT NULL AND n > 0").select(F.col("k").alias("_k"))
    known = right.where(quoted(key).isNotNull())
    unnamed = right.where(quoted(key).isNull())
    if hot is not None:
        marked = known.join(F.broadcast(hot.select("_hot", "_lefts")), quoted(key) == F.col("_hot"), "left")
        unnamed = unnamed.unionByName(marked.where("_lefts = 0").drop("_hot", "_lefts"))
        known = marked.where("_lefts IS NULL").drop("_hot", "_lefts")
    named = known.join(_shuffled(keys, long), quoted(key) == F.col("_k"), "left_anti")
    before, after = fv.REASON_ORPHAN.format(key=key, value="\0", left=left_name).split("\0")
    reason = F.concat(F.lit(before), F.coalesce(quoted(key).cast("string"), F.lit(fv.EMPTY_KEY)), F.lit(after))
    return named.unionByName(unnamed).select(
        "*",
        F.lit(stage).alias(fv.STAGE_COLUMN), F.lit(right_name).alias(fv.ORIGIN_COLUMN), reason.alias(fv.REASON_COLUMN),
    )


def join_chain(
    tables: Tables, keys: str | Sequence[str], how: str = "left", cut_lineage: bool = True, hot_rows: int = 1_000_000
) -> JoinResult:
    """Chained left join with match rates and orphan rows per stage.

    The keys of both sides of a stage are counted once, into a table with one line per key
    that serves the search for frequent keys, the rate and the orphans.  With
    ``cut_lineage`` that table and the intermediate results are written once.
    """
    keys = check_join(tables, keys, how)
    items = list(tables.items())
    joined = items[0][1]
    stages = orphans = None
    for no, key in enumerate(keys, start=1):
        left_name = items[0][0].rsplit("/", 1)[-1] if no == 1 else fv.JOINED_NAME
        path, right = items[no]
        right_name = path.rsplit("/", 1)[-1]
        counts = key_counts(joined, right, key)
        if cut_lineage:
            counts = materialise(counts, "keys")
        hot = frequent_keys(counts, hot_rows)
        long_right, long_keys = long_sides(counts)
        rate = stage_rates(joined, right, key, counts).select(
            F.lit(no).alias("stage"), F.lit(left_name).alias("left_name"), F.lit(right_name).alias("right_name"),
            F.lit(key).alias("key"), "*",
        )
        lost = find_orphans(joined, left_name, right, right_name, key, no, counts, hot, long_keys)
        stages = rate if stages is None else stages.unionByName(rate)
        orphans = lost if orphans is None else _union_wide(orphans, lost)
        joined = join_stage(joined, right_name, right, key, hot, long_right)
        if cut_lineage and no < len(keys):
            joined = materialise(joined, "joined")
    return JoinResult(joined, stages, orphans)


def _union_wide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of tables with different columns; equal names with different types become text."""
    for c in set(a.columns) & set(b.columns):
        if a.schema[c].dataType != b.schema[c].dataType:
            a, b = a.withColumn(c, quoted(c).cast("string")), b.withColumn(c, quoted(c).cast("string"))
    out = a.unionByName(b, allowMissingColumns=True)
    tail = [fv.STAGE_COLUMN, fv.ORIGIN_COLUMN, fv.REASON_COLUMN]
    return out.select(*[quoted(c) for c in out.columns if c not in tail], *[quoted(c) for c in tail])


# ---------------------------------------------------------------- append


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Left join of ``rows`` to a table with one line per key, safe for frequent keys.

    ``weight`` holds how many rows a key has.  Keys above ``hot_rows`` and above one in ``MOST_HOT`` of
    all rows are looked up in a broadcast of just those lines (fewer than ``MOST_HOT``), without
    moving their rows; all other keys are shuffled.
    """
    total, top = table.agg(F.sum(weight), F.max(weight)).first()
    least = max(hot_rows, (total or 0) / MOST_HOT)
    if (top or 0) <= least:
        return rows.join(table, key, "left")
    hot = table.where(F.col(weight) > least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) <= least), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def classify_new(
    base: DataFrame,
    new: DataFrame,
    order_by: Sequence[str] | None = None,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Sequential append in one pass.

    ``base`` and ``new`` carry a ``_signature``; ``new`` also has ``_file_no``, the
    position of its file.  Adds ``reason``: null for the row that is kept, else why
    it is skipped - its signature is in the base, was added by an earlier file
    ("in base" as well), or came earlier in the same file.

    ``new`` is written once, which gives every row a lasting identity; signatures
    are counted with partial aggregates on both sides, and only one line per new
    signature takes part in the join.
    """
    spark = new.sparkSession
    path = scratch_path(spark, "new-rows")
    new.write.parquet(path)
    rows = spark.read.schema(new.schema).parquet(path).select(
        "*", F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).alias("_row")
    )
    leaves = order_key(rows, order_by, extra=(FILE_NO, SIGNATURE, "_row"))
    place = F.struct(F.col(FILE_NO).alias("file"), *[c.alias(f"k{i}") for i, c in enumerate(leaves)], F.col("_row").alias("row"))
    first = rows.groupBy(SIGNATURE).agg(F.count("*").alias("_rows"), F.min(place).alias("_first"))
    known = base.select(SIGNATURE).distinct().withColumn("_known", F.lit(True))
    per_key = materialise(
        first.join(known, SIGNATURE, "left").select(
            SIGNATURE, "_rows", F.col("_first.file").alias("_first_file"), F.col("_first.row").alias("_first_row"),
            F.coalesce("_known", F.lit(False)).alias("_known"),
        ),
        "signatures",
    )
    return (
        lookup(rows, per_key, SIGNATURE, "_rows", hot_rows)
        .withColumn(
            "reason",
            F.when(F.col("_known") | (F.col("_first_file") < F.col(FILE_NO)), F.lit(fv.REASON_IN_BASE))
            .when(F.col("_row") != F.col("_first_row"), F.lit(fv.REASON_IN_FILE)),
        )
        .drop("_rows", "_first_file", "_first_row", "_known", "_row")
    )


def append_file_counts(classified: DataFrame, names: Mapping[int, str], read: Mapping[int, int] | None = None) -> DataFrame:
    """Per new file: rows read, added, skipped against the base and inside the file.

    ``read`` holds the rows before cleaning; without it the classified rows count.
    Files that contribute no row are listed with zeros.
    """
    spark = classified.sparkSession
    files = spark.createDataFrame(
        [(n, name, None if read is None else int(read.get(n, 0))) for n, name in names.items()],
        f"{FILE_NO} int, file string, rows_before bigint",
    )

    def count(test: Column) -> Column:
        return F.count_if(test)

    per = classified.groupBy(FILE_NO).agg(
        F.count("*").alias("n"),
        count(F.col("reason").isNull()).alias("added"),
        count(F.col("reason") == fv.REASON_IN_BASE).alias("skipped_in_base"),
        count(F.col("reason") == fv.REASON_IN_FILE).alias("skipped_in_file"),
    )
    zero = F.lit(0).cast("bigint")
    return files.join(per, FILE_NO, "left").select(
        FILE_NO, "file", F.coalesce("rows_before", "n", zero).alias("rows_read"),
        *[F.coalesce(c, zero).alias(c) for c in ("added", "skipped_in_base", "skipped_in_file")],
    )
