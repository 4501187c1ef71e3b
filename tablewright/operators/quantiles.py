"""Exact medians, means and modes that do not gather a column in one task (A2-A4)."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablewright.operators.order import quoted

# up to this many values the built-in exact median is used; its state is a
# value -> count map, so it must stay bounded
SMALL = 1_000_000
SKETCH = 1024  # values a sketch level keeps; its rank error is then about 0.3 %
SLACK = 0.006  # taken to both sides of a rank
GRID = 256
SIGN_OFF = (1 << 63) - 1


def medians(df: DataFrame, cols: Sequence[str], counts: Mapping[str, int], small: int = SMALL) -> dict[str, float | None]:
    """Exact median of each column; ``counts`` (at least the non-null rows) tells
    short columns from long ones.  All columns share every pass."""
    return medians_by(df.withColumn(_ONLY, F.lit(0)), _ONLY, {0: {c: counts.get(c, 0) for c in cols}}, small)[0]


_ONLY = "_only_table"


@dataclass
class _Bracket:
    """Where the middle of one column of one table must lie, and what was found."""

    low_rank: int
    high_rank: int
    lo: float
    hi: float
    below: int  # values under lo
    inside: int
    guess: tuple[float, float]
    halve: bool = False
    ends: tuple[float, float] | None = None

    def close(self) -> None:
        if self.lo == self.hi or self.inside == self.high_rank - self.low_rank + 1:
            self.ends = (self.lo, self.hi)

    def narrow(self, r: Row) -> None:
        """Take in the exact counts under and within the guess."""
        under, upto, before = self.below + r["under"], self.below + r["under"] + r["within"], self.inside
        if self.low_rank < under <= self.high_rank:
            self.ends = (r["down"], r["first"] if r["within"] else r["up"])
        elif self.low_rank < upto <= self.high_rank:
            self.ends = (r["last"], r["up"])
        elif self.high_rank < under:
            self.hi, self.inside = r["down"], r["under"]
        elif self.low_rank >= upto:
            self.lo, self.inside, self.below = r["up"], self.below + self.inside - upto, upto
        else:
            self.lo, self.hi, self.inside, self.below = r["first"], r["last"], r["within"], under
        # a guess that hardly narrows (most values stand at the ends) is followed by one that halves the floats
        self.halve = self.inside > before * 0.9
        self.guess = (self.lo, _between(self.lo, self.hi))
        self.close()


def _long_medians(df: DataFrame, by: str, series: Sequence[tuple[object, str]]) -> dict[tuple[object, str], float | None]:
    """Exact medians of long columns of several tables, all in the same few passes.

    Values are melted to (table, column, value).  Each pass is one aggregate: a
    mergeable quantile sketch of the values inside the bracket of each series guesses
    where the middle lies, the next pass counts exactly how many values stand under and
    inside the guess.  The bracket becomes the part that holds both middle ranks, so
    it always shrinks and a bad guess costs a pass, not the answer.  The driver sees one line
    for each series.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for _, c in series))
    number = {c: i for i, c in enumerate(columns)}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), quoted(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    melted = df.select(quoted(by).alias("t"), cells.alias("cell")).select("t", "cell.c", "cell.v").where("v is not null")
    kind = df.schema[by].dataType.simpleString()

    # ranks are constants to a sketch: all of a grid are read, and the next point on the outer side is taken
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def quantile(sketch: str, rank, outward: int):
        place = (rank + F.lit(outward * SLACK)) * GRID
        at = (F.floor(place) if outward < 0 else F.ceil(place)).cast("int")
        return F.get(F.kll_sketch_get_quantile_double(sketch, grid), F.greatest(F.lit(0), F.least(F.lit(GRID), at)))

    wanted = spark.createDataFrame([(t, number[c]) for t, c in series], f"t {kind}, c int")
    real = F.when(~F.isnan("v"), F.col("v"))  # a NaN is above all numbers
    # the few lines go to the rows: nothing says how small they are, so a planner left to itself sorts or broadcasts the rows
    first = melted.join(F.broadcast(wanted), ["t", "c"]).groupBy("t", "c").agg(
        F.count("*").alias("n"), F.count(real).alias("reals"), F.min(real).alias("lo"), F.max(real).alias("hi"), F.kll_sketch_agg_double(real, SKETCH).alias("sketch")
    )
    middle = F.col("n") / 2 / F.col("reals")
    first = first.select(
        "t", "c", "n", "reals", "lo", "hi",
        *[F.when(F.col("reals") > 0, quantile("sketch", middle, d)).alias(n) for n, d in (("a", -1), ("z", 1))],
    )
    out: dict[tuple[object, str], float | None] = dict.fromkeys(series)
    open_: dict[tuple[object, str], _Bracket] = {}
    for r in first.collect():
        key, ranks = (r["t"], columns[r["c"]]), ((r["n"] - 1) // 2, r["n"] // 2)
        if ranks[1] >= r["reals"]:
            out[key] = math.nan
            continue
        open_[key] = _Bracket(*ranks, r["lo"], r["hi"], 0, r["reals"], (r["a"], r["z"]))
        open_[key].close()

    while True:
        for key in [k for k, b in open_.items() if b.ends]:
            out[key] = _middle(*open_.pop(key).ends)
        if not open_:
            return out
        lines = [(t, number[c], b.lo, b.hi, *b.guess, b.low_rank - b.below, b.high_rank - b.below) for (t, c), b in open_.items()]
        told = spark.createDataFrame(lines, f"t {kind}, c int, lo double, hi double, a double, z double, low_rank bigint, high_rank bigint")
        v, within = F.col("v"), F.col("v").between(F.col("a"), F.col("z"))
        counted = melted.join(F.broadcast(told), ["t", "c"]).where(v.between(F.col("lo"), F.col("hi"))).groupBy("t", "c", "low_rank", "high_rank").agg(
            F.count_if(v < F.col("a")).alias("under"), F.count_if(within).alias("within"),
            F.max(F.when(v < F.col("a"), v)).alias("down"), F.min(F.when(v > F.col("z"), v)).alias("up"),
            F.min(F.when(within, v)).alias("first"), F.max(F.when(within, v)).alias("last"),
            F.kll_sketch_agg_double(F.when(within, v), SKETCH).alias("sketch"),
        )
        asked = [("a", "low_rank", -1), ("z", "high_rank", 1)]
        counted = counted.withColumns({
            n: F.when(F.col("within") > 0, quantile("sketch", (F.col(rank) - F.col("under") + 0.5) / F.col("within"), d)) for n, rank, d in asked
        })
        for r in counted.drop("sketch").collect():
            b = open_[r["t"], columns[r["c"]]]
            b.narrow(r)
            kept_the_guess = (b.lo, b.hi) == (r["first"], r["last"])
            if kept_the_guess and not b.halve and r["a"] <= r["z"]:
                b.guess = (r["a"], r["z"])


def _middle(low: float, high: float) -> float:
    middle = (low + high) / 2
    return middle if math.isfinite(middle) else low if low == high else low / 2 + high / 2


def _between(lo: float, hi: float) -> float:
    """A value from lo up to below hi that halves the floats between them, also for infinities and extreme ranges.

    The bits of a float, read as a whole number, have the order of its values (below zero the reverse one).
    """

    def number(x: float) -> int:
        bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
        return bits if bits >= 0 else -(bits & SIGN_OFF)

    middle = (number(lo) + number(hi)) // 2
    value = struct.unpack("<d", struct.pack("<q", abs(middle)))[0]
    return value if middle >= 0 else -value


def means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value of each column as text (exact for Spark's own casts)."""
    return modes_by(df.withColumn(_ONLY, F.lit(0)), _ONLY, cols).get(0, {})


# ------------------------------------------------------------ one value per table of a stack


def medians_by(
    df: DataFrame, by: str, counts: Mapping[object, Mapping[str, int]], small: int = SMALL
) -> dict[object, dict[str, float | None]]:
    """Exact medians per table number; ``counts[table][column]`` are non-null rows.

    All short columns of all tables are one grouped aggregate, all long ones share a few others.
    """
    out: dict[object, dict[str, float | None]] = {g: {c: None for c in cols} for g, cols in counts.items()}
    short: dict[str, list] = {}
    for g, cols in counts.items():
        for c, n in cols.items():
            if 0 < n <= small:
                short.setdefault(c, []).append(g)
    if short:
        aggs = [F.median(F.when(quoted(by).isin(*tables), quoted(c).cast("double"))).alias(f"m{i}") for i, (c, tables) in enumerate(short.items())]
        for row in df.groupBy(quoted(by).alias("_by")).agg(*aggs).collect():
            for i, c in enumerate(short):
                if row["_by"] in short[c]:
                    out[row["_by"]][c] = row[f"m{i}"]
    long = [(g, c) for g, cols in counts.items() for c, n in cols.items() if n > small]
    if long:
        for (g, c), value in _long_medians(df, by, long).items():
            out[g][c] = value
    return out


def means_by(df: DataFrame, by: str, cols: Sequence[str]) -> dict[object, dict[str, float | None]]:
    rows = df.groupBy(quoted(by).alias("_by")).agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)]).collect()
    return {r["_by"]: {c: r[f"m{i}"] for i, c in enumerate(cols)} for r in rows}


def modes_by(df: DataFrame, by: str, cols: Sequence[str]) -> dict[object, dict[str, str]]:
    """Most frequent value per table and column as text, the smallest on ties (A4).

    One scan for all columns: cells are melted to (table, column, value) with one field
    for each type, so values keep their own order.  Counting is a partial aggregate: a
    value that fills a third of the table is pre-counted where it is read.
    """
    if not cols:
        return {}
    types = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in cols))
    fields = [f"v{k}" for k in range(len(types))]

    def cell(i: int, c: str):
        own = df.schema[c].dataType.simpleString()
        values = [(quoted(c) if t == own else F.lit(None).cast(t)).alias(f) for f, t in zip(fields, types)]
        return F.struct(F.lit(i).alias("c"), quoted(c).isNotNull().alias("known"), *values)

    melted = df.select(quoted(by).alias("_by"), F.explode(F.array(*[cell(i, c) for i, c in enumerate(cols)])).alias("cell")).select("_by", "cell.*").where("known")
    counted = melted.groupBy("_by", "c", *fields).agg(F.count("*").alias("n"))
    best = counted.groupBy("_by", "c").agg(F.min(F.struct((-F.col("n")).alias("n"), *fields)).alias("b"))
    rows = best.select("_by", "c", F.coalesce(*[F.col(f"b.{f}").cast("string") for f in fields]).alias("value")).collect()
    out: dict[object, dict[str, str]] = {}
    for r in rows:
        out.setdefault(r["_by"], {})[cols[r["c"]]] = r["value"]
    return out
