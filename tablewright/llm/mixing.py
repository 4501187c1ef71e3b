"""Mixing sources to target weights with DataFrame functions only.

Every document has a place in the order of a 64-bit hash of its id and text, and
a source takes the documents below a threshold of that hash.  The threshold is
found without sorting: words are summed by source and hash bucket, a running sum
over the buckets finds the one in which the budget ends, and only that bucket is
split again, ten bits at a time, down to the single hash value.  Thresholds are
nested: a larger budget takes all that a smaller one takes.

Defined results
* null or empty text: size 0, taken 0; a null source is a source of its own and comes last
* null or repeated ids: rows of equal id and text share one hash.  If the budget
  ends within such rows, each gives an equal part of its words.  A single
  document at the end of the budget gives as many words as are still missing.
* an empty table gives an empty result; other columns are left alone
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.work import Work, text_key

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 10  # a histogram has at most 2^10 cells for each source
LEVELS = 3  # the last step then groups by the whole hash, at most one part in 2^30 of a source
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col: str, text_col: str) -> Column:
    """The document's place in the order of the mix."""
    return F.xxhash64(F.col(id_col), text_key(text_col))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """Words each source shall give: ``share`` of all words by weight, at most ``max_repeats`` times its own.

    ``sizes`` has one row per source (source, source_size).  Sources in code point
    order, null last, get the weights in turn.  What a full source cannot give is
    shared again by weight; each round adds all sources that are full and brings
    three numbers to the driver, so the loop ends after a few rounds.  The order of the
    sources is one window over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    work = Work(sizes.sparkSession, "mix-sources")
    ranked = work.save(sizes.withColumn("weight", turn), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    room = F.col("source_size") * F.lit(max_repeats)
    rate, full = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(rate) > room
        n, given, weight = ranked.agg(
            F.count(F.when(is_full, 1)),
            F.coalesce(F.sum(F.when(is_full, room)), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == full or not weight:
            break
        full, rate = n, (share * total - given) / weight
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(rate), room.cast("double")))


def thresholds(docs: DataFrame, weights=WEIGHTS, share=1.0, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row per source: whole copies of everything, and the hash up to which there is one copy more.

    ``docs`` has (source, size, place); it is read once per level, so it should be
    a stored table.
    """
    work = Work(docs.sparkSession, "mix-cuts")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    size = F.col("source_size")
    state = targets(sizes, weights, share, max_repeats).select(
        "source", "source_size", "target",
        F.when(size > 0, F.floor(F.col("target") / size)).otherwise(1).cast("int").alias("copies"),
    ).withColumn("need", F.when(size > 0, F.col("target") - F.col("copies") * size).otherwise(0.0))
    state = work.save(state.withColumn("cell", F.lit(0).cast("long")).withColumn("cell_size", size), "level-0")
    bits = [LEVEL_BITS * (i + 1) for i in range(LEVELS)] + [64]
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    before = 0
    for level, have in enumerate(bits, 1):
        inside = docs.select("source", "size", "place").alias("d").join(
            state.select("source", "cell").alias("s"),
            F.col("d.source").eqNullSafe(F.col("s.source")) & ((_top(F.col("d.place"), before) == F.col("s.cell")) if before else F.lit(True)),
        )
        cells = inside.groupBy(F.col("d.source").alias("source"), _top(F.col("d.place"), have).alias("cell")).agg(
            F.sum("d.size").alias("cell_size"), F.count("*").alias("rows")
        )
        upto = cells.withColumn("upto", F.sum("cell_size").over(running))
        old = state.drop("cell", "cell_size", "rows").alias("o")
        ends = upto.alias("u").join(old, F.col("u.source").eqNullSafe(F.col("o.source"))).where("u.upto > o.need")
        first = ends.groupBy("u.source").agg(F.min_by(F.struct("u.cell", "u.cell_size", "u.rows", (F.col("u.upto") - F.col("u.cell_size")).alias("below")), "u.cell").alias("end"))
        state = work.save(
            old.join(first.select(F.col("source").alias("of"), "end"), F.col("o.source").eqNullSafe(F.col("of")), "left").select(
                "o.source", "source_size", "target", "copies",
                (F.col("need") - F.coalesce(F.col("end.below"), F.lit(0))).alias("need"),
                F.col("end.cell").alias("cell"), F.col("end.cell_size").alias("cell_size"), F.col("end.rows").alias("rows"),
            ),
            f"level-{level}",
        )
        before = have
    return state


def _top(place: Column, bits: int) -> Column:
    return F.shiftright(place, 64 - bits) if bits < 64 else place


def _with_cuts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each document beside the cut of its source; the cuts are small and joined by their measured size."""
    return docs.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.0, max_repeats=MAX_REPEATS) -> DataFrame:
    """(id, source, size, source_size, target, taken): the words the mix takes of every document, repeats counted."""
    work = Work(docs.sparkSession, "mix")
    slim = work.save(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), place(id_col, text_col).alias("place")),
        "sizes",
    )
    cuts = thresholds(slim, weights, share, max_repeats)
    need, cell, cell_size = (F.col(f"c.{n}") for n in ("need", "cell", "cell_size"))
    size, at = F.col("d.size"), F.col("d.place")
    end = F.floor(size * need / cell_size)
    more = F.when(at < cell, size).when((at == cell) & (cell_size > 0) & (need > 0), end).otherwise(0)
    return _with_cuts(slim, cuts).select(
        F.col("d.id").alias(id_col), F.col("d.source").alias(source_col), size.alias("size"), F.col("c.source_size").alias("source_size"),
        F.col("c.target").alias("target"), (F.col("c.copies") * size + more).cast("long").alias("taken"),
    )


def mix_rows(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.0, max_repeats=MAX_REPEATS) -> DataFrame:
    """The mixed table itself: rows of ``docs`` with all their columns, as many times as the mix takes them.

    Documents are taken whole; rows of one hash at the end of a budget are all
    taken if at least half of them fits.
    """
    work = Work(docs.sparkSession, "mix-rows")
    plain = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    slim = docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"), place(id_col, text_col).alias("place"))
    cuts = thresholds(work.save(slim, "sizes"), weights, share, max_repeats)
    rows = docs.select(F.col(source_col).alias("source"), place(id_col, text_col).alias("place"), plain.alias("row"))
    taken = (F.col("d.place") < F.col("c.cell")) | ((F.col("d.place") == F.col("c.cell")) & (F.col("c.need") * 2 >= F.col("c.cell_size")) & (F.col("c.need") > 0))
    copies = F.least(F.col("c.copies") + F.when(taken, 1).otherwise(0), F.lit(max_repeats))  # empty texts cost nothing, and stand before any end
    out = _with_cuts(rows, cuts).select("d.row", copies.alias("copies")).where("copies > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
