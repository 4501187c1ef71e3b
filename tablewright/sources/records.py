"""CSV records whose quoted cells hold line breaks, cut in parallel (S1), and their place in the files.

A file is read as lines, by as many tasks as it has splits.  Whether a line begins a record depends on
all quotes before it, so every split first tells what it does to the one thing that matters, being inside or
outside a quoted cell: it leads both to the same side, keeps both or swaps both.  A running
composition over the splits of a file (one row each) gives the side every split begins on; with
it each split cuts its lines by itself.  Only the two ends of a split, where a record may go on in its
neighbour, are put together afterwards.

A quote opens a cell only at its beginning; two quotes inside a quoted cell stand for one.
Line breaks inside cells are kept as they are; a record ends with \\n or \\r\\n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import materialise

QUOTE = b'"'
OUTSIDE, INSIDE = 0, 1


def side_after(line: bytes, side: int, comma: bytes) -> int:
    """The side on which a line ends that begins on ``side``."""
    at, opening = 0, comma + QUOTE
    if side == OUTSIDE:
        if line.startswith(QUOTE):
            at, side = 1, INSIDE
    while True:
        if side == INSIDE:
            at = line.find(QUOTE, at)
            if at < 0:
                return INSIDE
            if line[at + 1 : at + 2] == QUOTE:
                at += 2
                continue
            at, side = at + 1, OUTSIDE
        at = line.find(opening, at)
        if at < 0:
            return OUTSIDE
        at, side = at + 2, INSIDE


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(split, file, block, line) in the order of each split."""
    raw = spark.read.option("lineSep", "\n").text(list(paths))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = raw.select(*place, F.col("value").cast("binary").alias("line"))
    return lines.select(F.xxhash64("file", "block").alias("split"), "file", "block", "line")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Consecutive lines of one split, as they stand in a batch."""
    for batch in batches:
        split, file, block, line = (batch.column(i) for i in range(4))
        ids = split.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield (int(ids[a]), file[a].as_py(), block[a].as_py()), line[a:b].to_pylist()


def _sides(comma: bytes):
    """One row for each split: the sides it ends on, having begun outside and inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, outside, inside = None, OUTSIDE, INSIDE

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"split": place[0], "file": place[1], "block": place[2], "outside": outside, "inside": inside}] if place else [], schema)

        schema = pa.schema([("split", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32())])
        for here, lines in _pieces(batches):
            if here != place:
                yield told()
                place, outside, inside = here, OUTSIDE, INSIDE
            for line in lines:
                if QUOTE in line:
                    outside, inside = side_after(line, outside, comma), side_after(line, inside, comma)
        yield told()

    return run


def starting_sides(splits: DataFrame) -> DataFrame:
    """(split, side) that every split begins on: the composition of all splits of the file before it."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    led = F.col("outside") == F.col("inside")  # to one side, whatever came before
    swaps = F.when(~led & (F.col("outside") == INSIDE), 1).otherwise(0)
    counted = splits.withColumn("swaps", F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(led, F.struct("outside", "swaps")), ignorenulls=True).over(before)
    so_far = F.coalesce(F.lag("swaps").over(order), F.lit(0))
    side = (F.coalesce(last["outside"], F.lit(OUTSIDE)) + so_far - F.coalesce(last["swaps"], F.lit(0))) % 2
    return counted.select("split", side.cast("int").alias("side"))


WHOLE, HEAD, TAIL = range(3)


def _cut(comma: bytes, begun_inside):
    """Lines to records: whole ones, the end of one begun before the split (HEAD), the beginning of one that goes on (TAIL)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("part", pa.int32()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = begun_inside.value
        place, side, held, no, first = None, OUTSIDE, [], 0, True
        out: list[tuple[int, int, bytes]] = []

        def told() -> pa.RecordBatch:
            n = len(out)
            numbers, parts, records = zip(*out) if out else ((), (), ())
            file, block = (place[1], place[2]) if place else (None, None)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(parts, pa.int32()), pa.array(records, pa.binary())], schema=schema)

        def finish() -> None:
            if held:  # nothing closed the record: it goes on, or the whole split lies inside of one
                out.append((no, HEAD if first else TAIL, b"\n".join(held)))

        for here, lines in _pieces(batches):
            if here != place:
                finish()
                yield told()
                at = np.searchsorted(inside, here[0])
                place, no, held, out = here, 0, [], []
                side = INSIDE if at < len(inside) and inside[at] == here[0] else OUTSIDE
                first = side == INSIDE
            for line in lines:
                if side == INSIDE or QUOTE in line:
                    side = side_after(line, side, comma)
                held.append(line)
                if side == OUTSIDE:
                    out.append((no, HEAD if first else WHOLE, b"\n".join(held).removesuffix(b"\r")))
                    held, first, no = [], False, no + 1
            yield told()
            out = []
        finish()
        yield told()

    return run


def cut_records(spark: SparkSession, paths: Sequence[str], comma: str = ",") -> DataFrame:
    """(file, block, no, record): every record of the files, as bytes without its last line break.

    ``file``, ``block`` and ``no`` order the records as they stand in the files.  Empty lines outside of cells are left out.
    The splits that begin inside a cell are sent to the tasks as eight bytes each (six
    megabytes for 100 TB).
    """
    sign = comma.encode()
    if len(sign) != 1:
        raise ValueError("Cells are parted by a single ASCII sign.")
    splits = _lines(spark, paths).mapInArrow(_sides(sign), "split bigint, file string, block bigint, outside int, inside int")
    inside = starting_sides(materialise(splits, "csv-splits")).where(F.col("side") == INSIDE).select("split")
    chosen = np.sort(np.array([r["split"] for r in inside.toLocalIterator()], np.int64))
    sent = spark.sparkContext.broadcast(chosen)
    cut = _lines(spark, paths).mapInArrow(_cut(sign, sent), "file string, block bigint, no bigint, part int, record binary")
    if not len(chosen):
        whole = cut  # no split begins inside a cell: no record is in two
    else:
        cut = materialise(cut, "csv-records")
        ends = cut.where(F.col("part") != WHOLE)
        # a TAIL opens a group, the HEADs of the splits after it belong to it
        order = Window.partitionBy("file").orderBy("block", F.col("part") == TAIL)
        opened = F.last(F.when(F.col("part") == TAIL, F.struct("block", "no")), ignorenulls=True).over(order)
        joined = ends.withColumn("of", opened).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("pieces"))
        bytes_ = F.aggregate(F.slice("pieces", 2, F.size("pieces")), F.col("pieces")[0]["record"], lambda a, p: F.concat(a, F.lit(b"\n"), p["record"]))
        together = joined.select("file", F.col("of.block").alias("block"), F.col("of.no").alias("no"), bytes_.alias("record"))
        whole = cut.where(F.col("part") == WHOLE).select("file", "block", "no", "record").unionByName(together)
    return whole.select("file", "block", "no", "record").where(F.length("record") > 0)
