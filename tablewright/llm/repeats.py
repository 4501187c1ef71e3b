"""Windows that stand more than once in a corpus, found shard by shard.

1. The keys of all segments are counted; those seen twice mark a bit map of fixed size.
2. Segments with a marked key are stored by position and counted by content.
   Copies of one content are one line from here on, with their number and first place.
3. Anchors with two or more contents are contested: the contents share some windows at most.
   The text of one occurrence of each goes to a shard, whole anchors together, and an index of the shard
   (given by the caller) tells which windows of each content are repeated.
4. An anchor of more than ``MOST`` contents (a passage in a great part of all documents)
   is no longer kept together: the windows of its contents are dealt out and counted one by one,
   each content once, however many copies it has.

Bit maps only spare shuffles: what they let through is matched exactly afterwards.
Documents are named by a 64-bit digest of id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import rolling
from tablewright.llm.anchors import Segments, segments
from tablewright.llm.bits import bit_map, marked
from tablewright.llm.work import Work, chunks, text_key

CHUNK = 1 << 20  # bytes of text handled at once
MOST = 16384  # contents of an anchor that stay together
SHARD = 1 << 18  # units of text in one index, or those of a single anchor
MAP_BITS = 26


@dataclass(frozen=True)
class Unit:
    """What a window is made of: bytes or words."""

    words: bool
    width: int
    gram: int

    def laid_out(self, texts: list[bytes]):
        """(values, bounds, payload of a range of units)."""
        data, bounds = rolling.join(texts)
        raw = data.tobytes()
        if not self.words:
            return rolling.byte_values()[data], bounds, lambda a, b: raw[a:b]
        starts, ends, first = rolling.words(data, bounds)
        return rolling.word_hashes(data, starts, ends), first, lambda a, b: b" ".join(raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist()))


def _place_hash(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names an occurrence, as Spark's xxhash64(key, start) does."""
    return rolling.xxhash64_of_longs(keys, starts).view(np.int64)


def _cut(unit: Unit, batches: Iterator[pa.RecordBatch]):
    """(batch, first row, segments, bounds, payload) of every chunk; the text is the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts, CHUNK):
            values, bounds, payload = unit.laid_out([t or b"" for t in texts[a:b]])
            yield batch, a, segments(values, bounds, unit.width, unit.gram), bounds, payload, values


def _keys(unit: Unit):
    def run(batches):
        for _, _, found, _, _, _ in _cut(unit, batches):
            keys, n = np.unique(np.concatenate((found.before, found.after[found.after != found.before])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["hash", "n"])

    return run


def _chosen(marks: np.ndarray, found: Segments, *by: np.ndarray) -> Segments:
    """Segments one of whose hashes is marked."""
    take = np.logical_or.reduce([marked(marks, x, MAP_BITS) for x in by])
    return Segments(*(c[take] for c in found))


def _segments(unit: Unit, twice):
    def run(batches):
        marks = np.frombuffer(twice.value, np.uint8)
        for batch, a, found, _, _, _ in _cut(unit, batches):
            s = _chosen(marks, found, found.before, found.after)
            rows = pa.array(a + s.text)
            keys = batch.column(1).take(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), keys, pa.array(s.start), pa.array(s.windows), pa.array(s.anchor), pa.array(s.content)],
                names=["id", "key", "start", "windows", "anchor", "content"],
            )

    return run


def _payloads(unit: Unit, places):
    def run(batches):
        marks = np.frombuffer(places.value, np.uint8)
        for batch, a, found, bounds, payload, _ in _cut(unit, batches):
            keys = np.asarray(batch.column(1))
            s = _chosen(marks, found, _place_hash(keys[a + found.text], found.start))
            first = bounds[s.text] + s.start
            texts = [payload(x, y) for x, y in zip(first.tolist(), (first + s.windows + unit.width - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.anchor), pa.array(s.content), pa.array(keys[a + s.text]), pa.array(s.start), pa.array(texts, pa.binary())],
                names=["anchor", "content", "key", "start", "payload"],
            )

    return run


def _content_windows(unit: Unit, batches):
    """All single windows of contents: (batch, row, place in the content, hash)."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in chunks(texts, CHUNK):
            values, bounds, _ = unit.laid_out(texts[a:b])
            windows = np.maximum(0, np.diff(bounds) - unit.width + 1)
            row = np.repeat(np.arange(b - a), windows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = bounds[row] + place
            yield batch, a + row, place, rolling.Ranges(values).hashes(at, at + unit.width).view(np.int64)


def _window_counts(unit: Unit, keep_first: bool):
    """Times a window stands in different contents (``keep_first``), or in all their copies."""

    def run(batches):
        for batch, row, _, content in _content_windows(unit, batches):
            hashes, inverse = np.unique(content, return_inverse=True)
            n = np.zeros(len(hashes), np.int64)
            np.add.at(n, inverse, 1 if keep_first else np.asarray(batch.column(3))[row])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], names=["hash", "n"])

    return run


def _windows(unit: Unit, twice):
    """The windows marked, each with its content and its first place there."""
    names = ["anchor", "content", "n", "nothing", "id", "key", "start", "at", "hash"]

    def run(batches):
        marks = np.frombuffer(twice.value, np.uint8)
        for batch, row, place, content in _content_windows(unit, batches):
            take = marked(marks, content, MAP_BITS)
            rows = pa.array(row[take])
            anchor, named_, n, nothing, id_, key = (batch.column(i).take(rows) for i in (0, 1, 3, 4, 5, 6))
            start = np.asarray(batch.column(7))[row[take]] + place[take]
            yield pa.RecordBatch.from_arrays([anchor, named_, n, nothing, id_, key, pa.array(start), pa.array(place[take]), pa.array(content[take])], names=names)

    return run


def _shards(unit: Unit, index: Callable):
    """Reads rows in the order of their anchors; ``index`` gets the contents of whole anchors, about SHARD units together."""
    names = ["anchor", "content", "from", "to"]

    def indexed(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2])  # in the order of their first places
        number, start, end = index([r[3] for r in rows], np.array([r[4] for r in rows]), unit.width)
        columns = [np.array([r[i] for r in rows], np.int64)[number] for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, start, end)], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            order = zip(*(batch.column(i).to_pylist() for i in range(4, batch.num_columns)))
            for (anchor, content, payload, n), rank in zip(zip(*columns), order):
                if size >= SHARD and rows[-1][0] != anchor:
                    yield indexed(rows)
                    rows, size = [], 0
                rows.append((anchor, content, rank, payload, n))
                size += payload.count(b" ") + 1 if unit.words else len(payload)
        if rows:
            yield indexed(rows)

    return run


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text)."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text_key(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text"))


def removed_windows(rows: DataFrame, unit: Unit, index: Callable, keep_first: bool, work: Work) -> DataFrame:
    """(key, runs): runs of windows to remove, as an array of (from, to), counted in units from the start of the text.

    ``rows`` is from ``named``.  With ``keep_first`` the earliest window of equal ones stays (smallest
    id, nulls last, then place); otherwise all of them go.  ``index`` gets the contents of a shard in the order of
    their first places, with their numbers, and returns (content, from, to) of the windows in each that go.
    """
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()

    def shared(marks: bytes):
        return spark.sparkContext.broadcast(marks)  # of fixed size

    counted = rows.select("key", "text").mapInArrow(_keys(unit), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    twice = shared(bit_map(counted.where("n > 1"), MAP_BITS))
    found = work.save(rows.mapInArrow(_segments(unit, twice), f"id {kind}, key bigint, start bigint, windows bigint, anchor bigint, content bigint"), "segments")

    rank = F.struct(F.col("id").isNull().alias("nothing"), "id", "key", "start")
    contents = work.save(found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.max("windows").alias("windows"), F.min(rank).alias("first")), "contents")
    groups = contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum("n").alias("places")).where("places > 1")
    groups = work.save(groups, "groups")
    held = work.save(contents.join(groups.select("anchor", "contents"), "anchor"), "held")
    work.drop("contents", "groups")

    contested = held.where("contents > 1").select("anchor", "content", "n", "contents", "first")
    places = shared(bit_map(contested.select(F.xxhash64("first.key", "first.start").alias("hash")), MAP_BITS))
    texts = rows.mapInArrow(_payloads(unit, places), "anchor bigint, content bigint, key bigint, start bigint, payload binary")
    whole = texts.join(contested, ["anchor", "content"]).where("key = first.key AND start = first.start").select("anchor", "content", "payload", "n", "first.*", "contents")
    whole = whole.dropDuplicates(["anchor", "content"])  # repeated rows are one document, whose first places are read once for each row
    whole = work.save(whole, "payloads")
    dealt = whole.where(F.col("contents") <= MOST).drop("contents").repartition("anchor").sortWithinPartitions("anchor")
    runs = dealt.mapInArrow(_shards(unit, index), "anchor bigint, content bigint, from bigint, to bigint")
    runs = runs.unionByName(_counted(whole.where(F.col("contents") > MOST).drop("contents"), unit, kind, keep_first, work))
    runs = work.save(runs.groupBy("anchor", "content").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "runs")
    work.drop("payloads", "windows", "windows-twice")

    every = F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.col("windows") - 1).alias("to")))
    here = (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start")) if keep_first else F.col("n") == 1
    lines = held.select("anchor", "content", "n", F.struct("first.key", "first.start").alias("first"))
    lines = work.save(lines.join(runs, ["anchor", "content"], "left"), "lines")
    gone = found.join(lines, ["anchor", "content"]).select("key", "start", F.explode(F.when(here, F.col("runs")).otherwise(every)).alias("run"))
    gone = gone.select("key", (F.col("start") + F.col("run.from")).alias("from"), (F.col("start") + F.col("run.to")).alias("to"))
    gone = work.save(gone.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("runs")), "gone")
    work.drop("segments", "held", "runs", "lines")
    return gone


def _counted(contents: DataFrame, unit: Unit, kind: str, keep_first: bool, work: Work) -> DataFrame:
    """(anchor, content, from, to): what an index of these contents would return, in runs of one window."""
    counts = contents.select("anchor", "content", "payload", "n").mapInArrow(_window_counts(unit, keep_first), "hash bigint, n bigint")
    twice = contents.sparkSession.sparkContext.broadcast(bit_map(counts.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), MAP_BITS))
    line = f"anchor bigint, content bigint, n bigint, nothing boolean, id {kind}, key bigint, start bigint, at bigint, hash bigint"
    single = work.save(contents.mapInArrow(_windows(unit, twice), line), "windows")
    if keep_first:
        repeated = single.groupBy("hash").agg(F.count("*").alias("times"), F.min(F.struct("nothing", "id", "key", "start")).alias("first"))
        repeated = repeated.select("hash", "times", "first.key", "first.start")
        gone = (F.col("s.key") != F.col("r.key")) | (F.col("s.start") != F.col("r.start"))
    else:
        repeated = single.groupBy("hash").agg(F.sum("n").alias("times"))
        gone = F.col("s.n") == 1  # more copies: all of the content goes anyway
    repeated = work.save(repeated.where("times > 1"), "windows-twice")
    more = single.alias("s").join(repeated.alias("r"), "hash").where(gone)
    return more.select("s.anchor", "s.content", F.col("at").alias("from"), F.col("at").alias("to"))
