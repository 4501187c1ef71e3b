"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where more than half of the XXH64 values (seed 42) of
the document's three-word shingles have it set.  Two fingerprints link when they
differ in at most ``radius`` = 2 bits.  Copies share a fingerprint, so each different
fingerprint is compared once, whatever the size of its group.

Two fingerprints within two bits agree on at least two of their four 16-bit
quarters, so each pair of quarters deals the fingerprints into buckets, and no link
lies outside them all.  Buckets are cut into tiles of bounded size by population count;
a task compares two tiles by exclusive-or and bit counts, and tile pairs whose
population counts differ by more than the radius are skipped.  A tile pair returns a spanning forest
of its links: components lose nothing, and no group writes out all its pairs.

Defined results
* A-Z lower-cased; fewer than three words: the whole sequence is the only shingle;
  no words (null, empty): fingerprint zero, linked like any other
* ids may repeat or be null: links are between fingerprints; a component is named by
  its smallest id, null if it has none; other columns are left alone
* an empty table gives an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import components, spanning
from tablewright.llm.work import Work, small_batches

WIDTH = 3
SEED = 42
RADIUS = 2
QUARTERS = 4
TILE = 1024
AT_ONCE = 1 << 16  # shingles whose bits are counted in one step


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(stops)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, AT_ONCE):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[a : a + AT_ONCE], stops[a : a + AT_ONCE])), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            values = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, text_col="text", width=WIDTH, keep: tuple[str, ...] = ("doc_id",), more: dict | None = None) -> DataFrame:
    """The columns ``keep`` (renamed k0, k1, …) and the fingerprint ``fp`` of every document as a signed number."""
    slim = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[e.alias(n) for n, e in (more or {}).items()], F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(_fingerprints(width), f"{kinds}, fp bigint")


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                x = np.asarray(left.values).view(np.uint64)
                y = x if same.as_py() else np.asarray(right.values).view(np.uint64)
                both = x if same.as_py() else np.concatenate([x, y])
                shift = 0 if same.as_py() else len(x)
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                a, b = np.nonzero(np.triu(near, 1) if same.as_py() else near)
                if len(a):
                    a, b = spanning(len(both), a, b + shift)
                    values = both.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], names=["a", "b"])

    return run


def near_links(prints: DataFrame, work: Work, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` bits; ``prints`` has each ``fp`` once."""
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(QUARTERS)]
    keys = [F.struct(F.lit(n).alias("part"), (quarter[i] * 65536 + quarter[j]).alias("key")) for n, (i, j) in enumerate(combinations(range(QUARTERS), QUARTERS - radius))]
    dealt = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("k")).select("fp", "ones", "k.part", "k.key")
    sizes = work.save(dealt.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    salt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE))
    tile = F.when(F.col("n") <= TILE, F.struct(F.lit(0).alias("band"), F.lit(0).cast("long").alias("salt"))).otherwise(F.struct(F.col("ones").alias("band"), salt.alias("salt")))
    tiles = dealt.join(sizes, ["part", "key"]).withColumn("tile", tile).groupBy("part", "key", "tile").agg(
        F.collect_list("fp").alias("fps"), F.min("ones").alias("least"), F.max("ones").alias("most")
    )
    tiles = work.save(tiles, "tiles")
    x, y = tiles.alias("x"), tiles.alias("y")
    meet = (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") <= F.col("y.tile"))
    near = (F.col("x.least") <= F.col("y.most") + radius) & (F.col("y.least") <= F.col("x.most") + radius)
    pairs = x.join(y, meet & near).select(F.col("x.fps").alias("left"), F.col("y.fps").alias("right"), (F.col("x.tile") == F.col("y.tile")).alias("same"))
    return pairs.mapInArrow(_compare(radius), "a bigint, b bigint")


def classes(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, radius=RADIUS) -> DataFrame:
    """(id, fp, component_id) of every document."""
    with small_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col, width, radius)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    work = Work(docs.sparkSession, "simhash")
    rows = work.save(fingerprints(docs, text_col, width, (id_col,)), "rows")
    names = work.save(rows.groupBy("fp").agg(F.min("k0").alias("least")), "prints")
    groups = components(near_links(names.select("fp"), work, radius), work)
    found = names.join(groups, names.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    found = work.save(found, "found")
    by_group = found.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = work.save(found.join(by_group, "component").select("fp", "component_id"), "classes")
    return rows.join(by_print, "fp").select(F.col("k0").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, radius=RADIUS) -> DataFrame:
    """Rows of ``docs``, with all their columns: of each component the one with the smallest id.

    Null ids come last; among rows of one id the first stored row stays.
    """
    with small_batches(docs.sparkSession):
        return _one_of_each(docs, id_col, text_col, width, radius)


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    work = Work(docs.sparkSession, "simhash-keep")
    plain = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    stored = work.save(docs.select(plain.alias("row"), F.monotonically_increasing_id().alias("at")), "docs")
    flat = stored.select("at", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    rows = work.save(fingerprints(flat, "text", width, ("id", "at")), "rows")
    rank = F.struct(F.col("k0").isNull(), F.col("k0"), F.col("k1"))
    names = work.save(rows.groupBy("fp").agg(F.min(rank).alias("first")), "prints")
    groups = components(near_links(names.select("fp"), work, radius), work)
    kept = names.join(groups, names.fp == groups.node, "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    kept = work.save(kept.select(F.col("first.k1").alias("at")), "kept")
    return stored.join(kept, "at", "left_semi").select("row.*")
