"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by the number q of their distinct five-word shingles, and
each partition keeps the k = q - ceil(0.8 q) + 1 smallest shingle hashes of an
item, its bottom-k MinHash sketch.  A document that holds at least 0.8 of the
shingles misses at most k - 1 of them, so it holds one of the sketch: the search
misses nothing.  (Banded signatures of whole documents cannot do this: an item of
20 shingles in a document of 20,000 has a Jaccard similarity of 0.001.)

All sketch hashes mark one bit map of fixed size, all item shingles another; both
travel to the tasks whatever the number of items.  A document with no marked
sketch hash is done; otherwise its marked shingles leave the task as text and are
joined with the shingles of the items, so the containment that decides is exact.

Defined results
* words are runs of anything but ASCII white space, A-Z lower-cased; an item of
  fewer than five words is one shingle of all its words, an item without words
  (null, empty) is found nowhere; a document without words holds nothing
* items of equal shingles are one item, named by the smallest id, with their number;
  ``every_item`` tells each of their ids
* rows of equal id and text are one document; equal ids with other texts, and null
  ids, stay apart by their text; other columns are left alone
* empty tables give an empty result
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import rolling
from tablewright.llm.bits import bit_map, marked
from tablewright.llm.work import Work, chunks, small_batches, text_key

WIDTH = 5
SIMILARITY = 0.8
MAP_BITS = 24  # 2 MB; more items only let more shingles through to the exact join
CHUNK = 1 << 18  # bytes of text hashed at once; the hashes take some fifty times as much
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sketch_size(shingles: int, similarity: float = SIMILARITY) -> int:
    return shingles - math.ceil(round(similarity * shingles, 9)) + 1


def shingled(texts: list[bytes], width: int):
    """Lower-cased bytes, and starts, ends and hashes of the runs of ``width`` words, with the text each is in."""
    data, bounds = rolling.join(texts)
    data = LOWER[data]
    starts, ends, first = rolling.words(data, bounds)
    hashes = rolling.word_hashes(data, starts, ends)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    n = max(0, len(starts) - width + 1)
    whole = np.flatnonzero(of[:n] == of[width - 1 :]) if n else np.zeros(0, np.int64)
    total = np.zeros(len(whole), np.uint64)
    for j in range(width):
        total += hashes[whole + j] * rolling.U64(2 * j + 1)
        total = rolling.mixed(total)
    return data, starts, ends, of, whole, total


def _item_rows(width: int, similarity: float):
    """One row for every distinct shingle of an item; ``item`` is the digest of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = {"item_id": [], "item": [], "shingle": [], "hash": [], "rank": [], "q": [], "in_sketch": [], "width": []}
            ids = batch.column(0).to_pylist()
            for item, text in zip(ids, texts):
                n = min(width, len((text or b"").split()))
                if not n:
                    continue
                data, starts, ends, _, whole, hashes = shingled([text], n)
                seen = {}
                for w, h in zip(whole.tolist(), hashes.tolist()):
                    seen[_shingle(data, starts, ends, w, n)] = h
                order = sorted(seen, key=seen.get)
                k = sketch_size(len(order), similarity)
                digest = sum(seen.values()) % (1 << 63)
                for rank, shingle in enumerate(order):
                    for name, value in zip(out, (item, digest, shingle, seen[shingle] - (1 << 64) * (seen[shingle] >> 63), rank, len(order), rank < k, n)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(out.values(), (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()))],
                names=list(out),
            )

    return run


def _shingle(data, starts, ends, word: int, width: int) -> str:
    return " ".join(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in range(word, word + width))


def _hits(sketch: bytes, every: bytes, widths: list[int], bits: int, slots: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketched, known = np.frombuffer(sketch, np.uint8), np.frombuffer(every, np.uint8)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts, CHUNK):
                for width in widths:
                    data, starts, ends, of, whole, hashes = shingled([t or b"" for t in texts[a:b]], width)
                    found = marked(sketched, hashes, bits)
                    if not found.any():
                        continue
                    candidate = np.zeros(b - a, bool)
                    candidate[of[whole[found]]] = True
                    take = np.flatnonzero(marked(known, hashes, bits) & candidate[of[whole]])
                    rows = pa.array(a + of[whole[take]])
                    text = [_shingle(data, starts, ends, w, width) for w in whole[take].tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(text, pa.string())], names=[*slots, "shingle"])

    return run


def _found_items(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, key, item, item_id, n_items, n_shingles, n_found, containment), where ``item`` is the digest of equal items; and the stored items."""
    work = Work(docs.sparkSession, "decontamination")
    kind = items.schema[item_id].dataType.simpleString()
    raw = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).mapInArrow(
        _item_rows(width, similarity), f"item_id {kind}, item bigint, shingle string, hash bigint, rank int, q int, in_sketch boolean, width int"
    )
    with small_batches(docs.sparkSession):
        stored = work.save(raw, "items")
    names = stored.where("rank = 0").groupBy("item").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    shingles = work.save(stored.drop("item_id", "rank").dropDuplicates(["item", "shingle"]).join(names, "item"), "shingles")
    widths = [r[0] for r in shingles.select("width").distinct().collect()]  # at most ``width`` numbers
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    doc_kind = docs.schema[id_col].dataType.simpleString()
    found = slim.mapInArrow(
        _hits(bit_map(shingles.where("in_sketch"), MAP_BITS), bit_map(shingles, MAP_BITS), widths, MAP_BITS, ("id", "key")), f"id {doc_kind}, key bigint, shingle string"
    )
    with small_batches(docs.sparkSession):
        found = work.save(found, "found")
    pairs = found.join(shingles.select("item", "shingle", "item_id", "n_items", "q", "in_sketch"), "shingle").groupBy("id", "key", "item").agg(
        F.min("item_id").alias("item_id"), F.max("n_items").alias("n_items"), F.max("q").cast("long").alias("n_shingles"), F.count_distinct("shingle").alias("n_found"), F.max("in_sketch").alias("sketched")
    )
    share = F.col("n_found") / F.col("n_shingles")
    return pairs.where(F.col("sketched") & (F.col("n_found") >= F.ceil(F.round(F.col("n_shingles") * similarity, 9)))).select(
        F.col("id").alias(id_col), "key", "item", "item_id", "n_items", "n_shingles", "n_found", share.alias("containment")
    ), stored


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", width=WIDTH, similarity=SIMILARITY) -> DataFrame:
    """(id, key, item_id, n_items, n_shingles, n_found, containment) of every document that holds ``similarity`` of an item.

    ``key`` is the digest of the document's text.  Items of equal shingles are one.
    """
    return _found_items(docs, items, id_col, text_col, item_id, item_text, width, similarity)[0].drop("item")


def every_item(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", width=WIDTH, similarity=SIMILARITY) -> DataFrame:
    """(id, key, item_id, n_shingles, n_found, containment): like ``contaminated``, with a row for each of the items of equal shingles."""
    found, stored = _found_items(docs, items, id_col, text_col, item_id, item_text, width, similarity)
    members = stored.where("rank = 0").select("item", "item_id").distinct()
    return found.drop("item_id", "n_items").join(members, "item").select(id_col, "key", "item_id", "n_shingles", "n_found", "containment")


def without_leaks(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no item."""
    leaks = contaminated(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("id"), F.col("key")).distinct()
    leaks = Work(docs.sparkSession, "leaks").save(leaks, "leaks").alias("l")
    held = docs.alias("d")
    return held.join(leaks, F.col(f"d.`{id_col}`").eqNullSafe(F.col("l.id")) & (text_key(f"d.`{text_col}`") == F.col("l.key")), "left_anti")
