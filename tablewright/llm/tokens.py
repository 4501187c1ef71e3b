"""Token ids as Parquet list columns.

Documents are dealt into ranges of ascending id, encoded in their range and
written by Spark's Parquet writer: one row per document with a list of ids, the id
0 at its end.  Row groups have a set size, pages carry the column index and offset index,
and ids are dictionary or delta encoded, so a reader can fetch some documents, or
the metadata columns alone, without the rest.  Every row knows its range and its
place in it; the start over all files is that place plus the sizes of the ranges before,
one row for each range.

Encoding uses the ``tokenizers`` library.  Its splitting pattern never joins what a single space or line
break between two words parts, nor a letter and the sign or figure after it, so texts are cut there.  The
slices of a batch are told apart as numbers; each distinct one is given to the library once and its ids are put wherever it
stands.  A text with other white space, or with what looks like a special token, is one slice.  Slices
met lately are remembered, in two halves of bounded size, of which the older one gives way.

Defined results
* null or empty text: only the end id; null ids come last; rows of one id are
  ordered by a digest of their text, and equal rows are interchangeable
* an empty table writes an empty table; other columns are not written
"""

from __future__ import annotations

import gc
import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.byte_bpe import byte_places
from tablewright.llm.slices import Memory, told
from tablewright.llm.work import Work, chunks, small_batches, text_key

END = 0
VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 1 << 19  # slices, in each half of the memory of a worker: some 25 MB
SHORT = 64  # signs of a slice that is encoded together with others
ROWS = 1024  # rows taken from a batch at once
CHUNK = 1 << 21
AT_ONCE = 64  # slices in one text given to the library
ROW_GROUP = 32 << 20
LINE_BREAK = 198  # the id of a line break on its own in the byte-level vocabularies of this family

_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    """What is known for sure of the code points below 0x3001: a letter, a sign or figure, white space; the last place is for all others."""
    kinds = np.zeros(0x3002, np.uint8)
    kinds[[c for c in range(256) if chr(c).isalpha() and (c < 128 or c >= 0xC0)]] = LETTER
    kinds[[ord(c) for c in string.punctuation + string.digits]] = SIGN
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = WHITE
    kinds[[ord(" "), ord("\n")]] = PART
    return kinds


LETTER, SIGN, WHITE, PART = range(1, 5)
KINDS = _kinds()


class Encoder:
    """Ids of texts; ``of`` keeps one for each worker process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.memory = Memory(REMEMBERED)
        self.by_words = self.whole("\n") == [LINE_BREAK]

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def cuts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first byte of every slice in the texts put together, number of slices of every text)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
        kinds = KINDS.take(np.minimum(points, 0x3001))
        after = np.append(kinds[1:], PART)  # the end of a text counts as white space
        special = (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        parts = kinds == PART
        odd = (kinds == WHITE) | (parts & (after == PART)) | np.append(special, False)
        odd[ends] = False
        of_text = np.repeat(np.arange(len(texts)), sizes + 1)
        whole = np.zeros(len(texts), bool)
        whole[of_text[odd]] = True
        begins = parts.copy()
        begins[1:] |= points[:-1] == ord("\n")
        begins[1:] |= (kinds[:-1] == LETTER) & (kinds[1:] == SIGN)
        begins[1:] |= (kinds[:-1] == SIGN) & (points[:-1] != ord("'")) & (kinds[1:] == LETTER)
        begins &= ~whole[of_text] if self.by_words else False
        begins[starts] = True
        begins[ends] = False
        at = np.flatnonzero(begins)
        return byte_places(points, ends)[at], np.diff(np.searchsorted(at, np.append(0, ends + 1)))

    def ask(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode many slices in few calls: those of one word are parted by line breaks, which are tokens of their own."""
        slices = [s.decode() for s in raw]
        bare = [s[1:] if s[:1] == " " else s for s in slices]
        plain = [s for s, t in zip(slices, bare) if self.by_words and t.split() == [t] and len(t) <= SHORT and "<|" not in t]
        lines = ["\n".join(plain[i : i + AT_ONCE]) + "\n" for i in range(0, len(plain), AT_ONCE)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.model.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        cuts = 4 * np.flatnonzero(ids == LINE_BREAK)
        known = {}
        if len(cuts) == len(plain):
            coded = ids.tobytes()
            known = {s: coded[a:b] for s, a, b in zip(plain, [0, *(cuts[:-1] + 4).tolist()], cuts.tolist())}
        rest = [s for s in slices if s not in known]
        known.update((s, np.array(e.ids, "<u4").tobytes()) for s, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False)))
        lists = [known[s] for s in slices]
        return np.frombuffer(b"".join(lists), "<i4"), np.fromiter(map(len, lists), np.int64, len(lists)) // 4

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        ids, counts = self.joined(texts)
        return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of every text)."""
        gc.disable()  # many short-lived lists, none of them in a cycle
        try:
            return self.encoded(texts)
        finally:
            gc.enable()

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = "".join(texts).encode()
        first, counts = self.cuts(texts)
        if not len(first):
            return first, counts
        ids, sizes = told(data, first, np.append(first[1:], len(data)), self.memory, self.ask)
        per_text = np.bincount(np.repeat(np.arange(len(texts)), counts), sizes, len(texts)).astype(np.int64)
        return ids, per_text


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, row = Encoder.of(path), 0, 0
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            ids, parts = batch.column(0), batch.column(1)
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in chunks(texts, CHUNK):
                coded, sizes = encoder.joined(texts[a:b])
                bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.insert(coded, np.cumsum(sizes), end)))
                sizes = sizes + 1
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], parts[a:b], pa.array(np.arange(row, row + b - a)), pa.array(before + bounds[:-1]), pa.array(sizes), lists],
                    names=["id", "part", "row", "start_in_part", "n_tokens", "ids"],
                )
                before, row = before + int(bounds[-1]), row + b - a

    return run


def write(docs: DataFrame, path: str, id_col="doc_id", text_col="text", tokenizer: str | None = None, end=END, row_group=ROW_GROUP, encoding="dictionary") -> None:
    """Write the token table: (id, part, row, start_in_part, n_tokens, ids), in ascending id order.

    ``encoding`` of the ids is "dictionary" or "delta".
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is 'dictionary' or 'delta', not {encoding!r}")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.col("key")]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.spark_partition_id().alias("part"), "text")
    coded = dealt.mapInArrow(_encode(tokenizer or vocabulary(), end), f"id {kind}, part int, row bigint, start_in_part bigint, n_tokens bigint, ids array<int>")
    with small_batches(docs.sparkSession):
        coded.withColumnRenamed("id", id_col).write.options(**{
            "compression": "zstd", "parquet.block.size": str(row_group), "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        }).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The token table with ``start``: the ids of all documents before."""
    table = spark.read.parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"))
    offsets = Work(spark, "token-offsets").save(offsets, "offsets")  # stored: the join knows how small it is
    return table.join(offsets, "part").withColumn("start", F.col("tokens_before") + F.col("start_in_part")).drop("tokens_before")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        bounds = np.asarray(lists.offsets)
        raw = memoryview(np.asarray(lists.values, "<i4").tobytes())
        sums = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def digest(spark: SparkSession, path: str, id_col="doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files."""
    table = read(spark, path)
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("id"), "start", "n_tokens", "ids").mapInArrow(_checksums, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.withColumnRenamed("id", id_col)
