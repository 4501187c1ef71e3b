"""Removal of passages that stand more than once: by words (FM-index) or by bytes (suffix sorting).

Defined results, for both
* null or empty text: nothing to remove; a text shorter than a window is kept whole
* windows never cross documents; overlapping windows remove their union; windows are
  judged on the input, not on what is left
* rows of equal id and text: for words each of them is an occurrence, so all go; for
  bytes they are one document, and all get its result
* null ids are the latest; an empty table gives an empty result; other columns are left alone
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.fm_index import repeated_windows
from tablewright.llm.repeats import Unit, named, removed_windows
from tablewright.llm.suffix_sort import later_windows
from tablewright.llm.work import Work

WORDS = Unit(words=True, width=35, gram=8)
BYTES = Unit(words=False, width=100, gram=32)


def spans(runs: list[dict] | None, width: int, size: int) -> list[tuple[int, int]]:
    """Covered units as disjoint half-open ranges; ``runs`` are in ascending order."""
    out: list[tuple[int, int]] = []
    for run in runs or ():
        a, b = run["from"], min(size, run["to"] + width)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(units, covered: list[tuple[int, int]]) -> list:
    kept, at = [], 0
    for a, b in covered:
        kept.append(units[at:a])
        at = b
    kept.append(units[at:])
    return kept


def _cleaned(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, ranges, kept = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                units = (text.as_py() or b"").split() if unit.words else text.as_py() or b""
                covered = spans(found.as_py(), unit.width, len(units))
                left = _without(units, covered)
                sizes.append(len(units))
                removed.append(sum(b - a for a, b in covered))
                ranges.append([{"from": a, "to": b} for a, b in covered])
                kept.append(b" ".join([w for part in left for w in part]) if unit.words else b"".join(left))
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(ranges, span), pa.array(kept, pa.binary())],
                names=["id", "n_units", "n_removed", "spans", "kept"],
            )

    return run


def _remove(docs: DataFrame, unit: Unit, index, keep_first: bool, label: str, id_col: str, text_col: str) -> DataFrame:
    work = Work(docs.sparkSession, label)
    rows = named(docs, id_col, text_col)
    gone = removed_windows(rows, unit, index, keep_first, work)
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.join(gone, "key", "left").select("id", "text", "runs").mapInArrow(
        _cleaned(unit), f"id {kind}, n_units bigint, n_removed bigint, spans array<struct<from:bigint,to:bigint>>, kept binary"
    )
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", unit: Unit = WORDS) -> DataFrame:
    """(id, n_units, n_removed, spans, kept): no word stays that a repeated window of 35 words covers.

    ``kept`` has the remaining words with one space between them.
    """
    return _remove(docs, unit, repeated_windows, False, "words", id_col, text_col).withColumn("kept", F.col("kept").cast("string"))


def without_later_copies(docs: DataFrame, id_col="doc_id", text_col="text", unit: Unit = BYTES) -> DataFrame:
    """(id, n_units, n_removed, spans, kept): no byte stays that a window of 100 bytes covers which stands earlier too.

    ``kept`` has the remaining bytes; a cut may fall inside a character.
    """
    return _remove(docs, unit, later_windows, True, "bytes", id_col, text_col)
