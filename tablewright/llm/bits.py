"""Bit maps of fixed size over 64-bit hashes, built by Spark and read in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PART = 1 << 20  # bytes of a map that come to the driver at once


def bit_map(rows: DataFrame, bits: int) -> bytes:
    """Marks the leading ``bits`` bits of the column ``hash``; 2^bits / 8 bytes, whatever the rows."""
    spot = F.shiftrightunsigned("hash", 64 - bits) + 1  # Spark numbers buckets from 1 for the values 1 to 32,768
    parts = rows.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("part")
    )
    marks = np.zeros((1 << bits) // 8, np.uint8)
    # every partition is a job of its own here, and a map has MBs in all
    for bucket, part in parts.coalesce(max(1, len(marks) // PART)).toLocalIterator():
        marks[(bucket - 1) * len(part) : bucket * len(part)] = np.frombuffer(part, np.uint8)
    return marks.tobytes()


def marked(marks: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
