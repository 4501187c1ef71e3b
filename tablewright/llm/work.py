"""Tables of one run in the shared scratch folder, dropped as soon as they are read for the last time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import filesystem, scratch_root


EACH = 1 << 16  # rows of a task that writes short rows
BATCH_BYTES = 1 << 23  # of a small batch, whatever the length of its texts


class Work:
    """A folder of its own for every run, below ``spark.checkpoint.dir``.

    ``save`` writes a table there and reads it back: later passes repeat no work
    and need no shuffle file of an executor that may be lost.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def tasks(self, rows: int, each: int = EACH) -> int:
        """So many tasks are enough for so many rows: as many as run at once, or one for ``each`` rows."""
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // each))

    def dealt(self, df: DataFrame, rows: int | None, each: int = EACH) -> DataFrame:
        """``df``, of about so many rows (None: not known), in no more tasks than these are worth: few rows are not one task for every shuffle partition."""
        return df if rows is None else df.coalesce(self.tasks(rows, each))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = filesystem(self.spark, self.path(name))
            fs.delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """What is saved inside goes to Python in batches of so many rows and of ``BATCH_BYTES``: whole texts take much room, on both sides."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_key(text: str | Column) -> Column:
    """A 64-bit digest of a text; with the id beside it, it tells rows of equal ids apart."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def chunks(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts (bytes or None) of about ``most`` bytes together; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
