"""What a growing table holds already: digests of its rows in sorted runs that are merged as they grow in number.

Every batch adds one run.  Eight neighbouring runs of one level become one run of the next level, so a
thousand batches leave some two dozen runs, and a row is rewritten once for each level.  A run is a
Parquet folder of 16-byte digests, sorted, with a Bloom filter in its footers; a lookup reads nothing else.

Runs are named by their first and last batch and count once their ``_SUCCESS`` mark is written; a run that
covers others replaces them, whether they could be deleted or not.  Only batches before the one that
is being processed are merged, and a stream never repeats those, so a batch that is run again
sees what it saw the first time and replaces its own run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import filesystem

FAN = 8
ROWS_PER_FILE = 4_000_000

Run = tuple[int, int, int]  # level, first batch, last batch


def digest(signature: str | Column) -> Column:
    """The first 128 bits of the SHA-256 of a signature."""
    return F.substring(F.unhex(F.sha2(F.col(signature).cast("string") if isinstance(signature, str) else signature, 256)), 1, 16)


def valid_runs(runs: Sequence[Run]) -> list[Run]:
    """Runs that no other one covers, in the order of their batches."""
    def covered(run: Run) -> bool:
        return any(o != run and o[1] <= run[1] and run[2] <= o[2] and o[0] > run[0] for o in runs)

    return sorted((r for r in runs if not covered(r)), key=lambda r: r[1])


def next_merge(runs: Sequence[Run], fan: int = FAN) -> list[Run]:
    """The first ``fan`` neighbours of one level, or nothing."""
    kept = valid_runs(runs)
    for i in range(len(kept) - fan + 1):
        part = kept[i : i + fan]
        if len({level for level, _, _ in part}) == 1:
            return part
    return []


class SignatureLog:
    """Digests below ``path``; the column of signatures is ``column``."""

    def __init__(self, spark: SparkSession, path: str, column: str, fan: int = FAN):
        self.spark, self.path, self.column, self.fan = spark, path.rstrip("/"), column, fan

    def _folder(self, run: Run) -> str:
        return f"{self.path}/run-{run[0]}_{run[1]}_{run[2]}"

    def runs(self) -> list[Run]:
        """All complete runs that no other one covers."""
        fs, path = filesystem(self.spark, self.path)
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("run-") and fs.exists(filesystem(self.spark, f"{self.path}/{name}/_SUCCESS")[1]):
                found.append(tuple(int(x) for x in name.removeprefix("run-").split("_")))
        return valid_runs(found)

    def _write(self, digests: DataFrame, run: Run, rows: int) -> None:
        files = max(1, -(-rows // ROWS_PER_FILE))
        # only digests move to the few tasks that write; a plain coalesce would draw the joins before into one task
        ordered = digests.repartitionByRange(files, self.column) if files > 1 else digests.repartition(1)
        ordered.sortWithinPartitions(self.column).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.column}", "true").parquet(self._folder(run))

    def add(self, signatures: DataFrame, batch: int) -> None:
        """Store the digests in ``column`` as the run of ``batch``."""
        digests = signatures.select(self.column).distinct()
        self._write(digests, (0, batch, batch), digests.count())

    def before(self, batch: int) -> DataFrame:
        """The digests of all batches before ``batch``."""
        folders = [self._folder(r) for r in self.runs() if r[2] < batch]
        if not folders:
            return self.spark.createDataFrame([], f"`{self.column}` binary")
        return self.spark.read.schema(f"`{self.column}` binary").parquet(*folders)

    def compact(self, batch: int) -> int:
        """Merge runs of batches before ``batch``; the number of merges."""
        merges = 0
        while part := next_merge([r for r in self.runs() if r[2] < batch], self.fan):
            run = (part[0][0] + 1, part[0][1], part[-1][2])
            both = self.spark.read.schema(f"`{self.column}` binary").parquet(*[self._folder(r) for r in part])
            self._write(both, run, both.count())
            merges += 1
            for old in part:
                fs, path = filesystem(self.spark, self._folder(old))
                fs.delete(path, True)
        return merges
