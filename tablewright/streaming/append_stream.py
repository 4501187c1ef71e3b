"""Incremental append: files that arrive in a folder are added to a base table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tablewright.functions import fixed_values as fv
from tablewright.functions.compare import row_signature, signature_keys
from tablewright.operators.combine import FILE_NO, SIGNATURE, classify_new
from tablewright.operators.order import quoted
from tablewright.operators.totals import drop_total_rows
from tablewright.plans.clean import CARRIED, drop_rows, fill_missing, normalise_text, parse_columns, remove_duplicates
from tablewright.plans.rules import CleanPlan
from tablewright.session import path_exists
from tablewright.streaming.signature_log import SignatureLog, digest

BATCH = "_batch"


class AppendStream:
    """State of an incremental append below one folder.

    ``store/kept`` holds base and added rows, ``store/skipped`` the rest,
    partitioned by micro-batch; ``store/signatures`` the digests of the comparison keys in
    runs that are merged as they grow in number.  A batch that is run again after a failure
    replaces its own partition and its own run, so the result is the same as if it had run once.
    """

    def __init__(self, spark: SparkSession, store: str, plan: CleanPlan, keys: Sequence[str] | None = None,
                 order_by: Sequence[str] | None = None):
        self.spark = spark
        self.store = store.rstrip("/")
        self.plan = plan
        self.keys = signature_keys(plan.columns, keys, plan.exempt)
        self.order_by = order_by
        self.signatures = SignatureLog(spark, f"{self.store}/signatures", SIGNATURE)
        carried = [c for c, r in plan.fills.items() if r.strategy in CARRIED]
        if carried:
            raise ValueError(f"A stream has no row order to fill {carried} from; use a constant, median, mean or mode.")

    @property
    def kept_path(self) -> str:
        return f"{self.store}/kept"

    @property
    def skipped_path(self) -> str:
        return f"{self.store}/skipped"

    def _write(self, df: DataFrame, path: str, batch: int) -> None:
        df.drop(BATCH).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    def _signed(self, parsed: DataFrame) -> DataFrame:
        return parsed.withColumn(SIGNATURE, digest(row_signature(parsed, self.keys)))

    def start_from(self, base: DataFrame) -> "AppendStream":
        """Store the base as batch -1, read with the frozen plan but not filled."""
        plans = {None: self.plan}
        parsed = parse_columns(drop_total_rows(base), plans)
        signed = self._signed(parsed)
        # later batches may hold fractions where the base has whole numbers
        final = fill_missing(parsed, plans).schema
        self._write(parsed.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in final]), self.kept_path, -1)
        self.signatures.add(signed, -1)
        return self

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch: parse, sign, clean, compare with everything before it."""
        self.signatures.compact(batch)
        plans = {None: self.plan}
        parsed = parse_columns(drop_total_rows(rows), plans)
        signed = self._signed(parsed)
        cleaned = normalise_text(
            remove_duplicates(fill_missing(drop_rows(signed, plans), plans), plans, None, self.order_by, [SIGNATURE]), plans
        )
        if signed.isEmpty():
            return
        marked = classify_new(self.signatures.before(batch), cleaned.withColumn(FILE_NO, F.lit(0)), self.order_by)
        kept = marked.where(F.col("reason").isNull())
        skipped = marked.where(F.col("reason").isNotNull()).drop(FILE_NO, SIGNATURE).withColumnRenamed("reason", fv.REASON_COLUMN)
        self.signatures.add(kept, batch)
        self._write(kept.drop(FILE_NO, SIGNATURE, "reason"), self.kept_path, batch)
        self._write(skipped, self.skipped_path, batch)

    def run(self, in_dir: str, schema: StructType, checkpoint: str, fmt: str = "parquet",
            available_now: bool = True, trigger_seconds: int = 60, **options) -> StreamingQuery:
        """Watch ``in_dir``; with ``available_now`` take what is there and stop."""
        stream = self.spark.readStream.schema(schema).format(fmt).options(**options).load(in_dir)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{trigger_seconds} seconds"}
        return (
            stream.writeStream.foreachBatch(lambda df, batch: self.process(df, batch))
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def kept(self) -> DataFrame:
        return self.spark.read.parquet(self.kept_path).drop(BATCH)

    def skipped(self) -> DataFrame | None:
        if not path_exists(self.spark, self.skipped_path):
            return None
        return self.spark.read.parquet(self.skipped_path).drop(BATCH)
