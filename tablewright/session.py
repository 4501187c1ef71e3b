"""Session settings and shared scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for.  AQE splits skewed join partitions and
# switches to broadcast only on measured sizes.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long column expressions are built faster without a stack trace per call
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; on a cluster leave ``master`` out."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables of one run.

    It is the folder the cluster names in ``spark.checkpoint.dir``; where that is
    unset (tests on one machine) the warehouse folder of the session is used.
    Both are resolved by Hadoop, so executors and driver see the same place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared scratch folder; every call gives another one."""
    path = f"{scratch_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process wrote; returns their number.

    Call it once the results that were built on them have been saved.
    """
    paths, _written[:] = list(_written), []
    for path in paths:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    return len(paths)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage so that later passes neither repeat the work nor depend on
    shuffle files of executors that may be lost.  Parquet keeps column pruning
    and filter pushdown for the passes that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a location, local or shared."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)
