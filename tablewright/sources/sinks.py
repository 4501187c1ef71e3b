"""Writing tables."""

from __future__ import annotations

import uuid

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import java_format
from tablewright.operators.order import quoted
from tablewright.session import filesystem, path_exists


def as_text_dates(df: DataFrame, output_format: str | None) -> DataFrame:
    """Dates as text in a strftime format, for the CSV sink."""
    if not output_format:
        return df
    pattern = java_format(output_format, padded=True)
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return df.withColumns({c: F.date_format(quoted(c), pattern) for c in cols}) if cols else df


def write_csv(df: DataFrame, path: str, output_format: str | None = None, mode: str = "errorifexists") -> None:
    """A folder of CSV files with headers, written by all tasks."""
    out = as_text_dates(df, output_format)
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", output_format: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet by default; csv, json and orc as well."""
    if fmt == "csv":
        write_csv(df, path, output_format, mode)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", **options) -> None:
    """One folder per table, named ``<path>/<table>``.

    Empty tables are written too and keep their columns.
    """
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt, **options)


def replace_base(df: DataFrame, base_path: str, fmt: str = "parquet", overwrite: bool = False, **options) -> str:
    """Write the result over the table it was made from.

    Refused unless ``overwrite``.  The result is first written aside, because Spark
    cannot overwrite what it reads; then the old version becomes ``<base>.bak``
    and the new one takes its place by renaming.  Returns the backup path.
    """
    spark = df.sparkSession
    if not path_exists(spark, base_path):
        raise FileNotFoundError(f"There is no table at '{base_path}'.")
    if not overwrite:
        raise ValueError("The output is the base itself; pass overwrite=True to keep a .bak copy and go on.")
    base = base_path.rstrip("/")
    aside = f"{base}.new-{uuid.uuid4().hex}"
    write_table(df, aside, fmt, mode="errorifexists", **options)
    fs, base_p = filesystem(spark, base)
    backup = f"{base}.bak"
    _, backup_p = filesystem(spark, backup)
    if fs.exists(backup_p):
        fs.delete(backup_p, True)
    if not fs.rename(base_p, backup_p):
        raise OSError(f"Could not move '{base}' to '{backup}'.")
    _, aside_p = filesystem(spark, aside)
    if not fs.rename(aside_p, base_p):
        fs.rename(backup_p, base_p)
        raise OSError(f"Could not move the result to '{base}'.")
    return backup
