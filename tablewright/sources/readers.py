"""Reading tables.

CSV files are read as text columns first; empty-cell words become null and the
types are inferred in one aggregate, so dates and mixed columns stay text for
the cleaning rules to decide.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import fixed_values as fv
from tablewright.functions.numbers import trim_all
from tablewright.operators.order import ROW_ORDER as ORDER
from tablewright.operators.order import quoted
from tablewright.operators.profile import string_columns
from tablewright.session import filesystem, materialise
from tablewright.sources.records import cut_records

SUPPORTED = {"csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}
_NAME = "_file_name"
UTF8, WINDOWS, LATIN = "utf-8", "windows-1252", "latin-1"

INTEGER = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a scan that is split into fewer tasks than there are cores.

    Small files are read by one task each; rules that work hard on every value
    gain from spreading such rows once.  A large table already has more tasks than
    cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def list_tables(spark: SparkSession, folder: str, extensions: Sequence[str] = ("csv",)) -> list[str]:
    """Paths of a folder's files with the given extensions, in name order."""
    fs, path = filesystem(spark, folder)
    if not fs.exists(path):
        raise FileNotFoundError(f"No folder {folder}.")
    wanted = tuple(f".{e.lower().lstrip('.')}" for e in extensions)
    found = [str(s.getPath()) for s in fs.listStatus(path) if not s.isDirectory()]
    return sorted(p for p in found if p.lower().endswith(wanted))


def format_of(path: str) -> str:
    """Format by extension; anything unknown is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension not in SUPPORTED:
        raise ValueError(f"Cannot read {path}: the extension is {extension!r}, known are {', '.join(sorted(SUPPORTED))}.")
    return SUPPORTED[extension]


def file_encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, encoding, long_cells) per file: the first of UTF-8, windows-1252, latin-1 that fits.

    ``long_cells`` tells that a cell may go over several lines: some line has an odd number of
    quotes, or one that neither opens nor closes a cell.

    Lines are checked where they are read and only flags are combined, so a file
    of any size is checked by many tasks.
    """
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    wide = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    flags = raw.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(wide.rlike(fv.CP1252_UNDEFINED)).alias("undefined"),
        F.bool_or(((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1) | F.col("value").rlike('[^,"]"[^,"]')).alias("long_cells"),
    )
    return flags.select(
        "path",
        F.when(F.col("utf8"), F.lit(UTF8)).when(~F.col("undefined"), F.lit(WINDOWS)).otherwise(F.lit(LATIN)).alias("encoding"),
        F.coalesce("long_cells", F.lit(False)).alias("long_cells"),
    )


def _windows(c: Column | str) -> Column:
    """Read byte by byte before; the characters windows-1252 has instead of the control codes 0x80-0x9F are put in place."""
    return F.translate(c, fv.CP1252_BYTES, fv.CP1252_CHARS)


def _csv(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """Cells, file, name and place of files in which every line is a record."""
    reader = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("quote", '"').option("escape", '"')
        .option("encoding", "UTF-8" if encoding == UTF8 else "ISO-8859-1")
        .option("enforceSchema", False)
    )
    df = reader.csv(list(paths))
    data = df.columns
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    df = df.select("*", F.col("_metadata.file_name").alias(_NAME), place.alias(ORDER))
    if encoding == WINDOWS:
        table = str.maketrans(fv.CP1252_BYTES, fv.CP1252_CHARS)
        df = df.select(*[_windows(quoted(c)).alias(c.translate(table)) for c in data], _NAME, ORDER)
    return df


def _csv_records(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """The same of files with line breaks inside cells: records are cut first, then each is parsed by itself."""
    text = F.decode("record", "UTF-8" if encoding == UTF8 else "ISO-8859-1")
    records = cut_records(spark, paths).withColumn("record", _windows(text) if encoding == WINDOWS else text)
    order = F.struct("block", "no")
    headers = records.groupBy("file").agg(F.min_by("record", order).alias("record"), F.min(order).alias("at"))
    headers = materialise(headers, "csv-headers")
    names = {tuple(next(csv.reader([r["record"].removeprefix("\ufeff")], strict=False))) for r in headers.select("record").distinct().collect()}
    if len(names) > 1:
        raise ValueError(f"The files have different headers: {sorted(names)}")
    columns = list(names.pop()) if names else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # one row for each file: where its header stands
    body = records.join(headers.select(F.col("file").alias("f"), "at"), (F.col("file") == F.col("f")) & (F.struct("block", "no") > F.col("at")))
    cells = F.from_csv("record", F.lit(schema.toDDL()), {"quote": '"', "escape": '"', "multiLine": "true"})
    name = F.url_decode(F.replace(F.substring_index("file", "/", -1), F.lit("+"), F.lit("%2B")))
    place = F.struct("file", "block", F.col("no").alias("row"))
    return body.select(cells.alias("cells"), name.alias(_NAME), place.alias(ORDER)).select("cells.*", _NAME, ORDER)


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    infer: bool = True,
    source_col: str | None = None,
    with_order: bool = False,
    multi_line: bool | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """CSV files with equal headers as one table.

    Each file is read in its own encoding, files of one encoding together;
    ``encoding`` (utf-8, windows-1252 or latin-1) skips the pass that finds it out.
    ``source_col`` keeps the file name (S7).  ``with_order`` adds ``_ord``, which
    sorts rows as they stand in the files.

    Quoted cells may hold line breaks.  Files in which that may be (the same pass tells) are cut
    into records by many tasks; ``multi_line`` says so (or that it is not so) without that pass.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups: dict[tuple[str, bool], list[str]] = {}
    if encoding and multi_line is not None:
        groups[encoding, multi_line] = paths
    else:
        for row in file_encodings(spark, paths).orderBy("path").collect():
            groups.setdefault((encoding or row["encoding"], row["long_cells"] if multi_line is None else multi_line), []).append(unquote(row["path"]))
    parts = []
    for (name, records), group in groups.items():
        df = (_csv_records if records else _csv)(spark, group, name)
        data = [c for c in df.columns if c not in (_NAME, ORDER)]
        extra = [F.col(_NAME).alias(source_col)] if source_col else []
        parts.append(df.select(*[quoted(c) for c in data], *extra, *([ORDER] if with_order else [])))
    if not parts:
        raise ValueError("No rows found in the given files.")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    keep = [c for c in (source_col, ORDER) if c and c in out.columns]
    out = empty_to_null(out, keep)
    return infer_types(out, keep) if infer else out


def empty_to_null(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Words that stand for an empty cell become null."""
    cols = [c for c in string_columns(df) if c not in skip]
    return df.withColumns({c: F.when(~quoted(c).isin(*fv.NA_TOKENS), quoted(c)) for c in cols}) if cols else df


def infer_types(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Whole columns of integers, decimals or booleans get their type.

    One aggregate over all text columns (melted, so it is one small set of
    measures); dates and mixed columns stay text, and so do whole numbers beyond
    64 bits, which no type here would keep to the last digit.  Leading zeros are lost, as
    they are for any reader that infers numbers.
    """
    cols = [c for c in string_columns(df) if c not in skip]
    if not cols:
        return df
    pairs = F.array(*[F.struct(F.lit(i).alias("no"), quoted(c).alias("v")) for i, c in enumerate(cols)])
    found = {
        r["no"]: r
        for r in df.select(F.inline(pairs)).where("v is not null").groupBy("no").agg(
            F.bool_and(F.col("v").rlike(INTEGER)).alias("integer"),
            F.bool_and(trim_all(F.col("v")).try_cast("bigint").isNotNull()).alias("fits"),
            F.bool_and(F.col("v").rlike(DECIMAL)).alias("decimal"),
            F.bool_and(F.col("v").isin(*BOOLEAN)).alias("boolean"),
        ).collect()
    }
    typed: dict[str, Column] = {}
    for i, c in enumerate(cols):
        r = found.get(i)
        if r is None:
            continue
        if r["integer"] and not r["fits"]:
            continue
        kind = "bigint" if r["integer"] else "double" if r["decimal"] else "boolean" if r["boolean"] else None
        if kind:
            typed[c] = trim_all(quoted(c)).try_cast(kind)
    return df.withColumns(typed) if typed else df


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names only; of a CSV file no more than the first line is read."""
    if format_of(path) == "csv":
        return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).columns
    return read_table(spark, path).columns


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """One table in any supported format."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"Nothing at {path}.")
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return read_csv(spark, path, **options)
    return spark.read.format(fmt).load(path)


def read_folder(spark: SparkSession, folder: str, fmt: str = "csv", source_col: str = fv.SOURCE_COLUMN, **options) -> DataFrame:
    """All files of a folder with equal columns as one tagged table."""
    paths = list_tables(spark, folder, [fmt])
    if not paths:
        raise ValueError(f"No .{fmt} files in '{folder}'.")
    if fmt == "csv":
        return read_csv(spark, paths, source_col=source_col, **options)
    return spark.read.format(fmt).load(paths).select("*", F.col("_metadata.file_name").alias(source_col))
