"""Writers of extract results.

Results are written by Spark's own writers, in parallel, one part file per
task -- never gathered into one process.  Zoned timestamps are written as
naive UTC wall-clock values (the export rule of the original), and the
output folder name carries table and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.functions.predicates import to_datetime
from hpcstats.functions.text import to_naive_utc
from hpcstats.schema import EXPORT_TIME_FORMAT


def utc_naive(df: DataFrame) -> DataFrame:
    """Every zoned timestamp column -> naive UTC; other columns untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(to_naive_utc(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export_name(table: str, fmt: str, start, end) -> str:
    """``{table}-data-{fmt}-{start}-to-{end}`` with ``%Y-%m-%d-%H-%M-%S`` stamps."""
    s = to_datetime(start).strftime(EXPORT_TIME_FORMAT)
    e = to_datetime(end).strftime(EXPORT_TIME_FORMAT)
    return f"{table}-data-{fmt}-{s}-to-{e}"


def write_csv(df: DataFrame, path: str, compression: str = "gzip", mode: str = "error") -> str:
    """Header, no index column, compressed part files."""
    utc_naive(df).write.mode(mode).option("header", True).option("compression", compression).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by=None) -> str:
    writer = utc_naive(df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "error") -> str:
    utc_naive(df).write.mode(mode).json(path)
    return path


def export(df: DataFrame, folder: str, table: str, start, end, fmt: str = "csv", mode: str = "error") -> str:
    """Write an extract under a folder named after table and window."""
    path = f"{folder.rstrip('/')}/{export_name(table, fmt, start, end)}"
    writers = {"csv": write_csv, "parquet": write_parquet, "json": write_json}
    if fmt not in writers:
        raise ValueError(f"unknown format {fmt!r}")
    return writers[fmt](df, path, mode=mode)


def is_empty(df: DataFrame) -> bool:
    """Reads at most one row."""
    return df.isEmpty()
