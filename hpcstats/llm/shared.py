"""Plumbing shared by the operators: shared-folder tables, documents columns, sizes.

Intermediate tables go as Parquet into the folder named by
``spark.checkpoint.dir`` (every executor reaches it), never to a machine-local
folder: they survive a lost executor, cut the lineage, and later passes read
only the columns they need.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.session import ensure_checkpoint_dir

# Tables of at most so many rows (each a few hundred bytes) may be broadcast.
SMALL_ROWS = 200_000

# Characters that separate words; a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_written: list[tuple[int, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's shared folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/llm-{label}-{uuid.uuid4().hex}"
    _written.append((id(spark), path))
    return path


def stored(df: DataFrame, label: str, folder: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once into the shared folder (or into ``folder``, a path in it) and read it back."""
    path = f"{folder}/{label}" if folder else scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while the block runs jobs: for tables whose rows are large."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession):
    """Every job of the block deletes its shuffle files when it ends, not when the driver next collects garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table or folder made by ``scratch_path``, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables written so far in this session.

    Only for callers whose earlier results are already written elsewhere, as
    between the stages of the pipeline.
    """
    for entry in [e for e in _written if e[0] == id(spark)]:
        deleted(spark, entry[1])
        _written.remove(entry)


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """``df`` with the named columns only, cast to the given types.

    Extra columns are dropped here, so names that an operator uses itself
    cannot clash with them; a missing column becomes NULL.
    """
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, most: int = SMALL_ROWS) -> DataFrame:
    """Inner join of ``rows`` with a stored table of one row per key; ``weight`` counts the rows that a key has.

    Keys with more than a ``most``-th of all rows (there are fewer than
    ``most``) are broadcast, so no hot key is dealt to one task; the others
    meet in a shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * most > total
    few = table.where(hot)
    spread = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(spread)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_case(text):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def binary_schema(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
