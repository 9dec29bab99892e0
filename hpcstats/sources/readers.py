"""Readers for host samples and job records.

Everything returns a lazy DataFrame.  Columns keep their stored type when it
already matches the data model and are not rewritten, so every filter of an
extract reaches the Parquet scan (`PushedFilters`).  NaN in `value` stays as
stored: extracts compare it as the database does (NaN above every number),
and the statistics operators treat it as missing (``missing_as_null``).
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.schema import HOST_OPTIONAL, HOST_SCHEMA, JOB_SCHEMA
from hpcstats.sources.splits import PER_PIECE, ROWS_PER_SPLIT, split_points, split_sql

# Environment variables of the database source; all four are required.
DB_ENV_VARS = ("DBHOST", "DBPW", "DBNAME", "DBUSER")


def nan_to_null(col: str | Column) -> Column:
    """NaN is "missing" in every statistic."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def missing_as_null(df: DataFrame, col: str = "value") -> DataFrame:
    """Q4: the statistics see NaN as NULL (a projection at the operator's entry)."""
    if col not in df.columns:
        return df
    return df.withColumn(col, nan_to_null(col))


def _conform(df: DataFrame, schema: T.StructType, optional: T.StructType | None = None,
             keep_extra: bool = True) -> DataFrame:
    """Select the model columns in model order, casting only where types differ."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in types]
    if missing:
        raise ValueError(f"input lacks columns {missing}")
    wanted = list(schema.fields) + [f for f in (optional.fields if optional else []) if f.name in types]
    cols = []
    for field in wanted:
        c = F.col(field.name)
        if types[field.name] != field.dataType:
            c = c.cast(field.dataType)
        cols.append(c.alias(field.name))
    names = {f.name for f in wanted}
    extra = [F.col(n) for n in df.columns if n not in names] if keep_extra else []
    return df.select(*cols, *extra)


def conform_host(df: DataFrame, keep_extra: bool = True) -> DataFrame:
    """Host sample frame in model order; extra columns (e.g. a tie key) are kept."""
    return _conform(df, HOST_SCHEMA, HOST_OPTIONAL, keep_extra)


def conform_job(df: DataFrame, keep_extra: bool = True) -> DataFrame:
    return _conform(df, JOB_SCHEMA, None, keep_extra)


def read_host(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Host samples from files (Parquet by default; any Spark file source)."""
    paths = [path] if isinstance(path, str) else list(path)
    return conform_host(spark.read.format(fmt).options(**options).load(paths))


def read_job(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Job records from files."""
    paths = [path] if isinstance(path, str) else list(path)
    return conform_job(spark.read.format(fmt).options(**options).load(paths))


def jdbc_options(table: str, env: dict | None = None, port: int = 5432,
                 partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None, fetch_size: int = 10_000) -> dict:
    """JDBC options from the four database variables.

    The database itself is split by Spark (``partitionColumn``/bounds/
    ``numPartitions``) instead of being fetched in pieces by one process.
    A missing variable raises ``ValueError``.
    """
    env = os.environ if env is None else env
    missing = [name for name in DB_ENV_VARS if not env.get(name)]
    if missing:
        raise ValueError(f"Missing one or more required environment variables: {', '.join(missing)}")
    opts = {
        "url": f"jdbc:postgresql://{env['DBHOST']}:{port}/{env['DBNAME']}",
        "user": env["DBUSER"],
        "password": env["DBPW"],
        "dbtable": table,
        "driver": "org.postgresql.Driver",
        "fetchsize": str(fetch_size),
    }
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned JDBC read needs lower_bound, upper_bound and num_partitions")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                     "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    return opts


def bounds_query(table: str, column: str) -> str:
    """The one-row query that finds the split bounds (runs inside the database)."""
    return f"(select min({column}) as lo, max({column}) as hi, count(*) as n from {table}) as bounds"


def sample_query(table: str, column: str, share: float) -> str:
    """The query that draws a uniform sample of the split column inside the database."""
    return f"(select {column} as v from {table} where {column} is not null and random() < {share:.12f}) as sample"


def read_jdbc_split(spark: SparkSession, table: str, column: str, rows_per_split: int = ROWS_PER_SPLIT,
                    kind: str = "host", env: dict | None = None) -> DataFrame:
    """The chunked fetch as Spark's parallel JDBC read, by conditions on any ordered column.

    The database counts its rows and draws a sample of the column; Spark reads
    one piece per condition, of about ``rows_per_split`` rows each, as many as
    the table needs (an empty table gives an empty frame with the schema).
    Text columns must be ordered by code points in the database (collation "C").
    """
    base = jdbc_options(table, env)
    read = lambda query: spark.read.format("jdbc").options(**{**base, "dbtable": query}).load()
    b = read(bounds_query(table, column)).first()
    if not b or b["n"] == 0 or b["lo"] is None:
        return read_jdbc(spark, table, kind, env)
    pieces = -(-int(b["n"]) // rows_per_split)
    sample = read(sample_query(table, column, min(1.0, PER_PIECE * pieces / int(b["n"]))))
    points = split_points(sample, "v", rows_per_split, rows=int(b["n"]))
    properties = {k: v for k, v in base.items() if k not in ("url", "dbtable")}
    df = spark.read.jdbc(base["url"], table, predicates=split_sql(column, points), properties=properties)
    return conform_host(df) if kind == "host" else conform_job(df)


def read_jdbc(spark: SparkSession, table: str, kind: str = "host", env: dict | None = None, **kw) -> DataFrame:
    """S3: read ``host_data``/``job_data`` from the database through Spark's JDBC source."""
    df = spark.read.format("jdbc").options(**jdbc_options(table, env, **kw)).load()
    return conform_host(df) if kind == "host" else conform_job(df)


def run_sql(spark: SparkSession, text: str, args: dict | None = None, views: dict | None = None) -> DataFrame:
    """Parameterised SQL over named frames; values are bound, never spliced."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate several sources (e.g. one table per month) by column name."""
    if not frames:
        raise ValueError("no sources given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
