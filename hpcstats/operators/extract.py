"""Filter/extract operator for both tables (S1-S2 + P1-P6, F1-F11, A1-A2, O1-O3).

``extract(df, spec)`` is ``SELECT [DISTINCT] cols FROM t WHERE ... ORDER BY c
LIMIT n`` as a DataFrame plan.  The WHERE part is one conjunction placed
directly above the scan so Catalyst pushes it into Parquet; the projection
prunes the read schema; ORDER BY + LIMIT plans as TakeOrderedAndProject
(a per-partition top-k, then a merge of k rows per partition).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.functions.predicates import FilterSpec, bind, to_datetime
from hpcstats.schema import AUX_HOST_COLUMNS, JOB_COLUMNS

IN_LITERALS = 1_000   # longer IN lists are joined as a table
JOB_SELECTABLE = set(JOB_COLUMNS) | {"*"}


def _projection(df: DataFrame, spec: FilterSpec) -> list[str]:
    cols = list(spec.columns) or ["*"]
    if spec.table == "job" and not all(c in JOB_SELECTABLE for c in cols):
        raise ValueError("Invalid column name selected")  # P2
    if "*" in cols:
        return list(df.columns)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return cols


def order_column(name: str, descending: bool):
    """O1 with the database's null order: NULLS LAST ascending, NULLS FIRST descending."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()


def extract(df: DataFrame, spec: FilterSpec) -> DataFrame:
    cols = _projection(df, spec)
    long_list = len(spec.in_values) > IN_LITERALS
    cond = spec.condition(df.schema, in_list=not long_list)
    out = df.where(cond) if cond is not None else df
    if long_list:
        out = in_long_list(out, spec.in_column, spec.in_values)
    # ORDER BY may only name projected columns (this also keeps DISTINCT + ORDER BY legal)
    bad = [c for c in spec.order_by if c not in cols]
    if bad:
        raise ValueError(f"ORDER BY columns {bad} are not selected")
    out = out.select(*cols)
    if spec.distinct:
        out = out.distinct()
    if spec.order_by:
        out = out.orderBy(*[order_column(c, spec.descending) for c in spec.order_by])
    if spec.limit > 0:
        out = out.limit(spec.limit)
    return out


def in_long_list(df: DataFrame, column: str, values) -> DataFrame:
    """F6 for long lists: a semi join with the distinct values as a table, not a literal per value.

    The table's size is known to the planner, which broadcasts it only below its threshold.
    """
    if column not in df.columns:
        raise ValueError(f"unknown IN column {column!r}")
    dtype = df.schema[column].dataType
    for v in values if isinstance(dtype, T.NumericType) else ():
        bind(v, dtype)  # a value that is no number is refused, as in a short list
    texts = sorted({to_datetime(v).isoformat(sep=" ") if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType))
                    else str(v).strip().replace("_", "") if isinstance(dtype, T.NumericType) else str(v) for v in values})
    table = df.sparkSession.createDataFrame(pd.DataFrame({"_in": texts}), "_in string")
    kind = ("decimal(38,10)" if isinstance(dtype, T.IntegralType) else "timestamp_ntz" if isinstance(dtype, (T.TimestampType, T.DateType))
            else dtype.simpleString())
    wanted = table.select(F.col("_in").cast(kind).alias("_in"))
    return df.join(wanted, F.col(column).cast(kind) == F.col("_in") if kind == "decimal(38,10)" else F.col(column) == F.col("_in"), "left_semi")


def row_count(df: DataFrame) -> DataFrame:
    """A1: one-row count of a query, as a DataFrame (not an action)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def drop_aux(df: DataFrame) -> DataFrame:
    """Drop `type`, `diff`, `arc` where present."""
    return df.drop(*AUX_HOST_COLUMNS)


def series_columns(df: DataFrame, extra: list[str] | tuple = ()) -> DataFrame:
    """Only what the statistics need (time, event, value) plus named keys."""
    needed = ["time", "event", "value", *extra]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}")
    return df.select(*needed)


def with_unit(df: DataFrame, name: str = "unit") -> DataFrame:
    """Unit of each event from the six-row metric dimension.

    The dimension is a literal map, so this is a projection, not a join.
    """
    from hpcstats.schema import EVENT_TO_UNIT
    pairs = []
    for event, unit in EVENT_TO_UNIT.items():
        pairs += [F.lit(event), F.lit(unit)]
    return df.withColumn(name, F.create_map(*pairs)[F.col("event")])
