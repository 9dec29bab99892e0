"""Balanced splits of a table by any ordered column.

A large read is cut into pieces by conditions on one column: numbers, times,
dates or text.  The cut points come from a uniform sample of the column's
values, drawn by a hash per row (samples of parts of a table merge by union), of
about ``PER_PIECE`` values a piece, so pieces hold about as many rows each
however skewed the column is (to an eighth, one standard deviation); a value
that fills more than a piece is not cut.  The sample is ordered over ranges, and
only the cut points reach the driver: one value per piece, as many as the table
needs.  The conditions are disjoint and cover every row, those without a value
(and NaNs, which order above all numbers) included.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.plans.joins import materialize

PER_PIECE = 64
ROWS_PER_SPLIT = 1_000_000


def split_points(df: DataFrame, column: str, rows_per_split: int = ROWS_PER_SPLIT, per_piece: int = PER_PIECE,
                 rows: int | None = None) -> list:
    """Rising values of ``column`` between pieces of about ``rows_per_split`` rows (none if the table is one piece).

    ``rows``: how many rows the table has, if ``df`` is a sample of it already.
    """
    given = df.where(F.col(column).isNotNull())
    total = rows if rows is not None else given.count()
    pieces = -(-total // max(1, rows_per_split))
    if pieces <= 1:
        return []
    values = given.select(F.col(column).alias("v"))
    if rows is None and per_piece * pieces < total:
        draw = F.pmod(F.xxhash64(*given.columns, F.monotonically_increasing_id()), F.lit(1 << 40))
        values = given.where(draw < int((1 << 40) * per_piece * pieces / total)).select(F.col(column).alias("v"))
    ordered = values.repartitionByRange("v").select("v", F.spark_partition_id().alias("part"))
    sample = materialize(ordered, "split-sample")
    parts = {r["part"]: r["n"] for r in sample.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    drawn, before, starts = sum(parts.values()), 0, []
    for part in sorted(parts):
        starts.append((part, before))
        before += parts[part]
    if not starts:
        return []
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    place = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1 + F.element_at(offsets, F.col("part"))
    at = sample.select("v", place.alias("place")).where("place > 0")
    # the first value of every piece but the first: where place * pieces passes a multiple of the sample's size
    passed = F.floor(F.col("place") * pieces / drawn) > F.floor((F.col("place") - 1) * pieces / drawn)
    found = [r["v"] for r in at.where(passed).select("v").distinct().collect()]
    plain, nans = [v for v in found if v == v], [v for v in found if v != v]
    return sorted(plain) + nans[:1]   # NaN is above all numbers, as in the comparisons


def split_conditions(column: str, points: list) -> list[Column]:
    """Disjoint conditions that together hold for every row: below the first point, between two, from the last on, no value."""
    c = F.col(column)
    if not points:
        return [F.lit(True)]
    lits = [F.lit(p) for p in points]
    return [c < lits[0], *[(c >= a) & (c < b) for a, b in zip(lits, lits[1:])], c >= lits[-1], c.isNull()]


def sql_literal(value) -> str:
    """The value as SQL text; quotes inside text are doubled."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"no split point can be {value!r}")
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, float) and not math.isfinite(value):
        return f"CAST('{'NaN' if value != value else 'Infinity' if value > 0 else '-Infinity'}' AS FLOAT)"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value) if isinstance(value, decimal.Decimal) else repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def split_sql(column: str, points: list) -> list[str]:
    """The same conditions as SQL texts, for a database."""
    if not points:
        return ["1 = 1"]
    lits = [sql_literal(p) for p in points]
    return [f"{column} < {lits[0]}", *[f"({column} >= {a} AND {column} < {b})" for a, b in zip(lits, lits[1:])],
            f"{column} >= {lits[-1]}", f"{column} IS NULL"]


def split_read(df: DataFrame, column: str, points: list) -> list[DataFrame]:
    """The table in pieces: one filter each, pushed to the source."""
    return [df.where(c) for c in split_conditions(column, points)]
