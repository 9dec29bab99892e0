"""Scalar text/time functions (C1-C9), all built-in Spark expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from hpcstats.schema import EXPORT_TIME_FORMAT

# The characters Python's str.strip()/float() treat as whitespace, as a Java regex class.
WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Keep only letters, digits and commas."""
    return F.regexp_replace(_c(col), "[^a-zA-Z0-9,]", "")


def strip_ws(col) -> Column:
    """Trim ASCII whitespace at both ends (Spark's trim only removes spaces)."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def split_trim(col) -> Column:
    """Comma-separated text -> array of trimmed values."""
    return F.transform(F.split(_c(col), ","), strip_ws)


def to_naive_utc(col) -> Column:
    """Zoned timestamp (an instant) -> its naive UTC wall clock, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _c(col).cast("timestamp").cast("timestamp_ntz"))


def stamp(col) -> Column:
    """``yyyy-MM-dd-HH-mm-ss`` text of a timestamp."""
    return F.date_format(_c(col), "yyyy-MM-dd-HH-mm-ss")


def stamp_py(value) -> str:
    return value.strftime(EXPORT_TIME_FORMAT) if isinstance(value, _dt.datetime) else str(value)


def wall_micros(col) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's zone."""
    t = _c(col).cast("timestamp_ntz")
    clock = (F.hour(t) * 60 + F.minute(t)).cast("long") * F.lit(60_000_000)
    return F.unix_date(t.cast("date")) * F.lit(86_400_000_000) + clock + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def whole_days(start, end) -> Column:
    """Whole days between two times (floored)."""
    return F.floor((wall_micros(end) - wall_micros(start)) / F.lit(86_400_000_000)).cast("long")


def fixed(col, decimals: int = 2) -> Column:
    """Fixed-decimals text, as a chart annotation shows it."""
    return F.format_string(f"%.{int(decimals)}f", _c(col))
