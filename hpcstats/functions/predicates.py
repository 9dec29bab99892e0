"""Predicates as data, compiled to Spark Columns.

A ``FilterSpec`` is the whole extract request: columns, conditions, time
window, IN list, DISTINCT, ORDER BY and LIMIT.  It is immutable; ``add`` and
``remove`` return new specs.  Values are bound by type (never spliced into
SQL text): the literal is cast to the column's type, so numeric columns
compare as numbers and timestamp columns as timestamps.  Catalyst then pushes
every condition into the scan.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.schema import MAX_DAYS_HOSTS, MAX_DAYS_JOBS, OPERATORS, UNIT_TO_EVENT

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def to_datetime(value) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value.replace(tzinfo=None) if value.tzinfo is None else \
            value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    return _dt.datetime.fromisoformat(str(value).strip())


def ts_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal (folded by Catalyst, so it is pushed down)."""
    return F.lit(to_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def number_literal(value, dtype: T.DataType) -> Column:
    """A number as written: whole ones as integers, decimals as decimals (no digit is lost), else doubles."""
    try:
        number = Decimal(value.strip().replace("_", "")) if isinstance(value, str) else \
            Decimal(value) if isinstance(value, int) else Decimal(repr(float(value))) if isinstance(value, float) else Decimal(str(value))
    except (InvalidOperation, ValueError) as exc:
        raise ValueError(f"value {value!r} is not a number") from exc
    if isinstance(dtype, (T.FloatType, T.DoubleType)) or not number.is_finite():
        return F.lit(float(number))
    if number == number.to_integral_value() and abs(number) < 2 ** 63:
        whole = int(number)
        small = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
        return F.lit(whole).cast(dtype if -(2 ** small) <= whole < 2 ** small and not isinstance(dtype, T.DecimalType) else "long")
    sign, digits, exponent = number.as_tuple()
    scale = max(0, -exponent)
    precision = max(len(digits) + max(0, exponent), scale)
    if precision > 38:
        return F.lit(float(number))
    return F.lit(format(number, "f")).cast(T.DecimalType(precision, scale))


def bind(value, dtype: T.DataType) -> Column:
    """cast a user value to the type of the column it is compared with."""
    if isinstance(dtype, _NUMERIC):
        return number_literal(value, dtype)
    if isinstance(dtype, _TIMES):
        return ts_literal(value)
    return F.lit(str(value))


@dataclass(frozen=True)
class Predicate:
    """One condition ``column op value``."""

    column: str
    op: str
    value: object

    def __post_init__(self):
        if self.op == "<>":           # the SQL spelling of !=
            object.__setattr__(self, "op", "!=")
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}; allowed: {OPERATORS}")

    def to_column(self, schema: T.StructType) -> Column:
        fields = {f.name: f.dataType for f in schema.fields}
        if self.column not in fields:
            raise ValueError(f"unknown column {self.column!r}")
        dtype = fields[self.column]
        c = F.col(self.column)
        if self.op == "LIKE":
            # Q22: LIKE only where the column is text.
            if not isinstance(dtype, T.StringType):
                raise ValueError(f"LIKE needs a text column, {self.column!r} is {dtype.simpleString()}")
            return c.like(str(self.value))
        lit = bind(self.value, dtype)
        return {"=": c == lit, "!=": c != lit, "<": c < lit, ">": c > lit,
                "<=": c <= lit, ">=": c >= lit}[self.op]


def normalise_value(table: str, value):
    """F8: job text is upper-cased; host text only when it mentions a job or node."""
    if not isinstance(value, str):
        return value
    if table == "job":
        return value.upper()
    folded = value.casefold()
    return value.upper() if ("job" in folded or "node" in folded) else value


def split_list(text: str) -> list[str]:
    """Split on comma and trim each value."""
    return [v.strip() for v in str(text).split(",")]


def check_window(start, end, max_days: int | None) -> tuple[_dt.datetime, _dt.datetime]:
    """start must be before end; whole days between them at most ``max_days``."""
    s, e = to_datetime(start), to_datetime(end)
    if s >= e:
        raise ValueError("Invalid Times")
    if max_days is not None and (e - s).days > max_days:
        raise ValueError("Time Window Too Large")
    return s, e


@dataclass(frozen=True)
class FilterSpec:
    """A whole extract request for one table (``table`` is 'host' or 'job')."""

    table: str = "host"
    columns: tuple = ("*",)
    predicates: tuple = ()
    window: tuple | None = None
    max_days: int | None = field(default=None)
    in_column: str | None = None
    in_values: tuple = ()
    distinct: bool = False
    order_by: tuple = ()
    descending: bool = False
    limit: int = 0

    def __post_init__(self):
        if self.table not in ("host", "job"):
            raise ValueError("table must be 'host' or 'job'")
        if isinstance(self.columns, str):
            object.__setattr__(self, "columns", (self.columns,))
        if isinstance(self.order_by, str):
            object.__setattr__(self, "order_by", (self.order_by,))
        if self.window is not None:
            cap = self.max_days if self.max_days is not None else None
            object.__setattr__(self, "window", check_window(self.window[0], self.window[1], cap))
        if isinstance(self.in_values, str):
            values = split_list(self.in_values)
            object.__setattr__(self, "in_values", tuple(values) if values and values[0] else ())
        if self.in_values and self.in_column is None:
            raise ValueError("IN values need an IN column")  # Q9
        if self.limit < 0:
            raise ValueError("limit must be >= 0")

    @property
    def time_column(self) -> str:
        return "time" if self.table == "host" else "start_time"

    @classmethod
    def with_default_cap(cls, table: str, **kw) -> "FilterSpec":
        """The original caps: 5 days for hosts, 180 for jobs."""
        return cls(table=table, max_days=MAX_DAYS_HOSTS if table == "host" else MAX_DAYS_JOBS, **kw)

    def add(self, column: str, op: str, value, normalise: bool = True) -> "FilterSpec":
        """new spec with one more condition."""
        if normalise:
            value = normalise_value(self.table, value)
        return replace(self, predicates=self.predicates + (Predicate(column, op, value),))

    def remove(self, index: int) -> "FilterSpec":
        """new spec without the condition at ``index``."""
        preds = list(self.predicates)
        del preds[index]
        return replace(self, predicates=tuple(preds))

    def condition(self, schema: T.StructType, in_list: bool = True) -> Column | None:
        """conjunction of all conditions, window and (if asked) IN list (None when empty)."""
        parts = [p.to_column(schema) for p in self.predicates]
        fields = {f.name: f.dataType for f in schema.fields}
        if self.window is not None:
            s, e = self.window
            parts.append(F.col(self.time_column).between(ts_literal(s), ts_literal(e)))
        if self.in_values and in_list:
            if self.in_column not in fields:
                raise ValueError(f"unknown IN column {self.in_column!r}")
            dtype = fields[self.in_column]
            parts.append(F.col(self.in_column).isin([bind(v, dtype) for v in self.in_values]))
        return reduce(lambda a, b: a & b, parts) if parts else None


def select_metrics(spec: FilterSpec | None) -> list[str]:
    """Metrics to analyse, from the *first* bound value of a host spec.

    The first condition's value equal to a unit or an event picks that metric;
    anything else (or no condition) picks all six.  Returns event names.
    """
    if spec is None or not spec.predicates:
        return list(UNIT_TO_EVENT.values())
    first = spec.predicates[0].value
    chosen = [event for unit, event in UNIT_TO_EVENT.items() if first in (unit, event)]
    return chosen or list(UNIT_TO_EVENT.values())
