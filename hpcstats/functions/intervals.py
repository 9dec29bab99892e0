"""Interval choice of the statistics: whole series, N rows, or a time span."""

from __future__ import annotations

from dataclasses import dataclass

# Window unit names and their short codes.
TIME_UNITS = {"Days": "D", "Hours": "H", "Minutes": "T", "Seconds": "S"}
UNIT_MICROS = {"D": 86_400_000_000, "H": 3_600_000_000, "T": 60_000_000, "S": 1_000_000}


@dataclass(frozen=True)
class Rows:
    """Rolling over the last ``n`` rows (needs ``n`` non-null values)."""

    n: int

    def __post_init__(self):
        if not isinstance(self.n, int) or self.n <= 0:
            raise ValueError("a row window needs n >= 1")


@dataclass(frozen=True)
class Span:
    """Rolling over the time span ``(t - w, t]`` (needs one non-null value)."""

    amount: int
    unit: str

    def __post_init__(self):
        if self.unit not in TIME_UNITS and self.unit not in UNIT_MICROS:
            raise ValueError(f"unknown window unit {self.unit!r}; use one of {list(TIME_UNITS)}")
        if self.amount <= 0:
            raise ValueError("a time window needs a positive length")

    @property
    def micros(self) -> int:
        code = TIME_UNITS.get(self.unit, self.unit)
        return int(self.amount) * UNIT_MICROS[code]

    @property
    def label(self) -> str:
        return f"{self.amount}{TIME_UNITS.get(self.unit, self.unit)}"


def parse_interval(kind: str | None, amount=None, unit: str | None = None):
    """W10: 'None'/None -> whole series, 'Count' -> Rows, 'Time' -> Span."""
    if kind in (None, "None"):
        return None
    if kind == "Count":
        return Rows(int(amount))
    if kind == "Time":
        if unit is None:
            raise ValueError("a time window needs a unit")
        return Span(int(amount), unit)
    raise ValueError(f"unknown interval type {kind!r}")
