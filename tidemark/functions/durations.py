"""Durations such as 1h30m, -1.5h or 100ms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Nanoseconds; ValueError for anything else than signed parts of number and unit, or 0."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if rest == "0":
        return 0
    parts = _PART.findall(rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        raise ValueError(f"not a duration: {text!r}")
    return sign * round(sum(float(a) * _UNITS[b] for a, b in parts))


_COLUMN_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds_of(text: Column) -> Column:
    """The same durations as a column, in seconds; whole numbers are seconds. Null for anything else, and beyond 2^63 ns."""
    numbers, units = (F.regexp_extract_all(text, F.lit(_COLUMN_PART), F.lit(i)) for i in (1, 2))
    factors = F.create_map(*(F.lit(x) for pair in _SECONDS.items() for x in pair))
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * factors[u]), F.lit(0.0), lambda a, x: a + x)
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    found = F.when(text.rlike(r"^[+-]?0$"), F.lit(0.0)).when(text.rlike(r"^\d+$"), text.try_cast("double")).when(text.rlike(rf"^[+-]?({_COLUMN_PART})+$"), signed)
    return F.when(F.abs(found) <= (2**63 - 1) / 1e9, found)
