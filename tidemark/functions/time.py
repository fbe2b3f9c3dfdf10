"""Timestamp arithmetic on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def parse(x: Column, fmt: str | None = None) -> Column:
    """Timestamp without zone; unparseable input becomes null. ``fmt`` admits that format only."""
    if fmt is None:
        return x.try_cast("timestamp_ntz")
    return F.try_to_timestamp(x.cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def whole_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``, rounded down, also before the start. Missing if either side is."""
    return F.floor(micros_between(start, end) / F.lit(float(24 * MICROS_PER_HOUR))).cast("int")
