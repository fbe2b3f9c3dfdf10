"""Null-aware column helpers.

Spark's ``least``/``greatest`` skip nulls, its sum over nothing is null, and a comparison with null is
null. Each helper states the rule it enforces instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to [lo, hi]; a missing value stays missing."""
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def is_true(condition: Column) -> Column:
    """A condition in which missing counts as false."""
    return F.coalesce(condition, F.lit(False))


def sum_or_zero(x: Column) -> Column:
    """Sum that is 0, not null, when every value is missing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def when_any(n: Column, value: Column) -> Column:
    """``value`` if at least one row qualified, else null."""
    return F.when(n > 0, value)


def per(numerator: Column, count: Column) -> Column:
    """Ratio to a non-null count, with the count floored at one."""
    return numerator / F.greatest(count, F.lit(1))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
