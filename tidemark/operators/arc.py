"""Expressions over a fixed-width vector of daily counts.

The arc has a fixed number of days, so the daily counts of a user are that many conditional counts
of one aggregate. Trend, peak and steepest drop are then plain arithmetic on them, with no second
grouping and no window. Days without activity are not observations. Counts are given by column name,
in day order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(columns: Sequence[str]) -> Column:
    return F.expr(" + ".join(columns))


def moments(counts: Sequence[str]) -> dict[str, Column]:
    """Sums behind the slope, by name, so that a plan computes each of them once."""
    seen = [f"CAST({c} > 0 AS BIGINT)" for c in counts]
    return {
        "arc_n": total(seen),
        "arc_x": total([f"{s} * {d}" for d, s in enumerate(seen)]),
        "arc_xx": total([f"{s} * {d * d}" for d, s in enumerate(seen)]),
        "arc_y": total(counts),
        "arc_xy": total([f"{c} * {d}" for d, c in enumerate(counts)]),
        "arc_active": F.expr(f"filter(array({', '.join(counts)}), c -> c > 0)"),
    }


def slope() -> Column:
    """Least-squares slope of count on day; 0 for a single active day, null without any.

    Like the two below, an expression over the columns of ``moments``.
    """
    n, x, xx, y, xy = [F.col(f"arc_{m}") for m in ("n", "x", "xx", "y", "xy")]
    fitted = (n * xy - x * y).cast("double") / (n * xx - x * x)
    return F.when(n > 1, fitted).when(n == 1, F.lit(0.0))


def peak_day(counts: Sequence[str]) -> Column:
    """Day with the most rows, the earliest on a tie; null without any."""
    first = F.array_position(F.array(*counts), F.array_max("arc_active"))
    return F.when(F.col("arc_n") > 0, (first - 1).cast("int"))


def steepest_drop() -> Column:
    """Smallest change between consecutive active days; 0 for a single one, null without any."""
    active, n = F.col("arc_active"), F.size("arc_active")
    pairs = F.greatest(n - 1, F.lit(0))
    changes = F.zip_with(
        F.slice(active, F.lit(2), pairs), F.slice(active, F.lit(1), pairs), lambda b, a: b - a
    )
    smallest = F.array_min(changes).cast("double")
    return F.when(n > 1, smallest).when(n == 1, F.lit(0.0))
