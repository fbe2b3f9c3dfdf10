"""Rounding and probability vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(x: Column) -> Column:
    """Round to two places: scale, round half to even, scale back; negative zero becomes zero."""
    cents = F.rint(x * 100) / 100
    return F.when(cents == 0, F.lit(0.0)).otherwise(cents)


def first_argmax(scores: Sequence[Column]) -> Column:
    """Zero-based position of the largest score; the first one wins a tie."""
    scores = list(scores)
    out = F.lit(len(scores) - 1)
    for i in reversed(range(len(scores) - 1)):
        ahead = F.lit(True)
        for later in scores[i + 1 :]:
            ahead = ahead & (scores[i] >= later)
        out = F.when(ahead, F.lit(i)).otherwise(out)
    return out


def normalised(scores: Sequence[Column]) -> list[Column]:
    """Scale scores to sum 1."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return [s / total for s in scores]
