"""Text tests and category maps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.nulls import is_true

# Spellings of true, compared after trimming and lower-casing.
TRUE_WORDS = ("true", "1", "1.0")


def starts_with(x: Column, prefix: str) -> Column:
    return is_true(x.startswith(prefix))


def mentions(x: Column, word: str) -> Column:
    """Case-insensitive containment."""
    return is_true(F.contains(F.lower(x), F.lit(word.lower())))


def one_of(x: Column, values: Iterable[str]) -> Column:
    return is_true(x.isin(*values))


def flag(x: Column) -> Column:
    """Boolean or text spelled like one -> 0/1, anything else -> 0."""
    return one_of(F.lower(F.trim(x.cast("string"))), TRUE_WORDS).cast("int")


def lookup(x: Column, mapping: Mapping[str, int], default: int) -> Column:
    """Literal map with a default for unknown and missing keys."""
    out: Column | None = None
    for key, value in mapping.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
