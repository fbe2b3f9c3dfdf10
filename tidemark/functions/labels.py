"""Class names, codes and derived targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import CLASSES, LABEL
from tidemark.functions.text import lookup


def encode(label: Column) -> Column:
    """Class name -> 0/1/2; unknown names stay null."""
    codes = {name: i for i, name in enumerate(CLASSES)}
    return F.when(label.isin(*CLASSES), lookup(label, codes, 0))


def decode(code: Column) -> Column:
    """0/1/2 -> class name; other codes become null."""
    return F.coalesce(*[F.when(code == i, F.lit(name)) for i, name in enumerate(CLASSES)])


def with_targets(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add the class code ``y`` and the three binary targets."""
    y = encode(F.col(label))
    return df.withColumns(
        {
            "y": y,
            "is_churned": (y > 0).cast("int"),
            "is_vol": (y == 1).cast("int"),
            "is_invol": (y == 2).cast("int"),
        }
    )
