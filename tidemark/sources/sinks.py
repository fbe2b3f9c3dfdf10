"""CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write with a header, one file per partition, columns in the order of the frame."""
    df.write.mode(mode).option("header", True).csv(path)
