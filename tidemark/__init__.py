"""Churn features, encodings, scoring and evaluation as Spark DataFrame jobs."""

from tidemark.session import configure

__all__ = ["configure"]
__version__ = "0.1.0"
