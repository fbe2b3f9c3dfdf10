"""Scores from confusion counts: one aggregate, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import CLASSES


def _cell(actual: int, predicted: int) -> str:
    return f"n_{actual}{predicted}"


def confusion_counts(
    df: DataFrame, y: str, predicted: str, by: Sequence[str] = (), classes: int = len(CLASSES)
) -> DataFrame:
    """Rows per (actual, predicted) pair as columns ``n_<actual><predicted>``."""
    hit = lambda a, p: (F.col(y) == a) & (F.col(predicted) == p)
    cells = [
        F.count_if(hit(a, p)).alias(_cell(a, p)) for a in range(classes) for p in range(classes)
    ]
    return df.groupBy(*by).agg(*cells)


class Confusion:
    """Expressions over the columns of ``confusion_counts``."""

    def __init__(self, classes: int = len(CLASSES)):
        self.classes = range(classes)

    def cell(self, a: int, p: int) -> Column:
        return F.col(_cell(a, p))

    def support(self, c: int) -> Column:
        return reduce(add, [self.cell(c, p) for p in self.classes])

    def predicted(self, c: int) -> Column:
        return reduce(add, [self.cell(a, c) for a in self.classes])

    def total(self) -> Column:
        return reduce(add, [self.support(c) for c in self.classes])

    @staticmethod
    def _share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def precision(self, c: int) -> Column:
        return self._share(self.cell(c, c), self.predicted(c))

    def recall(self, c: int) -> Column:
        return self._share(self.cell(c, c), self.support(c))

    def f1(self, c: int) -> Column:
        return self._share(self.cell(c, c) * 2, self.support(c) + self.predicted(c))

    def accuracy(self) -> Column:
        return self._share(reduce(add, [self.cell(c, c) for c in self.classes]), self.total())

    def macro(self, score) -> Column:
        return reduce(add, [score(c) for c in self.classes]) / len(self.classes)

    def weighted(self, score) -> Column:
        """Support-weighted mean of a per-class score."""
        weighed = reduce(add, [score(c) * self.support(c) for c in self.classes])
        return self._share(weighed, self.total())


def weighted_f1(df: DataFrame, y: str = "y", predicted: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    c = Confusion()
    return confusion_counts(df, y, predicted, by).select(*by, c.weighted(c.f1).alias("f1"))


def binary_f1(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """F1 of the positive class for ``score > threshold``, per group."""
    called = df.withColumn("_called", (F.col(score) > threshold).cast("int"))
    c = Confusion(2)
    return confusion_counts(called, y, "_called", by, classes=2).select(*by, c.f1(1).alias("f1"))


def classification_report(df: DataFrame, y: str = "y", predicted: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means."""
    c = Confusion()
    none = F.lit(None).cast("double")

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    rows = [
        row(name, c.precision(i), c.recall(i), c.f1(i), c.support(i))
        for i, name in enumerate(CLASSES)
    ]
    rows.append(row("accuracy", none, none, c.accuracy(), c.total()))
    for name, mean in (("macro avg", c.macro), ("weighted avg", c.weighted)):
        rows.append(row(name, mean(c.precision), mean(c.recall), mean(c.f1), c.total()))
    return confusion_counts(df, y, predicted).select(F.inline(F.array(*rows)))


def confusion_matrix(df: DataFrame, y: str = "y", predicted: str = "pred") -> DataFrame:
    """One row per actual class, one column per predicted class."""
    c = Confusion()
    columns = ("pred_not", "pred_vol", "pred_invol")
    rows = [
        F.struct(
            F.lit(name).alias("actual"),
            *[c.cell(i, p).alias(column) for p, column in enumerate(columns)],
        )
        for i, name in enumerate(CLASSES)
    ]
    return confusion_counts(df, y, predicted).select(F.inline(F.array(*rows)))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
