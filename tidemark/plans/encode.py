"""Target encodings, ordinal codes and the dense model matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import position_in_group
from tidemark.schemas import FOLDS, KEY, TARGET_ENCODED, TARGETS, categorical
from tidemark.session import materialize

_EVERY_ROW = "_every_row"
MISSING = -1.0
UNKNOWN = "unknown"


@dataclass(frozen=True)
class TargetStats:
    """Row and target counts per (column, value, fold), and the overall target means.

    With a second fold column the counts are per (column, value, fold, second).
    """

    table: DataFrame
    means: dict[str, float]
    columns: tuple[str, ...]
    targets: tuple[str, ...]

    def _attach(self, rows: DataFrame, lookup: DataFrame, on: Sequence[str], key: str) -> DataFrame:
        found = _spread(rows, lookup, self.columns, self.fields(), on, key)
        return self.with_means(rows.join(found, key, "left"))

    def fields(self) -> dict[str, tuple[str, Column]]:
        """Output name of every encoding, with its column and its field of the lookup."""
        return {f"te_{c}_{t}": (c, F.col(t)) for c in self.columns for t in self.targets}

    def with_means(self, rows: DataFrame) -> DataFrame:
        """Overall means where a category was missing or not seen."""
        means = {f"te_{c}_{t}": self.means[t] for c in self.columns for t in self.targets}
        return rows.withColumns({n: F.coalesce(n, F.lit(mean)) for n, mean in means.items()})

    def fold_means(self, fold: str) -> DataFrame:
        """Means over the other folds, per (column, value, fold).

        Counts of the other folds are the totals minus the row's own fold.
        """
        same = Window.partitionBy("column", "value")
        rest = F.sum("n").over(same) - F.col("n")

        def outside(target: str) -> Column:
            inside = F.col(target)
            return F.when(rest > 0, (F.sum(target).over(same) - inside) / rest).alias(target)

        return self.table.select(
            "column", "value", F.col("fold").alias(fold), *[outside(t) for t in self.targets]
        )

    def nested_means(self, fold: str, second: str) -> DataFrame:
        """Means over the rows outside both folds, per (column, value, fold, second).

        From the totals of a value go those of its fold and of its second fold, and what both share comes back. There are
        at most as many rows of a value as pairs of folds.
        """
        value = ["column", "value"]
        every, own, other = (Window.partitionBy(*value, *more) for more in ([], ["fold"], ["second"]))

        def outside(name: str) -> Column:
            return F.sum(name).over(every) - F.sum(name).over(own) - F.sum(name).over(other) + F.col(name)

        rest = outside("n")
        means = [F.when(rest > 0, outside(t) / rest).alias(t) for t in self.targets]
        return self.table.select(*value, F.col("fold").alias(fold), F.col("second").alias(second), *means)

    def nested(self, rows: DataFrame, fold: str, second: str, key: str = KEY) -> DataFrame:
        """Encode training rows by the mean outside both of their folds; a category that is missing or has no row there gets
        the mean of all rows outside both."""
        lookup = self.nested_means(fold, second)
        found = _spread(rows, lookup, self.columns, self.fields(), [fold, second], key)
        return self.with_nested_means(rows.join(found, key, "left"), fold, second)

    def with_nested_means(self, rows: DataFrame, fold: str, second: str) -> DataFrame:
        """The means of all rows outside both folds where a category was missing or not seen."""
        pairs = self.nested_means(fold, second).where(F.col("column") == _EVERY_ROW).collect()  # one row a pair of folds
        place = F.concat_ws("-", fold, second)
        out = {}
        for target in self.targets:
            known = [F.lit(x) for r in pairs for x in (f"{r[fold]}-{r[second]}", r[target])]
            mean = F.element_at(F.create_map(*known), place) if known else F.lit(None)
            out |= {f"te_{c}_{target}": F.coalesce(f"te_{c}_{target}", mean, F.lit(self.means[target])) for c in self.columns}
        return rows.withColumns(out)

    def full_means(self) -> DataFrame:
        """Means over all training rows, per (column, value)."""
        return self.table.groupBy("column", "value").agg(
            *[(F.sum(t) / F.sum("n")).alias(t) for t in self.targets]
        )

    def out_of_fold(self, rows: DataFrame, fold: str = "fold", key: str = KEY) -> DataFrame:
        """Encode training rows by the mean over the other folds.

        A category unseen there, or missing, gets the overall mean.
        """
        return self._attach(rows, self.fold_means(fold), [fold], key)

    def full(self, rows: DataFrame, key: str = KEY) -> DataFrame:
        """Encode other rows by the mean over all training rows."""
        return self._attach(rows, self.full_means(), [], key)


def _spread(
    rows: DataFrame,
    lookup: DataFrame,
    columns: Sequence[str],
    fields: Mapping[str, tuple[str, Column]],
    on: Sequence[str],
    key: str,
    fill: str | None = None,
) -> DataFrame:
    """Per key, the wanted lookup fields of all columns at once.

    Only narrow rows (key, column, value) meet the lookup, in one join whatever the number of columns, and
    are folded back into one row per key. A value shared by many rows is an ordinary skewed join. ``fill``
    is the value that stands for a missing one; ``given`` in a field tells the two apart.
    """
    text = [F.col(c).cast("string").alias(c) for c in columns]
    long = rows.select(key, *on, *text).unpivot([key, *on], list(columns), "column", "value")
    long = long.withColumn("given", F.col("value").isNotNull())
    long = long.na.fill(fill, ["value"]) if fill else long.where("given")
    found = long.join(lookup, ["column", "value", *on])
    return found.groupBy(key).agg(
        *[F.max(F.when(F.col("column") == c, field)).alias(name) for name, (c, field) in fields.items()]
    )


def target_stats(
    train: DataFrame,
    fold: str = "fold",
    columns: Sequence[str] = TARGET_ENCODED,
    targets: Sequence[str] = TARGETS,
    second: str | None = None,
) -> TargetStats:
    """Count all columns at once: one scan, one partially aggregated shuffle of narrow rows.

    ``second`` names another fold column for means that leave out both folds of a row.
    """
    folds = [F.col(fold).alias("fold")] + ([F.col(second).alias("second")] if second else [])
    by = ["fold", "second"][: len(folds)]
    wide = train.select(*folds, *targets, *columns, F.lit(_EVERY_ROW).alias(_EVERY_ROW))
    long = wide.unpivot([*by, *targets], [*columns, _EVERY_ROW], "column", "value")
    counted = (
        long.where(F.col("value").isNotNull())
        .groupBy("column", "value", *by)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in targets])
    )
    table = materialize(counted, "te-counts")
    overall = table.where(F.col("column") == _EVERY_ROW).agg(
        *[(F.sum(t) / F.sum("n")).alias(t) for t in targets]
    )
    return TargetStats(table, overall.first().asDict(), tuple(columns), tuple(targets))


def fill_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Make a missing category a category of its own."""
    columns = categorical() if columns is None else columns
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in columns})


def vocabulary(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Sorted position of every value of every column over all frames: column, value, code."""
    long = None
    for frame in frames:
        part = frame.select(*columns).unpivot([], list(columns), "column", "value")
        long = part if long is None else long.unionByName(part)
    ranked = position_in_group(long.distinct(), "column", "value", "code")
    return materialize(ranked, "vocabulary")


def ordinal_encode(df: DataFrame, codes: DataFrame, columns: Sequence[str], key: str = KEY) -> DataFrame:
    """Replace each category by its code."""
    fields = {f"code_{c}": (c, F.col("code")) for c in columns}
    coded = df.join(_spread(df, codes, columns, fields, [], key), key, "left")
    return coded.select(*[F.col(f"code_{c}").alias(c) if c in columns else c for c in df.columns])


def encode_all(
    rows: DataFrame,
    codes: DataFrame,
    stats: TargetStats,
    columns: Sequence[str],
    fold: str | None = None,
    key: str = KEY,
    second: str | None = None,
) -> DataFrame:
    """Target encodings beside the rows and codes in place of their categories, by one lookup.

    With ``fold`` the means are those of the other folds, with ``second`` those outside both. A missing category
    has the code of its own value, and the overall means.
    """
    on = [f for f in (fold, second) if f]
    means = stats.nested_means(fold, second) if second else stats.fold_means(fold) if fold else stats.full_means()
    every = codes
    for name in on:
        folds = F.sequence(F.lit(0), F.lit(FOLDS - 1))
        kind = rows.schema[name].dataType.simpleString()
        every = every.withColumn(name, F.explode(folds.cast(f"array<{kind}>")))
    lookup = materialize(every.join(means, ["column", "value", *on], "left"), "encodings")
    fields = {f"code_{c}": (c, F.col("code")) for c in columns}
    fields |= {n: (c, F.when(F.col("given"), field)) for n, (c, field) in stats.fields().items()}
    found = _spread(rows, lookup, columns, fields, on, key, UNKNOWN)
    coded = rows.join(found, key, "left")
    coded = stats.with_nested_means(coded, fold, second) if second else stats.with_means(coded)
    kept = [F.col(f"code_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns]
    return coded.select(*kept, *stats.fields())


def dense_matrix(df: DataFrame, features: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """All features as floats, missing as -1, next to the carried columns."""
    filled = df.na.fill(MISSING, [f for f in features])
    return filled.select(*carried, *[F.col(f).cast("float").alias(f) for f in features])
