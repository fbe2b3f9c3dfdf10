"""Cross-validated tree models on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import first_argmax
from tidemark.operators.ranks import fold_columns
from tidemark.plans import boosting
from tidemark.plans.encode import dense_matrix
from tidemark.plans.ensemble import MULTICLASS, with_second_stage
from tidemark.plans.metrics import binary_f1, weighted_f1
from tidemark.schemas import CLASSES, FOLDS, KEY, MODEL_FEATURES
from tidemark.session import scratch_path
from tidemark.sources.models import fit_mark, load_members, save_fold, saved_fold

# Seeds, and the tree settings Spark ML can express.
ENCODING_SEED = 0
MODEL_SEED = 42
SUBSAMPLE = 0.8
FEATURE_SHARE = "0.75"
MIN_ROWS = 15

FOLD_COLUMNS = ("fold_te", "fold_s1", "fold_mc", "fold_s2")


@dataclass(frozen=True)
class Settings:
    """Tree sizes and rounds; fewer rounds at a larger step stand in for many small ones.

    ``three_class`` is "boosted" (one model per class against the rest) or "forest". Boosted models keep the rounds up to the
    best one on the rows of their held-out fold, found with so much ``patience``; without patience they keep
    all. ``encoding`` says which folds a row's target encoding leaves out: those of its "own", the ones "shared"
    with the three-class model, or both ("nested").
    """

    rounds: int = 60
    step: float = 0.1
    patience: int | None = 10
    encoding: str = "own"
    stage1_depth: int = 8
    stage2_depth: int = 7
    three_class: str = "boosted"
    multiclass_depth: int = 7
    trees: int = 100
    subsample: float = SUBSAMPLE
    feature_share: str = FEATURE_SHARE
    forest_share: str = "sqrt"
    bootstrap: bool = True
    parallelism: int = 2
    # Treat category codes as categories; ``bins`` then grows to the largest of them.
    declare_categories: bool = False
    bins: int = 128


@dataclass(frozen=True)
class Fitted:
    """The model of a fold, or one model per class against the rest.

    ``curves`` hold the loss on the held-out rows after each round, ``path`` the folder if it is saved.
    """

    members: tuple
    curves: tuple = ()
    path: str | None = None

    def score(self, rows: DataFrame, outputs: Sequence[tuple[str, int]], prefix: str = "") -> DataFrame:
        """``rows`` with the wanted class probabilities; those of several members are scaled to sum to one."""
        columns = rows.columns
        for i, member in enumerate(self.members):
            member = member.copy()
            member.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
            rows = member.transform(rows).withColumn(f"_p{i}", vector_to_array("_p")).drop("_p", "_r", "_c")
        if len(self.members) == 1:
            values = {name: F.col("_p0")[c] for name, c in outputs}
        else:
            every = [F.col(f"_p{i}")[1] for i in range(len(self.members))]
            total = reduce(lambda a, b: a + b, every)
            values = {name: every[c] / total for name, c in outputs}
        return rows.select(*columns, *[value.alias(f"{prefix}{name}") for name, value in values.items()])

    def importances(self):
        return sum(m.featureImportances.toArray() for m in self.members) / len(self.members)


@dataclass(frozen=True)
class Scores:
    """Out-of-fold scores, fold-averaged scores of other rows, and mean importances."""

    oof: DataFrame
    test: DataFrame
    models: list[Fitted]
    features: tuple[str, ...]

    def curves(self) -> DataFrame:
        """Held-out loss by fold, member and round."""
        return boosting.curve_table(self.test.sparkSession, [m.curves for m in self.models])

    def rounds(self) -> DataFrame:
        """``fold``, ``member``, and the ``rounds`` that the model keeps."""
        rows = [(k, i, m.getNumTrees) for k, model in enumerate(self.models) for i, m in enumerate(model.members)]
        return self.test.sparkSession.createDataFrame(rows, "fold int, member int, rounds int")

    def nodes(self) -> DataFrame:
        """All nodes of all trees, read from the saved models; models without a folder are saved to scratch."""
        spark, folders = self.test.sparkSession, []
        for k, model in enumerate(self.models):
            path = model.path
            if path is None:
                path = save_fold(spark, scratch_path(spark, "models"), k, model.members, model.curves)["path"]
            folders.append((k, path, len(model.members)))
        return boosting.node_table(spark, folders)

    def split_importances(self) -> DataFrame:
        """Features by the number of splits on them, with their gain; a model of several members counts as one."""
        return boosting.split_importances(self.nodes(), self.features, len(self.models))


def class_weights(
    df: DataFrame, label: str, scheme: str | None, fold: str | None = None, folds: int = FOLDS
) -> DataFrame:
    """Rows and weight per class; with ``fold``, per fold over the rows of all other folds.

    ``balanced`` is n / (classes x rows of the class). ``unbalanced`` lifts the rarer classes to the
    size of the largest one. Without a scheme all weights are 1.
    """
    if fold is None:
        counts, group = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), Window.partitionBy(F.lit(0))
    else:
        inside = [F.count_if(F.col(fold) == k).alias(f"_{k}") for k in range(folds)]
        totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *inside)
        outside = [
            F.struct(F.lit(k).alias(fold), (F.col("_n") - F.col(f"_{k}")).alias("n")) for k in range(folds)
        ]
        counts = totals.select(F.inline(F.array(*outside)), label).where("n > 0").select(fold, label, "n")
        group = Window.partitionBy(fold)
    n = F.col("n")
    weights = {
        "balanced": F.sum("n").over(group) / (F.count(F.lit(1)).over(group) * n),
        "unbalanced": F.max("n").over(group) / n,
        None: F.lit(1.0),
    }
    if scheme not in weights:
        raise ValueError(f"unknown scheme {scheme!r}")
    return counts.withColumn("weight", weights[scheme])


def boosted_trees(settings: Settings, depth: int) -> GBTClassifier:
    """Binary model of all rounds; which of them are kept is decided on held-out rows."""
    return GBTClassifier(
        featuresCol="features",
        maxIter=settings.rounds,
        stepSize=settings.step,
        maxDepth=depth,
        minInstancesPerNode=MIN_ROWS,
        maxBins=settings.bins,
        subsamplingRate=settings.subsample,
        featureSubsetStrategy=settings.feature_share,
        seed=MODEL_SEED,
    )


def forest(settings: Settings) -> RandomForestClassifier:
    """Three-class model in one."""
    return RandomForestClassifier(
        featuresCol="features",
        numTrees=settings.trees,
        maxDepth=settings.multiclass_depth,
        minInstancesPerNode=MIN_ROWS,
        maxBins=settings.bins,
        subsamplingRate=settings.subsample,
        featureSubsetStrategy=settings.forest_share,
        bootstrap=settings.bootstrap,
        seed=MODEL_SEED,
    )


def category_sizes(frames: Sequence[DataFrame], columns: Sequence[str]) -> dict[str, int]:
    """Number of codes per encoded column over all frames."""
    both = reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])
    return both.agg(*[(F.max(c) + 1).alias(c) for c in columns]).first().asDict()


def model_frame(
    encoded: DataFrame,
    carried: Sequence[str],
    features: Sequence[str] = MODEL_FEATURES,
    key: str = KEY,
    sizes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Dense matrix assembled into one vector column, hash-partitioned and sorted by key.

    The layout makes row sampling inside the tree learners repeatable on the same cluster. ``sizes`` declares columns
    as categories with that many codes.
    """
    dense = dense_matrix(encoded, features, [key, *carried])
    for column, n in (sizes or {}).items():
        # The assembler heeds attributes of double columns only.
        nominal = {"ml_attr": {"type": "nominal", "num_vals": n}}
        dense = dense.withColumn(column, F.col(column).cast("double")).withMetadata(column, nominal)
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(dense)
    return assembled.select(key, *carried, "features").repartition(key).sortWithinPartitions(key)


def fold_table(labelled: DataFrame, key: str = KEY) -> DataFrame:
    """Folds of the encodings, both stages and the three-class model: one narrow row per user.

    Ranking only the key and its labels keeps the wide feature rows out of every sort. Users who did
    not churn have no stage-2 fold.
    """
    churned = F.when(F.col("is_churned") == 1, F.col("is_invol"))
    strata = {
        "fold_te": (F.col("y"), ENCODING_SEED),
        "fold_s1": (F.col("is_churned"), MODEL_SEED),
        "fold_mc": (F.col("y"), MODEL_SEED),
        "fold_s2": (churned, MODEL_SEED),
    }
    return fold_columns(labelled, key, strata, FOLDS)


def _weighted(train: DataFrame, label: str, fold: str, scheme: str | None) -> Callable[[int], DataFrame]:
    """Training frame of a fold with the class weights of its training rows."""
    # folds x classes rows
    known = class_weights(train, label, scheme, fold).collect()

    def frame(k: int) -> DataFrame:
        weight: Column = F.lit(1.0)
        for r in known:
            if r[fold] == k:
                weight = F.when(F.col(label) == r[label], F.lit(r["weight"])).otherwise(weight)
        return train.withColumn("weight", weight)

    return frame


def cross_validate(
    estimator: Estimator,
    train: DataFrame,
    test: DataFrame,
    label: str,
    fold: str,
    outputs: Sequence[tuple[str, int]],
    scheme: str | None = None,
    patience: int | None = None,
    against_rest: int = 0,
    features: Sequence[str] = MODEL_FEATURES,
    key: str = KEY,
    parallelism: int = 2,
    store: str | None = None,
) -> Scores:
    """Fit one model per fold, score its held-out rows, and average all models on ``test``.

    ``outputs`` names the (column, class) probabilities to keep. ``against_rest`` fits a binary model for
    each of that many classes. With ``patience`` a boosted model is cut to its best round on the held-out
    rows. Fits are independent jobs submitted from a few driver threads. Each of them passes over its rows several times
    before it holds them in bins, so labels, folds and vectors are cached while models are fitted; what does not fit in
    memory goes to local disks. Averaging chains the models over the test rows, which needs no shuffle.

    Folds are saved below ``store`` as they are done, and a second run over the same rows and settings reads them there.
    """
    spark: SparkSession = train.sparkSession
    learned = train.select(label, fold, "features").persist()
    frame = _weighted(learned, label, fold, scheme)
    if store is not None:
        options = {"label": label, "fold": fold, "scheme": scheme, "rest": against_rest, "patience": patience, "features": [*features]}
        store = f"{store}/{fit_mark(train, [key, label, fold], 'features', estimator, options)}"

    def one(rows: DataFrame, label: str, k: int) -> tuple:
        model = estimator.copy({estimator.labelCol: label, estimator.weightCol: "weight"}).fit(rows.where(F.col(fold) != k))
        if patience is None:
            return model, ()
        # Held-out rows count once each: weights are for learning.
        held = rows.where(F.col(fold) == k).select(F.col(label).cast("double").alias(label), "features", F.lit(1.0).alias("weight"))
        losses = tuple(model.evaluateEachIteration(held))
        best = boosting.best_rounds(boosting.curve_table(spark, [[losses]]), patience).first()["rounds"]
        return boosting.truncated(spark, model, best), losses

    def fit(k: int) -> Fitted:
        if store is not None and (note := saved_fold(spark, store, k)):
            return Fitted(load_members(note), tuple(map(tuple, note["curves"])), note["path"])
        rows = frame(k)
        if against_rest:
            each = [(rows.withColumn("_is", (F.col(label) == c).cast("double")), "_is") for c in range(against_rest)]
        else:
            each = [(rows, label)]
        members, curves = zip(*[one(own, name, k) for own, name in each])
        if store is None:
            return Fitted(members, curves)
        note = save_fold(spark, store, k, members, curves)
        return Fitted(members, curves, note["path"])

    try:
        with ThreadPool(parallelism) as pool:
            models = pool.map(inheritable_thread_target(spark)(fit), range(FOLDS))
    finally:
        learned.unpersist()

    wanted = [name for name, _ in outputs]
    held_out = [
        models[k]
        .score(train.where(F.col(fold) == k).select(key, "features"), outputs)
        .select(key, F.lit(k).alias("fold"), *wanted)
        for k in range(FOLDS)
    ]
    oof = reduce(DataFrame.unionByName, held_out)
    return Scores(oof, mean_scores(models, test, outputs, key), models, tuple(features))


def mean_scores(
    models: Sequence[Fitted], rows: DataFrame, outputs: Sequence[tuple[str, int]], key: str = KEY
) -> DataFrame:
    """Mean class probabilities of several models on the same rows."""
    rows = rows.select(key, "features")
    for k, model in enumerate(models):
        rows = model.score(rows, outputs, f"_{k}_")

    def mean(name: str) -> Column:
        total = reduce(lambda a, b: a + b, [F.col(f"_{k}_{name}") for k in range(len(models))])
        return total / len(models)

    return rows.select(key, *[mean(name).alias(name) for name, _ in outputs])


def stage1(train: DataFrame, test: DataFrame, settings: Settings = Settings(), **options) -> Scores:
    """Churn or not, over all users."""
    return cross_validate(
        boosted_trees(settings, settings.stage1_depth),
        train,
        test,
        "is_churned",
        "fold_s1",
        [("s1", 1)],
        scheme="unbalanced",
        patience=settings.patience,
        parallelism=settings.parallelism,
        **options,
    )


def stage2(train: DataFrame, test: DataFrame, settings: Settings = Settings(), **options) -> Scores:
    """Payment failure or choice, over churned users, with their own folds."""
    churned = train.where(F.col("is_churned") == 1)
    return cross_validate(
        boosted_trees(settings, settings.stage2_depth),
        churned,
        test,
        "is_invol",
        "fold_s2",
        [("s2", 1)],
        patience=settings.patience,
        parallelism=settings.parallelism,
        **options,
    )


def multiclass(train: DataFrame, test: DataFrame, settings: Settings = Settings(), **options) -> Scores:
    """All three classes at once, with balanced class weights."""
    if settings.three_class not in ("boosted", "forest"):
        raise ValueError(f"three_class must be 'boosted' or 'forest', not {settings.three_class!r}")
    boosted = settings.three_class == "boosted"
    return cross_validate(
        boosted_trees(settings, settings.multiclass_depth) if boosted else forest(settings),
        train,
        test,
        "y",
        "fold_mc",
        [(f"m{c}", c) for c in range(len(CLASSES))],
        scheme="balanced",
        patience=settings.patience if boosted else None,
        against_rest=len(CLASSES) if boosted else 0,
        parallelism=settings.parallelism,
        **options,
    )


def fold_report(train: DataFrame, s1: Scores, s2: Scores, mc: Scores, key: str = KEY) -> DataFrame:
    """F1 per model and fold: binary for the two stages, weighted for the three-class model."""
    truth = train.select(key, "y", "is_churned", "is_invol")
    called = mc.oof.join(truth, key).withColumn("pred", first_argmax([F.col(m) for m in MULTICLASS]))
    parts = {
        "stage1": binary_f1(s1.oof.join(truth, key), "is_churned", "s1", by=["fold"]),
        "stage2": binary_f1(s2.oof.join(truth, key), "is_invol", "s2", by=["fold"]),
        "multiclass": weighted_f1(called, by=["fold"]),
    }
    named = [df.select(F.lit(model).alias("model"), "fold", "f1") for model, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def importances(scores: Scores) -> DataFrame:
    """Mean importance per feature by gain, largest first; one row per feature, whatever the data size.

    ``Scores.split_importances`` ranks by the number of splits instead.
    """
    spark = scores.test.sparkSession
    per_model = [m.importances() for m in scores.models]
    mean = sum(per_model) / len(per_model)
    rows = [(name, float(value)) for name, value in zip(scores.features, mean)]
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]
    )
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def top_features(ranked: DataFrame, n: int = 20) -> DataFrame:
    return ranked.orderBy(F.desc("importance"), "feature").limit(n)


def oof_scores(
    train: DataFrame, s1: Scores, s2: Scores, mc: Scores, parity: bool = False, key: str = KEY
) -> DataFrame:
    """All out-of-fold scores by user, with ``y`` and the stage-1 fold.

    Stage 2 has no held-out score for users who did not churn. They get the mean of its models, none
    of which has seen them. ``parity`` writes 0.5 instead, which leaks the label into the sweeps.
    """
    if parity:
        second = s2.oof.select(key, "s2")
    else:
        stayed = train.where(F.col("is_churned") == 0)
        second = s2.oof.select(key, "s2").unionByName(mean_scores(s2.models, stayed, [("s2", 1)], key))
    rows = (
        train.select(key, "y", F.col("fold_s1").alias("fold"))
        .join(s1.oof.select(key, "s1"), key)
        .join(mc.oof.select(key, *MULTICLASS), key)
    )
    return with_second_stage(rows, second, key)


def test_scores(s1: Scores, s2: Scores, mc: Scores, key: str = KEY) -> DataFrame:
    return s1.test.join(s2.test, key).join(mc.test, key)
