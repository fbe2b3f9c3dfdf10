"""Rounds of boosted models chosen on held-out rows, and their trees as a table of nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def best_rounds(curves: DataFrame, patience: int, by: Sequence[str] = ("fold", "member")) -> DataFrame:
    """``rounds`` per curve: the round of the smallest ``loss`` before ``patience`` rounds in a row brought none smaller.

    ``curves`` has a row per curve and ``round``, from 1. Of equal losses the earliest counts. A loss that is missing or no
    number is none; a curve of such only has null.
    """
    loss = F.when(~F.isnan("loss"), F.col("loss"))
    earlier = Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.min("loss").over(earlier)
    better = F.col("loss").isNotNull() & (least.isNull() | (F.col("loss") < least))
    marked = curves.withColumn("loss", loss).withColumn("better", better)
    marked = marked.withColumn("best", F.max(F.when(F.col("better"), F.col("round"))).over(so_far))
    stopped = F.when(F.col("round") - F.col("best") >= patience, F.struct("round", "best"))
    ends = marked.groupBy(*by).agg(F.min(stopped).alias("stop"), F.max(F.struct("round", "best")).alias("end"))
    return ends.select(*by, F.coalesce("stop.best", "end.best").alias("rounds"))


def curve_table(spark: SparkSession, curves: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """``fold``, ``member``, ``round`` and ``loss`` of the curves of all folds; a row per round of each model.

    The losses are literals of the plan: as Python rows they would start Python workers in every core.
    """
    named = [
        F.struct(
            F.lit(fold).alias("fold"),
            F.lit(member).alias("member"),
            F.array(*[F.lit(float(loss)) for loss in curve]).cast("array<double>").alias("losses"),
        )
        for fold, members in enumerate(curves)
        for member, curve in enumerate(members)
    ]
    every = F.array(*named).cast("array<struct<fold:int,member:int,losses:array<double>>>")
    lines = spark.range(1, numPartitions=1).select(F.inline(every))
    rounds = lines.select("fold", "member", F.posexplode("losses").alias("round", "loss"))
    return rounds.withColumn("round", F.col("round") + 1)


def truncated(spark: SparkSession, model: GBTClassificationModel, rounds: int | None) -> GBTClassificationModel:
    """The model of the first rounds; of all without a number.

    The session is handed over: threads that fit models have no active one.
    """
    if rounds is None or rounds >= model.getNumTrees:
        return model
    context, java = spark.sparkContext, model._java_obj
    jvm, gateway = context._jvm, context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    every = java.trees()
    for k in range(rounds):
        trees[k], weights[k] = every[k], float(model.treeWeights[k])
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), java.numClasses()
    )
    return GBTClassificationModel(java.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap.empty()))


def node_table(spark: SparkSession, folders: Sequence[tuple[int, str, int]]) -> DataFrame:
    """Every node of saved models: ``fold``, ``member``, ``tree``, ``node``, ``is_split``, ``feature`` (its position), ``gain`` and ``rows``.

    ``folders`` are fold, folder and number of members. Leaves have no feature and no gain.
    """
    parts = []
    for fold, folder, members in folders:
        for member in range(members):
            nodes = spark.read.parquet(f"{folder}/member={member}/data").select("treeID", "nodeData.*")
            is_split = F.col("leftChild") >= 0
            parts.append(
                nodes.select(
                    F.lit(fold).alias("fold"),
                    F.lit(member).alias("member"),
                    F.col("treeID").alias("tree"),
                    F.col("id").alias("node"),
                    is_split.alias("is_split"),
                    F.when(is_split, F.col("split.featureIndex")).alias("feature"),
                    F.when(is_split, F.col("gain")).alias("gain"),
                    F.col("rawCount").alias("rows"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def split_importances(nodes: DataFrame, features: Sequence[str], models: int) -> DataFrame:
    """Per feature ``importance``, its splits in the average of so many models, and of all models ``splits``, their
    ``rows`` and ``gain`` (weighted by them); most splits first.

    Features without a split have zeros.
    """
    spark = nodes.sparkSession
    named = spark.createDataFrame(list(enumerate(features)), "at int, feature string")
    counted = nodes.where("is_split").groupBy(F.col("feature").alias("at")).agg(
        F.count(F.lit(1)).alias("splits"), F.sum("rows").alias("rows"), F.sum(F.col("gain") * F.col("rows")).alias("gain")
    )
    found = named.join(counted, "at", "left").na.fill(0, ["splits", "rows", "gain"])
    ranked = found.select("feature", (F.col("splits") / models).alias("importance"), "splits", "rows", "gain")
    return ranked.orderBy(F.desc("importance"), "feature")
