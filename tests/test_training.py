"""Models on a planted signal, and the whole run from CSV to CSV."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.labels import with_targets
from tidemark.operators.ranks import fold_columns
from tidemark.plans import boosting, metrics, pipeline, training
from tidemark.functions.numeric import first_argmax
from tidemark import session
from tidemark.schemas import BASE_FEATURES, CLASSES, MODEL_FEATURES, TARGETS
from tidemark.session import materialize

FAST = training.Settings(rounds=4, stage1_depth=3, stage2_depth=3, multiclass_depth=3, parallelism=4)
FOREST = training.Settings(three_class="forest", trees=8, multiclass_depth=4, parallelism=4)
FEATURES = ("a", "b", "noise")


def planted(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choices(range(3), [5, 3, 2])[0]
        a, b = (y > 0) + rng.gauss(0, 0.3), (y == 2) + rng.gauss(0, 0.3)
        rows.append((f"{seed}-{i}", CLASSES[y], a, b, rng.random()))
    return spark.createDataFrame(rows, "user_id string, churn_status string, a double, b double, noise double")


@pytest.fixture(scope="module")
def frames(spark):
    train = pipeline.with_folds(planted(spark, 500, 1))
    carried = ["y", *TARGETS, *training.FOLD_COLUMNS]
    fit_on = materialize(training.model_frame(train, carried, FEATURES), "fit")
    predict_on = materialize(training.model_frame(planted(spark, 80, 2), [], FEATURES), "predict")
    return fit_on, predict_on


@pytest.fixture(scope="module")
def models(frames):
    options = {"features": FEATURES}
    return (
        training.stage1(*frames, FAST, **options),
        training.stage2(*frames, FAST, **options),
        training.multiclass(*frames, FAST, **options),
    )


def test_every_row_is_scored_once(frames, models):
    fit_on, predict_on = frames
    churned = fit_on.where("is_churned = 1")
    for scores, rows in zip(models, (fit_on, churned, fit_on)):
        assert scores.oof.select("user_id").exceptAll(rows.select("user_id")).isEmpty()
        assert scores.oof.count() == rows.count()
        assert scores.test.count() == predict_on.count() == scores.test.select("user_id").distinct().count()
        assert len(scores.models) == 5


def test_signal_is_found(spark, frames, models):
    s1, s2, mc = models
    truth = frames[0].select("user_id", "y", "is_churned", "is_invol")
    f1 = lambda s, y, c: metrics.binary_f1(s.oof.join(truth, "user_id"), y, c).first()["f1"]
    assert f1(s1, "is_churned", "s1") > 0.85 and f1(s2, "is_invol", "s2") > 0.85
    called = mc.oof.join(truth, "user_id").withColumn("pred", first_argmax([F.col(f"m{i}") for i in range(3)]))
    majority = truth.withColumn("pred", F.lit(0))
    assert metrics.weighted_f1(called).first()["f1"] > metrics.weighted_f1(majority).first()["f1"] + 0.3


def test_probabilities(models):
    *binary, mc = models
    worst = mc.test.agg(F.max(F.abs(F.col("m0") + F.col("m1") + F.col("m2") - 1))).first()[0]
    assert worst < 1e-9
    for scores, column in zip(binary, ("s1", "s2")):
        low, high = scores.oof.agg(F.min(column), F.max(column)).first()
        assert 0 <= low < high <= 1


def test_forest_in_place_of_boosting(frames):
    mc = training.multiclass(*frames, FOREST, features=FEATURES)
    worst = mc.oof.agg(F.max(F.abs(F.col("m0") + F.col("m1") + F.col("m2") - 1))).first()[0]
    assert worst < 1e-9 and mc.oof.count() == frames[0].count() and len(mc.models) == 5
    with pytest.raises(ValueError, match="three_class"):
        training.multiclass(*frames, training.Settings(three_class="x"), features=FEATURES)


def test_weights_of_other_folds(spark):
    rows = [(k, k % 5, int(k % 7 == 0)) for k in range(70)] + [(99, 0, 2)]
    df = spark.createDataFrame(rows, "user_id int, fold int, y int")
    found = {(r.fold, r.y): (r.n, r.weight) for r in training.class_weights(df, "y", "balanced", "fold").collect()}
    assert (0, 2) not in found and found[(1, 2)] == (1, pytest.approx(57 / 3))
    assert found[(0, 1)] == (8, pytest.approx(56 / 16)) and found[(0, 0)][0] == 48
    assert {r.weight for r in training.class_weights(df, "y", None).collect()} == {1.0}
    with pytest.raises(ValueError, match="scheme"):
        training.class_weights(df, "y", "odd")


def test_many_declared_categories(spark):
    """More codes than bins: the bins grow to the largest category."""
    rows = [(f"u{i}", CLASSES[i % 3], f"c{i % 40}", 1.0 * (i % 3)) for i in range(400)]
    names = [f.name for f in BASE_FEATURES if f.missing == "unknown"]
    df = spark.createDataFrame(rows, "user_id string, churn_status string, c string, gen_total double")
    others = [f for f in MODEL_FEATURES if not f.startswith("te_") and f not in (*names, "gen_total")]
    df = df.withColumns({n: F.col("c") for n in names} | {n: F.lit(0.0) for n in others}).drop("c")
    settings = training.Settings(
        rounds=1, stage1_depth=1, stage2_depth=1, multiclass_depth=1, parallelism=4, bins=8, declare_categories=True
    )
    outcome = pipeline.fit_and_report(df, df.drop("churn_status"), settings)
    assert outcome.submission.count() == 400


def test_importances_rank_the_signal(models):
    ranked = training.importances(models[2])
    assert [r.feature for r in ranked.collect()][-1] == "noise"
    assert training.top_features(ranked, 2).count() == 2
    assert ranked.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_second_stage_does_not_reveal_the_label(frames, models):
    honest = training.oof_scores(frames[0], *models)
    stayed = honest.where("y = 0").agg(F.countDistinct("s2")).first()[0]
    assert stayed > 10
    parity = training.oof_scores(frames[0], *models, parity=True)
    assert [r.s2 for r in parity.where("y = 0").select("s2").distinct().collect()] == [0.5]
    assert honest.count() == parity.count() == frames[0].count()


def test_fits_repeat(frames, models):
    again = training.stage2(*frames, FAST, features=FEATURES)
    diff = again.oof.withColumnRenamed("s2", "again").join(models[1].oof, "user_id")
    assert diff.agg(F.max(F.abs(F.col("s2") - F.col("again")))).first()[0] == 0.0


def test_fold_columns(spark):
    labelled = with_targets(planted(spark, 300, 5))
    folds = training.fold_table(labelled).join(labelled.select("user_id", "is_churned"), "user_id")
    assert folds.where("(fold_s2 IS NULL) <> (is_churned = 0)").isEmpty()
    assert folds.where("fold_te = fold_mc").count() < 300


def test_fold_report(frames, models):
    rows = training.fold_report(frames[0], *models).collect()
    assert len(rows) == 15 and all(0 < r.f1 <= 1 for r in rows)
    assert {(r.model, r.fold) for r in rows} == {
        (m, k) for m in ("stage1", "stage2", "multiclass") for k in range(5)
    }


def test_declared_categories_reach_the_trees(spark):
    """A code that is no order, only a set: one split suffices if it is known to be a category."""
    rows = [(f"u{i}", 1.0 * (i % 6 in (0, 2, 4)), float(i % 6)) for i in range(240)]
    df = spark.createDataFrame(rows, "user_id string, y double, c double")
    assert training.category_sizes([df], ["c"]) == {"c": 6}

    def depth_one_error(sizes):
        vectors = training.model_frame(df, ["y"], ["c"], sizes=sizes).withColumn("weight", F.lit(1.0))
        from pyspark.ml.classification import DecisionTreeClassifier

        model = DecisionTreeClassifier(labelCol="y", maxDepth=1).fit(vectors)
        return model.transform(vectors).where("prediction <> y").count()

    assert depth_one_error({"c": 6}) == 0 < depth_one_error(None)


def test_rows_are_cached_while_models_are_fitted(spark, frames, models, monkeypatch):
    """Every fit reads labels, folds and vectors from the cache, which is empty again after it, also if a fit fails."""
    cached, fit = [], training.GBTClassifier.fit
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()

    def record(self, rows):
        cached.append("InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString())
        return fit(self, rows)

    before = held()
    monkeypatch.setattr(training.GBTClassifier, "fit", record)
    again = training.stage1(*frames, FAST, features=FEATURES)
    assert cached == [True] * 5 and held() <= before
    assert [m.importances().tolist() for m in again.models] == [m.importances().tolist() for m in models[0].models]

    def fail(self, rows):
        raise RuntimeError("no fit")

    monkeypatch.setattr(training.GBTClassifier, "fit", fail)
    with pytest.raises(RuntimeError, match="no fit"):
        training.stage1(*frames, FAST, features=FEATURES)
    assert held() <= before


def test_csv_to_csv(spark, tmp_path):
    """Both splits written as raw CSV, the full run, and the three outputs."""
    from catalogue import fixtures, queries

    tables = fixtures.tables(spark, "/root/testdata/sf0.001")
    root, store, out = (str(tmp_path / d) for d in ("raw", "store", "out"))
    queries._write_splits(tables, root, ("train", "test"))
    tiny = training.Settings(rounds=2, stage1_depth=2, stage2_depth=2, multiclass_depth=2, parallelism=4)
    shared = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    outcome = pipeline.run(spark, root, store, out, tiny, scan={"mode": "FAILFAST"})
    assert set(os.listdir(shared)) == before  # no scratch is left
    read = lambda name: spark.read.option("header", True).csv(f"{out}/{name}")
    importances = read("feature_importance")
    assert importances.columns == ["feature", "importance"]
    assert {r.feature for r in importances.collect()} == set(MODEL_FEATURES)
    testers = {str(r.user_id) for r in tables["users"].where("split = 'test'").collect()}
    submission, proba = read("submission"), read("predictions_proba")
    assert submission.columns == ["user_id", "churn_status"]
    assert {r.user_id for r in submission.collect()} == testers
    assert proba.count() == len(testers) and {r.churn_status for r in proba.collect()} <= set(CLASSES)
    assert 0 < outcome.nested_f1 <= 1 and 0 < outcome.f1 <= 1
    assert outcome.fold_f1.count() == 15 and outcome.classes.count() == 3
    assert sorted(os.listdir(f"{store}/features")) and outcome.report.count() == 6
    assert sum(r.n for r in outcome.predicted.collect()) == outcome.reasons.count() == len(testers)
    assert all(0 <= r.probability <= 1 and r.action for r in outcome.reasons.collect())
    assert 0 < outcome.multiclass_f1 <= 1 and outcome.tuning.scale_f1 >= outcome.tuning.alpha_f1
    assert outcome.tuning.alpha_f1 >= outcome.tuning.threshold_f1 > 0
    assert outcome.submission.count() == len(testers) and outcome.importances.count() == 130
    assert sum(r.support for r in outcome.report.collect() if r.name in CLASSES) == tables["users"].where(
        "split = 'train'"
    ).count()


def test_fold_ranks_are_not_broadcast(spark, tmp_path):
    """Of the two sides of their join the offsets are broadcast, not the rows, although these look small in their file."""
    path = str(tmp_path / "labels")
    spark.range(20_000).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("y")).write.parquet(path)
    rows = spark.read.parquet(path)
    folds = fold_columns(rows, "user_id", {"fold_a": (F.col("y"), 0), "fold_b": (F.col("y"), 42)})
    joins = [x for x in folds._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1 and "BuildRight" in joins[0]
    counts = folds.join(rows, "user_id").groupBy("y", "fold_a").count().collect()
    assert len(counts) == 15 and max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 2


def test_curves_start_no_python_workers(spark):
    curves = boosting.curve_table(spark, [[(0.5, 0.25)], [(), (0.75,)]])
    assert "ExistingRDD" not in curves._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, curves.collect())) == [(0, 0, 1, 0.5), (0, 0, 2, 0.25), (1, 1, 1, 0.75)]
    assert curves.dtypes == [("fold", "int"), ("member", "int"), ("round", "int"), ("loss", "double")]
    assert boosting.curve_table(spark, [[]]).count() == 0
