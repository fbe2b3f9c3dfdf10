"""Metrics, cascade and sweeps against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import ensemble, metrics, training
from tidemark.schemas import CLASSES


def confusion(y, p, k=3):
    c = np.zeros((k, k), int)
    for a, b in zip(y, p):
        c[a, b] += 1
    return c


def scores_of(c):
    tp, support, called = np.diag(c), c.sum(1), c.sum(0)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    return ratio(tp, called), ratio(tp, support), ratio(2 * tp, support + called), support


def weighted(y, p):
    _, _, f1, support = scores_of(confusion(y, p))
    return float((f1 * support).sum() / support.sum())


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    y = [rng.choices(range(3), [6, 3, 1])[0] for _ in range(500)]
    p = [a if rng.random() < 0.6 else rng.randint(0, 1) for a in y]
    return y, p


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, pred int")


def test_weighted_f1_and_report(spark, labelled):
    y, p = labelled
    df = frame(spark, y, p)
    assert metrics.weighted_f1(df).first()["f1"] == pytest.approx(weighted(y, p))
    precision, recall, f1, support = scores_of(confusion(y, p))
    rows = {r["name"]: r for r in metrics.classification_report(df).collect()}
    for i, name in enumerate(CLASSES):
        got = rows[name]
        want = (precision[i], recall[i], f1[i], support[i])
        assert (got.precision, got.recall, got.f1, got.support) == pytest.approx(want)
    assert rows["accuracy"].f1 == pytest.approx(np.mean(np.array(y) == np.array(p)))
    assert rows["macro avg"].f1 == pytest.approx(f1.mean())
    assert rows["weighted avg"].recall == pytest.approx((recall * support).sum() / 500)
    assert rows["weighted avg"].support == 500


def test_confusion_matrix(spark, labelled):
    y, p = labelled
    got = {r.actual: [r.pred_not, r.pred_vol, r.pred_invol] for r in metrics.confusion_matrix(frame(spark, y, p)).collect()}
    assert [got[c] for c in CLASSES] == confusion(y, p).tolist()


def test_a_class_nobody_calls_scores_zero(spark):
    assert metrics.weighted_f1(frame(spark, [2, 2], [0, 0])).first()["f1"] == 0.0


def test_binary_f1_per_group(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.5), (1, 0, 0.1)]
    df = spark.createDataFrame(rows, "fold int, y int, s double")
    got = {r.fold: r.f1 for r in metrics.binary_f1(df, "y", "s", by=["fold"]).collect()}
    assert got == {0: pytest.approx(0.5), 1: 0.0}


def raw_scores(n=240, seed=9):
    rng = np.random.default_rng(seed)
    y = rng.choice(3, n, p=[0.5, 0.3, 0.2])
    s1 = np.clip((y > 0) * 0.25 + rng.random(n) * 0.7, 0, 1).round(3)
    s2 = np.where(y == 0, 0.5, np.clip((y == 2) * 0.3 + rng.random(n) * 0.7, 0, 1)).round(3)
    m = rng.dirichlet([2, 2, 2], n) + np.eye(3)[y] * 0.2
    return y, s1, s2, m / m.sum(1, keepdims=True)


def mix(s1, s2, m, t, a, scale=None):
    pc = np.clip(s1 / (2 * t), 0, 1)
    b = a * np.stack([1 - pc, pc * (1 - s2), pc * s2], 1) + (1 - a) * m
    if scale is not None:
        b[:, 1] *= scale
        b /= b.sum(1, keepdims=True)
    return b


def search(y, s1, s2, m):
    def best(values, predict, floor, default):
        top, found = floor, default
        for v in values:
            f = weighted(y, predict(v).argmax(1))
            if f > top + 1e-12:
                top, found = f, v
        return found, top

    t, _ = best(ensemble.THRESHOLDS, lambda v: mix(s1, s2, m, v, 0.8), 0, 0.5)
    a, top = best(ensemble.ALPHAS, lambda v: mix(s1, s2, m, t, v), 0, 0.8)
    s, _ = best(ensemble.SCALES, lambda v: mix(s1, s2, m, t, a, v), top, 1.0)
    return t, a, s


def score_frame(spark, y, s1, s2, m):
    rows = [
        (i, int(y[i]), i % 5, float(s1[i]), float(s2[i]), *map(float, m[i])) for i in range(len(y))
    ]
    schema = "user_id int, y int, fold int, s1 double, s2 double, m0 double, m1 double, m2 double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [9, 10])
def test_tuning_equals_a_plain_search(spark, seed):
    data = raw_scores(seed=seed)
    got = ensemble.tune(score_frame(spark, *data))
    assert tuple(got)[:3] == pytest.approx(search(*data))


def test_nested_f1_tunes_without_the_fold(spark):
    y, s1, s2, m = raw_scores()
    fold, called = np.arange(len(y)) % 5, np.zeros(len(y), int)
    for k in range(5):
        rest, held = fold != k, fold == k
        t, a, s = search(y[rest], s1[rest], s2[rest], m[rest])
        called[held] = mix(s1[held], s2[held], m[held], t, a, None if s == 1 else s).argmax(1)
    got = ensemble.nested_f1(score_frame(spark, y, s1, s2, m)).first()["f1"]
    assert got == pytest.approx(weighted(y, called))


def test_probabilities_sum_to_one(spark):
    df = score_frame(spark, *raw_scores())
    for tuning in (ensemble.Tuning(0.4, 0.7, 1.0), ensemble.Tuning(0.3, 0.5, 1.3)):
        out = ensemble.probabilities(df, tuning)
        worst = out.agg(F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1))).first()[0]
        assert worst < 1e-9
    table = ensemble.probability_table(out)
    assert table.columns == [
        "prob_not_churned",
        "prob_vol_churn",
        "prob_invol_churn",
        "user_id",
        "churn_status",
    ]


def test_missing_second_stage_is_undecided(spark):
    rows = spark.createDataFrame([(1,), (2,)], "user_id int")
    second = spark.createDataFrame([(2, 0.9)], "user_id int, s2 double")
    got = {r.user_id: r.s2 for r in ensemble.with_second_stage(rows, second).collect()}
    assert got == {1: 0.5, 2: 0.9}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)], "y int")
    balanced = {r.y: r.weight for r in training.class_weights(df, "y", "balanced").collect()}
    assert balanced == pytest.approx({0: 10 / 18, 1: 10 / 9, 2: 10 / 3})
    lifted = {r.y: r.weight for r in training.class_weights(df, "y", "unbalanced").collect()}
    assert lifted == pytest.approx({0: 1.0, 1: 2.0, 2: 6.0})
    with pytest.raises(ValueError):
        training.class_weights(df, "y", "other")
