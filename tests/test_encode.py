"""Folds, ranks and encodings against direct computation."""

import hashlib
import random

import pytest
from helpers import by_key
from pyspark.sql import functions as F

from tidemark.functions.labels import with_targets
from tidemark.operators.ranks import fold_columns, position_in_group, stratified_folds
from tidemark.plans import encode, training
from tidemark.schemas import CLASSES
from tidemark.session import materialize


def users(n=600, seed=0):
    rng = random.Random(seed)
    return [(f"u{i}", rng.choices(CLASSES, [5, 3, 2])[0], rng.choice(["x", "y", "z", None])) for i in range(n)]


@pytest.mark.parametrize("prefix", [1, 3])
def test_folds_equal_a_plain_rank(spark, prefix):
    rows = users()
    df = spark.createDataFrame(rows, "user_id string, label string, c string")
    got = {r.user_id: r.fold for r in stratified_folds(df, "user_id", "label", 42, prefix=prefix).collect()}
    want = {}
    for label in CLASSES:
        members = [u for u, l, _ in rows if l == label]
        members.sort(key=lambda u: (hashlib.md5(f"42:{u}".encode()).hexdigest(), u))
        want |= {u: i % 5 for i, u in enumerate(members)}
    assert got == want


def test_folds_are_balanced_and_ignore_layout(spark):
    rows = users(997)
    df = spark.createDataFrame(rows, "user_id string, label string, c string")
    folded = stratified_folds(df, "user_id", "label", 7)
    sizes = {}
    for r in folded.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())
    again = stratified_folds(df.repartition(11), "user_id", "label", 7)
    assert folded.exceptAll(again).isEmpty() and again.exceptAll(folded).isEmpty()


def test_several_fold_columns_at_once(spark):
    df = spark.createDataFrame(users(300), "user_id string, label string, c string")
    strata = {"f1": (F.col("label"), 42), "f2": (F.col("c"), 7)}
    got = fold_columns(df, "user_id", strata)
    one = stratified_folds(df, "user_id", "label", 42).select("user_id", F.col("fold").alias("f1"))
    two = stratified_folds(df.where("c IS NOT NULL"), "user_id", "c", 7)
    want = one.join(two.select("user_id", F.col("fold").alias("f2")), "user_id", "left")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_positions_across_chunks(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    rng = random.Random(1)
    words = {"a": {f"v{rng.randint(0, 9999)}" for _ in range(700)}, "b": {"unknown", "É", "e", "Z", ""}}
    rows = [(g, w) for g, ws in words.items() for w in ws]
    df = spark.createDataFrame(rows, "g string, w string").repartition(5)
    got = {(r.g, r.w): r.pos for r in position_in_group(df, "g", "w", "pos").collect()}
    want = {(g, w): i for g, ws in words.items() for i, w in enumerate(sorted(ws, key=str.encode))}
    assert got == want


TARGETS = ("is_churned", "is_vol", "is_invol")


def brute(rows, folds):
    code = {"not_churned": (0, 0, 0), "vol_churn": (1, 1, 0), "invol_churn": (1, 0, 1)}
    overall = [sum(code[l][t] for _, l, _ in rows) / len(rows) for t in range(3)]
    out = {}
    for u, _, c in rows:
        others = [code[l] for v, l, d in rows if d == c and c is not None and folds[v] != folds[u]]
        out[u] = [sum(o[t] for o in others) / len(others) if others else overall[t] for t in range(3)]
    return out


@pytest.fixture(params=["broadcast", "shuffle"])
def strategy(request, conf):
    if request.param == "shuffle":
        conf(
            spark__sql__autoBroadcastJoinThreshold="-1",
            spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        )
    return request.param


def prepared(spark, rows):
    df = with_targets(spark.createDataFrame(rows, "user_id string, churn_status string, c string"))
    return stratified_folds(df, "user_id", "y", 0)


def test_out_of_fold_means(spark, strategy):
    rows = users(120) + [("lonely", "vol_churn", "only once")]
    train = prepared(spark, rows)
    stats = encode.target_stats(train, "fold", ["c"])
    encoded = stats.out_of_fold(train)
    assert encoded.count() == len(rows)
    want = brute(rows, {r.user_id: r.fold for r in train.collect()})
    for user, r in by_key(encoded).items():
        assert [r[f"te_c_{t}"] for t in TARGETS] == pytest.approx(want[user])


def test_full_means_and_unseen_categories(spark, strategy):
    rows = users(90, seed=3)
    stats = encode.target_stats(prepared(spark, rows), "fold", ["c"])
    test = spark.createDataFrame([("t1", "x"), ("t2", "never"), ("t3", None)], "user_id string, c string")
    got = by_key(stats.full(test))
    churned = lambda rs: sum(l != "not_churned" for _, l, _ in rs) / len(rs)
    assert got["t1"]["te_c_is_churned"] == pytest.approx(churned([r for r in rows if r[2] == "x"]))
    assert got["t2"]["te_c_is_churned"] == got["t3"]["te_c_is_churned"] == pytest.approx(churned(rows))


def test_ordinal_codes_follow_the_joint_sorted_vocabulary(spark, strategy):
    train = spark.createDataFrame([("a", "m", 1), ("b", None, 2)], "user_id string, c string, n int")
    test = spark.createDataFrame([("c", "z", 3), ("d", "B", 4)], "user_id string, c string, n int")
    train, test = encode.fill_categories(train, ["c"]), encode.fill_categories(test, ["c"])
    codes = encode.vocabulary([train, test], ["c"])
    got = by_key(encode.ordinal_encode(train.unionByName(test), codes, ["c"]))
    assert {u: (r["c"], r["n"]) for u, r in got.items()} == {"a": (1, 1), "b": (2, 2), "c": (3, 3), "d": (0, 4)}


def test_dense_matrix_marks_missing_and_nan(spark):
    df = spark.createDataFrame([(1, None, float("nan"))], "user_id int, a int, b double")
    dense = encode.dense_matrix(df, ["a", "b"], ["user_id"])
    assert tuple(dense.first()) == (1, -1.0, -1.0)
    assert [t for _, t in dense.dtypes] == ["int", "float", "float"]


def test_all_encodings_take_two_joins(spark, no_broadcast):
    rows = users(200, seed=5) + [("odd", "vol_churn", "unknown")]
    train = materialize(prepared(spark, rows).withColumn("d", F.col("c")), "train")
    columns = ["c", "d"]
    codes = encode.vocabulary([encode.fill_categories(train, columns)], columns)
    stats = encode.target_stats(train, "fold", columns)
    df = encode.encode_all(train, codes, stats, columns, "fold")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    apart = encode.ordinal_encode(
        encode.fill_categories(stats.out_of_fold(train), columns), codes, columns
    ).select(df.columns)
    assert df.count() == len(rows) and df.exceptAll(apart).isEmpty()


def test_folds_take_few_exchanges(spark, no_broadcast):
    labelled = with_targets(spark.createDataFrame(users(50), "user_id string, churn_status string, c string"))
    plan = training.fold_table(labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 8 and plan.count("Scan ") <= 3
