"""Publication, restarts, partial states, rejected input and bucketed tables."""

import os
import random
import threading
from dataclasses import replace
from multiprocessing.pool import ThreadPool

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalogue import fixtures
from tidemark.plans import assemble, boosting, generations, incremental, pipeline, training
from tidemark.schemas import CLASSES, KEY, TABLES, TARGETS
from tidemark.session import materialize
from tidemark.sources import commit, csv, layout, models, store

SMALL = "/root/testdata/sf0.001"


# --- publication ---


def test_two_builders_at_once_share_one_table(spark, tmp_path):
    """Both find nothing, both build; the later one reads what the earlier has published."""
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "a.txt").write_text("x")
    both_build, found = threading.Barrier(2, timeout=60), {}

    def run(value):
        def build():
            both_build.wait()
            return spark.createDataFrame([(value,)], "v int")

        found[value] = store.build_or_load(spark, root, "train", [str(source)], build).first().v

    threads = [threading.Thread(target=run, args=(v,)) for v in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(found.values())) == 1 and set(found) == {1, 2}
    (mark,) = os.listdir(f"{root}/features")
    assert len(os.listdir(f"{root}/features/{mark}")) == 1
    assert not [n for n in os.listdir(f"{root}/manifest") if "staged" in n]


def test_a_build_that_dies_is_redone(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "a.txt").write_text("x")
    broken = spark.createDataFrame([(1,)], "v int").select(F.raise_error(F.lit("died")).cast("int").alias("v"))
    with pytest.raises(Exception, match="died"):
        store.build_or_load(spark, root, "train", [str(source)], lambda: broken)
    assert store.build_or_load(spark, root, "train", [str(source)], lambda: spark.range(3).toDF("v")).count() == 3


def test_parts_are_stored_beside_the_features(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    build = lambda: (spark.range(3).toDF("v"), {"rejects": spark.range(2).toDF("r")})
    get = lambda part: store.build_or_load(spark, str(tmp_path / "s"), "train", [str(tmp_path / "a.txt")], build, None, part)
    assert get("features").count() == 3 and get("rejects").columns == ["r", "split"]


def test_the_first_manifest_wins(spark, tmp_path):
    path = str(tmp_path / "m" / "one")
    assert commit.published(spark, path) is None
    assert commit.publish(spark, path, {"a": 1}) == {"a": 1}
    assert commit.publish(spark, path, {"a": 2}) == {"a": 1} == commit.published(spark, path)


# --- restarts, rounds, nodes ---


def planted(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choices(range(3), [5, 3, 2])[0]
        rows.append((f"{seed}-{i}", CLASSES[y], (y > 0) + rng.gauss(0, 0.5), rng.random()))
    return spark.createDataFrame(rows, "user_id string, churn_status string, a double, noise double")


FEATURES = ("a", "noise")
MODEL = training.Settings(rounds=12, stage1_depth=4, stage2_depth=2, multiclass_depth=2, patience=3, parallelism=1)
# Steps so large that a later round is worse, so that models are cut after few rounds.
HASTY = replace(MODEL, rounds=3, step=1.0, stage1_depth=3, patience=1)


@pytest.fixture(scope="module")
def frames(spark):
    train = pipeline.with_folds(planted(spark, 400, 1))
    carried = ["y", *TARGETS, *training.FOLD_COLUMNS]
    return (
        materialize(training.model_frame(train, carried, FEATURES), "fit"),
        materialize(training.model_frame(planted(spark, 60, 2), [], FEATURES), "predict"),
    )


@pytest.fixture(scope="module")
def kept(frames, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    return root, training.stage1(*frames, MODEL, features=FEATURES, store=root)


def best_by_hand(losses, patience):
    best = None
    for k, loss in enumerate(losses, 1):
        if loss is not None and loss == loss and (best is None or loss < losses[best - 1]):
            best = k
        if best is not None and k - best >= patience:
            break
    return best


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([0.1, 0.2, 0.3, 0.4, float("nan"), None]), min_size=1, max_size=15), min_size=1, max_size=6),
    st.integers(1, 5),
)
def test_rounds_with_patience(spark, curves, patience):
    rows = [(k, 0, n, loss) for k, c in enumerate(curves) for n, loss in enumerate(c, 1)]
    df = spark.createDataFrame(rows, "fold int, member int, round int, loss double")
    found = {r.fold: r.rounds for r in boosting.best_rounds(df, patience).collect()}
    assert found == {k: best_by_hand(c, patience) for k, c in enumerate(curves)}


def test_models_keep_the_rounds_up_to_their_best(frames, kept):
    scores = kept[1]
    curves = {}
    for r in scores.curves().orderBy("fold", "round").collect():
        curves.setdefault(r.fold, []).append(r.loss)
    assert all(len(c) == 12 for c in curves.values()) and set(curves) == set(range(5))
    rounds = {r.fold: r.rounds for r in scores.rounds().collect()}
    assert rounds == {k: best_by_hand(c, 3) for k, c in curves.items()}
    assert min(rounds.values()) < 12  # noise is learned late, so some fold stops before the end
    model = scores.models[0].members[0]
    held = frames[0].where("fold_s1 = 0").withColumn("weight", F.lit(1.0))
    again = model.evaluateEachIteration(held.withColumn("is_churned", F.col("is_churned").cast("double")))
    assert again == pytest.approx(curves[0][: rounds[0]])


def test_importances_need_no_active_session(spark, frames):
    """Models are cut in threads that have no active session, and their importances can be taken in one."""
    scores = training.multiclass(*frames, HASTY, features=FEATURES)
    assert min(r.rounds for r in scores.rounds().collect()) < HASTY.rounds
    with ThreadPool(1) as pool:
        assert pool.apply(SparkSession.getActiveSession) is None
        ranked = pool.apply(training.importances, (scores,))
    assert [r.feature for r in ranked.collect()] == ["a", "noise"]
    assert ranked.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("fit", [training.multiclass, training.stage1, training.stage2])
def test_cut_models_are_the_first_trees_of_whole_ones(frames, fit):
    scores = fit(*frames, HASTY, features=FEATURES)
    whole = fit(*frames, replace(HASTY, patience=None), features=FEATURES)
    kept = [r.rounds for r in scores.rounds().orderBy("fold", "member").collect()]
    assert kept == [best_by_hand(c, HASTY.patience) for m in scores.models for c in m.curves] and min(kept) < HASTY.rounds
    trees = lambda s: [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for f in s.models for m in f.members]
    assert trees(scores) == [every[:n] for every, n in zip(trees(whole), kept)]


def test_an_interrupted_cross_validation_goes_on(spark, frames, tmp_path, monkeypatch):
    root, fits, save = str(tmp_path / "models"), [], training.save_fold

    def counted(*args):
        fits.append(args[2])
        if len(fits) == 3:
            raise RuntimeError("lost driver")
        return save(*args)

    monkeypatch.setattr(training, "save_fold", counted)
    with pytest.raises(RuntimeError, match="lost"):
        training.stage2(*frames, MODEL, features=FEATURES, store=root)
    (mark,) = os.listdir(root)
    done = {int(n.rpartition("-")[2]) for n in os.listdir(f"{root}/{mark}") if n.startswith("manifest-")}
    assert 2 <= len(done) < 5
    fits.clear()
    monkeypatch.setattr(training, "save_fold", lambda *args: fits.append(args[2]) or save(*args))
    resumed = training.stage2(*frames, MODEL, features=FEATURES, store=root)
    assert set(fits) == set(range(5)) - done
    fits.clear()
    again = training.stage2(*frames, MODEL, features=FEATURES, store=root)
    fresh = training.stage2(*frames, MODEL, features=FEATURES)
    assert fits == []
    for other in (again, fresh):
        diff = other.oof.withColumnRenamed("s2", "other").join(resumed.oof, KEY)
        assert diff.agg(F.max(F.abs(F.col("s2") - F.col("other")))).first()[0] == 0.0


def test_other_rows_or_settings_are_fitted_anew(frames):
    train = frames[0]
    mark = lambda rows, s: models.fit_mark(rows, [KEY, "y"], "features", training.boosted_trees(s, 3), {})
    base = mark(train, MODEL)
    assert base == mark(train.repartition(7), MODEL)
    assert base != mark(train.where("user_id <> '1-0'"), MODEL)
    assert base != mark(train, training.Settings(rounds=13, patience=3))


def test_nodes_of_saved_trees(spark, kept):
    import duckdb

    root, scores = kept
    nodes = scores.nodes()
    rounds = {r.fold: r.rounds for r in scores.rounds().collect()}
    trees = {r.fold: r.n for r in nodes.groupBy("fold").agg(F.countDistinct("tree").alias("n")).collect()}
    assert trees == rounds
    rows = nodes.toPandas()  # noqa: F841 - DuckDB reads it by name
    want = duckdb.sql("SELECT feature, count(*) AS n, sum(rows) AS rows FROM rows WHERE is_split GROUP BY feature").fetchall()
    found = {r.feature: r for r in scores.split_importances().collect()}
    assert {(FEATURES.index(f), r.splits, r.rows) for f, r in found.items() if r.splits} == {tuple(map(int, w)) for w in want}
    for model in scores.models:
        assert sum(t.numNodes for t in model.members[0].trees) > 0
    total = sum((t.numNodes - 1) // 2 for m in scores.models for t in m.members[0].trees)
    assert sum(r.splits for r in found.values()) == total
    assert found["a"].gain > found["noise"].gain


# --- partial states ---


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("events"))
    tables = fixtures.tables(spark, "/root/testdata/sf0.01", ["generations", "properties"])
    events = tables["generations"]
    for k in range(5):
        events.where(F.col("event_id") % 5 == k).coalesce(1).write.parquet(f"{root}/{k}")
    return root, events, tables["properties"]


def close(a, b):
    left = {r[KEY]: r for r in a.collect()}
    right = {r[KEY]: r for r in b.collect()}
    assert set(left) == set(right)
    for key, r in left.items():
        for name, x in r.asDict().items():
            y = right[key][name]
            assert x == y or x == pytest.approx(y, abs=1e-7, rel=1e-9), (key, name, x, y)


@pytest.mark.parametrize("window", ["clip", "filter"])
def test_states_of_files_merge_to_the_full_build(spark, event_files, tmp_path, window):
    root, events, properties = event_files
    read = lambda files: spark.read.parquet(*files)
    found = incremental.incremental_features(
        spark, str(tmp_path), [root], properties, read, window=window, files_per_segment=2
    )
    close(found, generations.generation_features(events, properties, window=window))


def test_only_new_and_changed_files_are_read(spark, event_files, tmp_path):
    import shutil

    source, _, properties = event_files
    root, store_, seen = str(tmp_path / "in"), str(tmp_path / "states"), []

    def read(files):
        seen.extend(os.path.basename(os.path.dirname(f)) for f in files)
        return spark.read.parquet(*files)

    def build():
        seen.clear()
        return incremental.incremental_features(spark, store_, [root], properties, read, files_per_segment=1)

    for k in range(3):
        shutil.copytree(f"{source}/{k}", f"{root}/{k}")
    build()
    assert sorted(seen) == ["0", "1", "2"]
    shutil.copytree(f"{source}/3", f"{root}/3")
    found = build()
    assert seen == ["3"]
    close(found, generations.generation_features(spark.read.parquet(*[f"{root}/{k}" for k in range(4)]), properties))
    build()
    assert seen == []
    shutil.copytree(f"{source}/4", f"{root}/1", dirs_exist_ok=True)  # one more file in a known folder
    build()
    assert seen == ["1"]


def test_other_starts_make_other_states(spark, event_files, tmp_path):
    root, events, properties = event_files
    read = lambda files: spark.read.parquet(*files)
    later = properties.withColumn("subscription_start_date", F.date_add("subscription_start_date", 3))
    for p in (properties, later):
        found = incremental.incremental_features(spark, str(tmp_path), [root], p, read)
    close(found, generations.generation_features(events, later))


# --- rejected input ---


def test_what_is_wrong_with_the_input_is_kept_and_counted(spark, tmp_path):
    names = TABLES["purchases"].names
    good = dict(zip(names, [""] * len(names)))
    lines = [",".join(names)]
    for row in (
        {"user_id": "a", "purchase_amount_dollars": "1.5"},
        {"user_id": "", "purchase_amount_dollars": "2"},
        {"user_id": "b", "purchase_amount_dollars": "two"},
        {"user_id": "c", "purchase_amount_dollars": "NA"},
    ):
        lines.append(",".join((good | row)[n] for n in names))
    lines += [lines[1] + ",more", "d"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    scanned = csv.scan(spark, str(tmp_path / "p.csv"), "purchases", checked=True)
    found = csv.store_checked(scanned, "purchases")
    assert found.counts == {"rows": 6, "broken": 2, "keyless": 1, "unread": 1}
    problems = sorted((r.reason, r.column or "", r.text or "", r.user_id or "") for r in found.rejects.collect())
    assert problems == [
        ("broken line", "", lines[1] + ",more", "a"),
        ("broken line", "", "d", "d"),
        ("no key", "user_id", "", ""),
        ("not converted", "purchase_amount_dollars", "two", "b"),
    ]
    plain = csv.scan(spark, str(tmp_path / "p.csv"), "purchases")
    assert sorted(map(str, found.rows.collect())) == sorted(map(str, plain.collect()))


def test_an_empty_table_has_no_problems(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",".join(TABLES["purchases"].names) + "\n")
    found = csv.store_checked(csv.scan(spark, str(tmp_path / "p.csv"), "purchases", checked=True), "purchases")
    assert found.counts == {"rows": 0, "broken": 0, "keyless": 0, "unread": 0}
    assert found.rows.isEmpty() and found.rejects.isEmpty()


def test_the_order_of_rows_is_three_numbers(spark, tmp_path):
    names = [n for n in TABLES["quizzes"].names]
    for k, file in enumerate(("b.csv", "a.csv")):
        rows = [",".join("u" if n == "user_id" else f"{file}{i}" if n == "source" else "" for n in names) for i in range(3)]
        (tmp_path / "a folder").mkdir(exist_ok=True)
        (tmp_path / "a folder" / file).write_text("\n".join([",".join(names), *rows]) + "\n")
    found = csv.scan(spark, str(tmp_path / "a folder"), "quizzes")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema["seq"].dataType.fields}
    assert kinds == {"file": "int", "block": "bigint", "row": "bigint"}
    assert [r.source for r in found.orderBy("seq").collect()] == [f"{f}.csv{i}" for f in "ab" for i in range(3)]


# --- buckets ---


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture(scope="module")
def bucketed(spark):
    tables = fixtures.tables(spark, SMALL)
    return tables, {t: layout.store_bucketed(df, layout.bucket_name(t), buckets=8) for t, df in tables.items()}


def test_bucketed_tables_meet_without_an_exchange(spark, bucketed, no_broadcast):
    plain, stored = bucketed
    events, properties = stored["generations"], stored["properties"]
    built = generations.generation_features(events, properties, bucketed=True)
    assert exchanges(built) == 0
    assert exchanges(generations.generation_features(plain["generations"], plain["properties"])) > 2
    users = stored["users"].join(built, KEY, "left").join(stored["properties"], KEY, "left")
    assert exchanges(users) == 0
    # Of a whole build only the ordered log of attempts moves: its chunks are cut by range, not by user.
    assert exchanges(assemble.join_sources(stored, bucketed=True)) <= 3


def test_a_stored_feature_table_joins_its_split_without_an_exchange(spark, bucketed, no_broadcast):
    _, stored = bucketed
    features = materialize(assemble.feature_table(stored), "features")
    kept = layout.store_bucketed(features, layout.bucket_name("features"), buckets=8)
    both = kept.join(stored["users"].select(KEY), KEY).groupBy(KEY).agg(F.max("gen_total").alias("n"))
    assert exchanges(both) == 0
    assert sorted(map(str, kept.drop("x").collect())) == sorted(map(str, features.collect()))


def test_a_key_too_large_for_a_bucket_is_refused(spark):
    rows = spark.range(1000).select(F.lit(1).alias(KEY), "id")
    with pytest.raises(ValueError, match="1000 rows"):
        layout.store_bucketed(rows, layout.bucket_name("hot"), max_key_rows=999)
