"""CSV rules, contracts, the feature store and the sinks."""

import os

import contextlib

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.sources import csv, sinks, store


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_split_layout():
    paths = csv.split_paths("/data", "test")
    assert paths["users"] == "/data/Test Data/test_users.csv"
    assert paths["transactions"] == "/data/Test Data/test_users_transaction_attempts_v1.csv"


def test_types_tokens_and_extra_columns(spark, tmp_path):
    path = write(
        tmp_path / "g.csv",
        "extra,duration,user_id,status,created_at,generation_type,credit_cost\n"
        'e,NaN,u1,completed,2024-01-01 10:00:00,"video, ""long""",1.5\n'
        "e,abc,u2,NA,not a date,None,n/a\n"
        "e,2,,failed,2024-01-01,x,3\n",
    )
    df = csv.scan(spark, path, "generations")
    assert dict(df.dtypes)["created_at"] == "timestamp_ntz" and dict(df.dtypes)["credit_cost"] == "double"
    first, second = sorted(df.collect(), key=lambda r: r.user_id)
    assert first.generation_type == 'video, "long"' and first.credit_cost == 1.5 and first.duration is None
    assert (second.status, second.created_at, second.generation_type) == (None, None, None)
    assert (second.credit_cost, second.duration) == (None, None)


def test_namibia_survives_unless_parity(spark, tmp_path):
    path = write(
        tmp_path / "p.csv",
        "user_id,subscription_start_date,subscription_plan,country_code\nu,2024-01-01,NA,NA\n",
    )
    plain = csv.scan(spark, path, "properties").first()
    assert (plain.country_code, plain.subscription_plan) == ("NA", None)
    assert csv.scan(spark, path, "properties", parity=True).first().country_code is None


def test_typed_sources_are_only_cast(spark):
    rows = [(7, 1.5, "Credits NA", 3), (None, 2.0, "x", 4), (8, float("nan"), "NA", 5)]
    raw = spark.createDataFrame(
        rows, "user_id long, purchase_amount_dollars double, purchase_type string, other int"
    )
    got = [tuple(r) for r in csv.conform(raw, "purchases").collect()]
    assert got == [("7", 1.5, "Credits NA"), ("8", None, None)]


def test_explicit_time_format(spark, tmp_path):
    path = write(
        tmp_path / "p.csv",
        "user_id,subscription_start_date,subscription_plan,country_code\na,31/01/2024,x,y\nb,2024-01-31,x,y\n",
    )
    got = csv.scan(spark, path, "properties", timestamp_format="dd/MM/yyyy")
    assert {r.user_id: r.subscription_start_date is None for r in got.collect()} == {"a": False, "b": True}


def test_label_is_optional_other_columns_are_not(spark, tmp_path):
    users = write(tmp_path / "u.csv", "user_id\nu\n")
    assert csv.scan(spark, users, "users").columns == ["user_id"]
    with pytest.raises(ValueError, match="purchase_type"):
        csv.scan(spark, write(tmp_path / "b.csv", "user_id,purchase_amount_dollars\nu,1\n"), "purchases")


def test_file_order_decides_without_a_sequence_column(spark, tmp_path, conf):
    conf(spark__sql__files__maxPartitionBytes="2000")
    header = "user_id,source,flow_type,team_size,experience,usage_plan,frustration,first_feature,role\n"
    lines = [f"u{i % 40},s{i},f,t,e,p,other,x,r\n" for i in range(2000)]
    df = csv.scan(spark, write(tmp_path / "q.csv", header + "".join(lines)), "quizzes")
    assert df.rdd.getNumPartitions() > 4
    from tidemark.plans.profile import quiz_features

    got = {r.user_id: r.q_source for r in quiz_features(df).collect()}
    assert got == {f"u{i}": f"s{i}" for i in range(40)}


def test_file_order_for_attempts(spark, tmp_path, conf):
    conf(spark__sql__files__maxPartitionBytes="3000")
    names = [c for c in csv.TABLES["transactions"].names]
    rows = []
    for i in range(600):
        row = dict.fromkeys(names, "")
        row.update(user_id=f"u{i % 3}", transaction_time="2024-01-01", is_3d_secure="True")
        row["failure_code"] = "x" if 100 <= i < 400 else ""
        rows.append(",".join(row[n] for n in names))
    path = write(tmp_path / "t.csv", ",".join(names) + "\n" + "\n".join(rows) + "\n")
    from tidemark.plans.transactions import from_order, from_rollup

    df = csv.scan(spark, path, "transactions")
    got = from_order(df).collect()
    assert {r.ta_max_consec_fail for r in got} == {100} and {r.ta_last_failed for r in got} == {0.0}
    assert {r.ta_is_3ds for r in from_rollup(df).collect()} == {1}


def test_repeated_keys_fail_loudly(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "user_id string")
    with pytest.raises(ValueError, match="repeats.*'a'"):
        csv.assert_unique(df)
    csv.assert_unique(df.distinct())


def test_unknown_labels_fail_loudly(spark):
    users = spark.createDataFrame([("a", "vol_churn"), ("b", None)], "user_id string, churn_status string")
    with pytest.raises(ValueError, match="None"):
        csv.check_contracts({"users": users, "properties": users})
    csv.check_contracts({"users": users.where("user_id = 'a'"), "properties": users})
    csv.check_contracts({"users": users.drop("churn_status"), "properties": users})


def test_store_hits_misses_and_recovers(spark, tmp_path):
    source, root = write(tmp_path / "in" / "a.csv", "x\n1\n"), str(tmp_path / "store")
    built = []

    def build(value):
        def run():
            built.append(value)
            return spark.createDataFrame([(value,)], "v int").withColumn("split", F.lit("train"))

        return run

    get = lambda value: store.build_or_load(spark, root, "train", [source], build(value)).first()
    assert tuple(get(1)) == (1, "train") and tuple(get(2)) == (1, "train") and built == [1]
    write(source, "x\n1\n2\n")
    assert get(3).v == 3 and built == [1, 3]

    def fail():
        raise RuntimeError("lost")

    write(source, "x\n1\n2\n3\n")
    with pytest.raises(RuntimeError):
        store.build_or_load(spark, root, "train", [source], fail)
    assert get(4).v == 4


def test_new_feature_version_misses(spark, tmp_path):
    source = write(tmp_path / "a.csv", "x\n")
    assert store.fingerprint(spark, [source], "1") != store.fingerprint(spark, [source], "2")


def test_csv_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame([("a", 1)], "user_id string, n int"), out)
    assert [tuple(r) for r in spark.read.option("header", True).csv(out).collect()] == [("a", "1")]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(named)


def test_scratch_is_gone_after_the_run_and_after_a_failure(spark):
    from pathlib import Path

    folders = []
    for fail in (False, True):
        with pytest.raises(ZeroDivisionError) if fail else contextlib.nullcontext():
            with session.scratch_space(spark) as folder:
                assert session.materialize(spark.range(3), "x").count() == 3
                folders.append(Path(folder.removeprefix("file:")))
                assert folders[-1].exists()
                1 / (not fail)
    assert not any(f.exists() for f in folders)


def test_parts_in_another_column_order_fail(spark, tmp_path):
    write(tmp_path / "p" / "a.csv", "user_id,purchase_amount_dollars,purchase_type\nu,1.5,promo\n")
    write(tmp_path / "p" / "b.csv", "purchase_type,user_id,purchase_amount_dollars\npromo,u,2.5\n")
    with pytest.raises(Exception, match="(?s)header.*purchase"):
        csv.scan(spark, str(tmp_path / "p"), "purchases").collect()


def test_text_sequences_are_kept_and_numbers_keep_their_order(spark, tmp_path):
    names = csv.TABLES["transactions"].names
    lines = [",".join([*names, "attempt_id"])]
    for user, ids in (("a", ["10", "9", "2"]), ("b", ["ta_77f", "ta_9", "5"])):
        for i in ids:
            row = dict.fromkeys(names, "") | {"user_id": user, "transaction_time": "2024-01-01", "is_3d_secure": "true"}
            row["failure_code"] = "x" if i in ("10", "ta_9") else ""
            lines.append(",".join([*(row[n] for n in names), i]))
    from tidemark.plans.transactions import from_order

    df = csv.scan(spark, write(tmp_path / "t.csv", "\n".join(lines) + "\n"), "transactions")
    assert {r.user_id: r.ta_last_failed for r in from_order(df).collect()} == {"a": 1.0, "b": 1.0}


def test_repeated_sequence_fails_loudly(spark):
    users = spark.createDataFrame([("a",)], "user_id string")
    quizzes = spark.createDataFrame([("a", 1), ("a", 1)], "user_id string, seq int")
    with pytest.raises(ValueError, match="seq repeats"):
        csv.check_contracts({"users": users, "properties": users, "quizzes": quizzes})


def test_refused_lines(spark, tmp_path):
    path = write(tmp_path / "u.csv", "user_id,churn_status\na,vol_churn,extra,fields\n")
    assert csv.scan(spark, path, "users").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.scan(spark, path, "users", mode="FAILFAST").collect()


def test_other_options_miss_the_store(spark, tmp_path):
    source, root = write(tmp_path / "in" / "a.csv", "x\n1\n"), str(tmp_path / "store")

    def get(value, options):
        build = lambda: spark.createDataFrame([(value,)], "v int")
        return store.build_or_load(spark, root, "train", [source], build, options).first().v

    assert get(1, {"window": "clip"}) == 1 and get(2, {"window": "filter"}) == 2
    assert get(3, {"window": "clip"}) == 1
