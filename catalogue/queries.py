"""Checked queries: each takes a session and a data folder and returns a DataFrame.

Results are shaped for comparison only here: integers as bigint, doubles rounded to seven places.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import fixtures
from tidemark.functions.labels import decode, with_targets
from tidemark.operators.ranks import stratified_folds
from tidemark.plans import analytics, boosting, encode, ensemble, generations, metrics, profile, training, transactions
from tidemark.plans.incremental import incremental_features
from tidemark.plans.assemble import feature_table, join_sources, with_composites, zero_fill
from tidemark.plans.pipeline import encode_splits, model_frames, with_folds
from tidemark.schemas import (
    BASE_FEATURES,
    COMPOSITE_FEATURES,
    KEY,
    LABEL,
    MODEL_FEATURES,
    PRESENCE_FEATURES,
    SEQUENCE,
    TABLES,
    TARGET_ENCODED,
    TARGETS,
    TE_FEATURES,
    categorical,
    names,
    zero_filled,
)
from tidemark.session import configure, materialize, scratch_path
from tidemark.sources.csv import load_split, scan, split_paths, store_checked
from tidemark.sources.layout import bucket_name, store_bucketed
from tidemark.sources.sinks import write_csv
from tidemark.sources.store import build_or_load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# One tree of one split without any sampling, so that SQL can compute every score.
EXACT = training.Settings(
    rounds=1,
    stage1_depth=1,
    stage2_depth=1,
    multiclass_depth=1,
    trees=1,
    subsample=1.0,
    feature_share="all",
    forest_share="all",
    bootstrap=False,
    parallelism=5,
)
# Few and shallow trees on all features and users; what is checked holds for trees of any size.
SHALLOW = training.Settings(rounds=3, stage1_depth=3, stage2_depth=3, multiclass_depth=3, parallelism=5)


def seven_places(c: Column) -> Column:
    """Scale, round, scale back, as the SQL side does.

    Means of cents often end in a 5 at the eighth place, where the order of a sum would decide; a hundredth
    of the last place moves the rounding point away from them.
    """
    return F.round(c.cast("double") * 1e7 + 0.01) / 1e7


def comparable(df: DataFrame) -> DataFrame:
    def shape(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = seven_places(c)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("bigint")
        return c.alias(f.name)

    return df.select(*[shape(f) for f in df.schema.fields])


def register(name: str, fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(fn(configure(spark), sf_dir))

    run.__name__, run.__doc__ = name, fn.__doc__
    QUERIES[name] = run
    return run


def query(fn: Query) -> Query:
    return register(fn.__name__, fn)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixtures.tables(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, name)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations.on_arc(
        _table(spark, sf_dir, "generations"), _table(spark, sf_dir, "properties")
    )


# --- sources and sinks ---------------------------------------------------------------------------


def _write_splits(tables: Mapping[str, DataFrame], root: str, splits: Sequence[str]) -> None:
    """CSV folders of every split; the writes are independent jobs submitted together."""

    def write(job: tuple[str, str, str]) -> None:
        split, name, path = job
        users = tables["users"].where(F.col("split") == split)
        if name == "users":
            rows = users.drop("split", *([LABEL] if split == "test" else []))
        else:
            rows = tables[name].join(users.select(KEY), KEY, "left_semi")
        write_csv(rows.select([F.col(c).cast("string") for c in rows.columns]), path)

    jobs = [(s, name, path) for s in splits for name, path in split_paths(root, s).items()]
    with ThreadPool(len(TABLES)) as pool:
        pool.map(inheritable_thread_target(tables["users"].sparkSession)(write), jobs)


@query
def src_csv_roundtrip(spark, sf_dir):
    """All tables of both splits written as CSV, scanned back, and summed up per table."""
    tables, root = _tables(spark, sf_dir), scratch_path(spark, "csv")
    # One numeric or time measure and one nullable text column per table.
    probes = {
        "users": (F.lit(0.0), F.col(KEY)),
        "generations": (F.col("credit_cost"), F.col("status")),
        "properties": (F.dayofmonth("subscription_start_date").cast("double"), F.col("country_code")),
        "purchases": (F.col("purchase_amount_dollars"), F.col("purchase_type")),
        "quizzes": (F.col("seq.number").cast("double"), F.col("frustration")),
        "transactions": (F.col("amount_in_usd"), F.col("failure_code")),
    }
    parts = []
    splits = ("train", "test")
    _write_splits(tables, root, splits)
    for split in splits:
        for name, df in load_split(spark, root, split).items():
            measure, text = probes[name]
            parts.append(
                df.agg(
                    F.count(F.lit(1)).alias("n_rows"),
                    F.sum(F.col(KEY).cast("bigint")).alias("key_sum"),
                    # Thousandths as integers: an exact sum in any order.
                    F.sum(F.round(measure * 1000).cast("bigint")).alias("measure_sum"),
                    F.count(text).alias("text_count"),
                ).select(F.lit(split).alias("split"), F.lit(name).alias("table_name"), "*")
            )
    return reduce(DataFrame.unionByName, parts)


def _scanned(name: str) -> None:
    """Register the typed rows of one table of both splits, after writing and scanning CSV."""

    def fn(spark, sf_dir):
        root = scratch_path(spark, "csv")
        _write_splits(_tables(spark, sf_dir), root, ("train", "test"))
        parts = []
        for split in ("train", "test"):
            df = load_split(spark, root, split)[name].withColumn("split", F.lit(split))
            if name in SEQUENCE:
                df = df.withColumn(SEQUENCE[name], F.col(f"{SEQUENCE[name]}.number"))
            parts.append(df)
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    register(f"src_{name}", fn)


for _name in TABLES:
    _scanned(_name)


@query
def csv_features(spark, sf_dir):
    """The 109 features built from the CSV folders of both splits."""
    root = scratch_path(spark, "csv")
    _write_splits(_tables(spark, sf_dir), root, ("train", "test"))
    parts = []
    for split in ("train", "test"):
        built = feature_table(load_split(spark, root, split))
        parts.append(built.select(F.col(KEY).cast("bigint").alias(KEY), *names(BASE_FEATURES)))
    return reduce(DataFrame.unionByName, parts)


@query
def feature_cache_roundtrip(spark, sf_dir):
    """The finished feature table, built once and read back from the store."""
    store = scratch_path(spark, "store")
    inputs = [f"{sf_dir}/{s}.parquet" for s in fixtures.SOURCES]
    tables = _tables(spark, sf_dir)

    def build() -> DataFrame:
        return feature_table(tables)

    build_or_load(spark, store, "train", inputs, build)

    def never() -> DataFrame:
        raise AssertionError("the store should have answered")

    stored = build_or_load(spark, store, "train", inputs, never)
    return stored.select(KEY, LABEL, *names(BASE_FEATURES))


@query
def src_rejects(spark, sf_dir):
    """Events written as CSV lines, some of them spoilt, and what the scan makes of these: reasons as kept and as counted."""
    events = _table(spark, sf_dir, "generations")
    number = F.col("event_id")
    spoilt = events.select(number.alias("n"), *[F.col(c).cast("string").alias(c) for c in events.columns])
    n = F.col("n")
    spoilt = spoilt.withColumns({
        KEY: F.when(n % 53 != 7, F.col(KEY)),
        "created_at": F.when(n % 37 == 5, "not a date").otherwise(F.col("created_at")),
        "credit_cost": F.when(n % 41 == 3, "x1").otherwise(F.col("credit_cost")),
    })
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in events.columns])
    line = F.when(n % 59 == 11, F.concat(line, F.lit(",one,more"))).otherwise(line)
    # The names stand before the first line of every file.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = spoilt.select(line.alias("line"), first.alias("first"))
    named = F.array(F.lit(",".join(events.columns)), F.col("line"))
    path = scratch_path(spark, "spoilt")
    lines.select(F.explode(F.when(F.col("first"), named).otherwise(F.array("line")))).write.text(path)

    checked = store_checked(scan(spark, path, "generations", checked=True), "checked")
    observed = {"broken line": "broken", "no key": "keyless", "not converted": "unread"}
    counted = F.element_at(F.create_map(*[F.lit(x) for r, c in observed.items() for x in (r, checked.counts[c])]), F.col("reason"))
    return checked.rejects.groupBy("reason", F.col("column").alias("column_name")).agg(
        F.count(F.lit(1)).alias("n"), F.count(KEY).alias("with_key"), F.count("text").alias("with_text")
    ).withColumn("counted", counted).withColumn("n_rows", F.lit(checked.counts["rows"])).withColumn(
        "n_kept", F.lit(checked.rows.count())
    )


# --- features ------------------------------------------------------------------------------------


@query
def prop_features(spark, sf_dir):
    return profile.property_features(_table(spark, sf_dir, "properties"))


def _generation(name: str, *columns: str) -> None:
    """Register a slice of the rollup features; Catalyst drops the aggregates it does not use."""

    def fn(spark, sf_dir):
        return generations.from_rollup(_events(spark, sf_dir)).select(KEY, *columns)

    register(name, fn)


@query
def gen_core(spark, sf_dir):
    features = generations.generation_features(
        _table(spark, sf_dir, "generations"), _table(spark, sf_dir, "properties")
    )
    return features.select(
        KEY,
        "gen_total",
        "gen_completed",
        "gen_failed",
        "gen_nsfw",
        "gen_canceled",
        "gen_credit_total",
        "gen_credit_mean",
        "gen_credit_max",
        "gen_credit_std",
        "gen_days_active",
        "gen_types_unique",
        "gen_max_in_day",
        "gen_span_hours",
        "gen_per_active_day",
    )


_generation("gen_ratios", "gen_completion_rate", "gen_fail_rate", "gen_nsfw_rate", "gen_cancel_rate")
_generation("gen_media_mix", "gen_video_count", "gen_image_count", "gen_video_ratio")
_generation(
    "gen_duration", "gen_duration_mean", "gen_duration_max", "gen_duration_sum", "gen_duration_std"
)
_generation(
    "gen_arc_buckets",
    *[f"gen_{q}_{m}" for q in generations.ARC_BUCKETS for m in ("count", "credits", "compl")],
)
_generation(
    "gen_credit_velocity",
    "gen_credit_early",
    "gen_credit_late",
    "gen_credit_vel_ratio",
    "gen_early_count",
    "gen_late_count",
)
_generation("gen_last3", "gen_last3_count", "gen_last3_frac")
_generation("gen_daily_slope", "gen_activity_slope")
_generation("gen_peak_day", "gen_peak_day")
_generation("gen_cliff", "gen_activity_cliff")
_generation("gen_first_latency", "gen_first_latency_h")
_generation("gen_completion_trend", "gen_compl_trend")
_generation("gen_video_credit_ratio", "gen_video_credit_ratio")


@query
def gen_incremental(spark, sf_dir):
    """All generation features from the states of four files, of which the last comes after a first build."""
    events, properties = _table(spark, sf_dir, "generations"), _table(spark, sf_dir, "properties")
    root, store = scratch_path(spark, "event-files"), scratch_path(spark, "states")
    paths = [f"{root}/{k}" for k in range(4)]
    for k, path in enumerate(paths):
        events.where(F.col("event_id") % 4 == k).write.parquet(path)
    read = lambda files: spark.read.parquet(*files)
    for wanted in (paths[:3], paths):
        found = incremental_features(spark, store, wanted, properties, read)
    return found


@query
def gen_window_filter(spark, sf_dir):
    """The arc restricted to events inside it instead of clipping them to its ends."""
    features = generations.generation_features(
        _table(spark, sf_dir, "generations"), _table(spark, sf_dir, "properties"), window="filter"
    )
    return features.select(KEY, "gen_total", "gen_days_active", "gen_q1_count", "gen_q4_count", "gen_peak_day")


def _transaction(name: str, source: Callable[[DataFrame], DataFrame], *columns: str) -> None:
    def fn(spark, sf_dir):
        return source(_table(spark, sf_dir, "transactions")).select(KEY, *columns)

    register(name, fn)


_transaction(
    "tx_core",
    transactions.from_rollup,
    "ta_total",
    "ta_failed_count",
    "ta_success_count",
    "ta_fail_rate",
    "ta_amount_total",
    "ta_amount_mean",
    "ta_amount_max",
)
_transaction("tx_failure_codes", transactions.from_rollup, *transactions.FAILURE_CODES)
_transaction(
    "tx_flags",
    transactions.from_rollup,
    *transactions.TOLERANT_FLAGS,
    *transactions.BOOLEAN_FLAGS,
    "ta_cvc_pass",
)
_transaction("tx_country_mismatch", transactions.from_rollup, "ta_ctry_mismatch")
_transaction("tx_last_failed", transactions.from_order, "ta_last_failed")
_transaction("tx_longest_fail_run", transactions.from_order, "ta_max_consec_fail")
_transaction("tx_max_retries", transactions.from_value_counts, "ta_max_retries")
_transaction("tx_modes", transactions.from_value_counts, *transactions.MODES)


@query
def purch_features(spark, sf_dir):
    return profile.purchase_features(_table(spark, sf_dir, "purchases"))


@query
def quiz_features(spark, sf_dir):
    return profile.quiz_features(_table(spark, sf_dir, "quizzes"))


@query
def assemble_features(spark, sf_dir):
    """All sources joined to the users, before zero-fill."""
    features = [f for f in names(BASE_FEATURES) if f not in names(COMPOSITE_FEATURES)]
    return join_sources(_tables(spark, sf_dir)).select(KEY, LABEL, *features)


@query
def assemble_bucketed(spark, sf_dir):
    """The same from tables stored in buckets of their user."""
    features = [f for f in names(BASE_FEATURES) if f not in names(COMPOSITE_FEATURES)]
    stored = {t: store_bucketed(df, bucket_name(t), buckets=8) for t, df in _tables(spark, sf_dir).items()}
    return join_sources(stored, bucketed=True).select(KEY, LABEL, *features)


def _zero_filled(spark, sf_dir):
    return zero_fill(join_sources(_tables(spark, sf_dir))).select(KEY, *zero_filled())


register("zero_fill", _zero_filled)


@query
def risk_composites(spark, sf_dir):
    filled = zero_fill(join_sources(_tables(spark, sf_dir)))
    return with_composites(filled).select(KEY, *names(PRESENCE_FEATURES), *names(COMPOSITE_FEATURES))


# --- folds, encodings, matrix --------------------------------------------------------------------


def _train_users(spark, sf_dir) -> DataFrame:
    return with_targets(_table(spark, sf_dir, "users").where(F.col("split") == "train"))


def _folds(spark, sf_dir):
    """Folds of the target encoding, both stages and the three-class model."""
    return training.fold_table(_train_users(spark, sf_dir))


register("stratified_folds", _folds)


def _categories(spark, sf_dir) -> DataFrame:
    """Users with the categorical properties and answers that are target-encoded."""
    tables = _tables(spark, sf_dir)
    return (
        tables["users"]
        .join(profile.property_features(tables["properties"]), KEY, "left")
        .join(profile.quiz_features(tables["quizzes"]), KEY, "left")
        .select(KEY, LABEL, "split", *TARGET_ENCODED)
    )


def _target_stats(spark, sf_dir) -> tuple[DataFrame, DataFrame, encode.TargetStats]:
    rows = materialize(_categories(spark, sf_dir), "categories")
    train = with_targets(rows.where(F.col("split") == "train"))
    folded = stratified_folds(train, KEY, "y", training.ENCODING_SEED)
    return folded, rows.where(F.col("split") == "test"), encode.target_stats(folded)


@query
def target_encode_oof(spark, sf_dir):
    train, _, stats = _target_stats(spark, sf_dir)
    return stats.out_of_fold(train).select(KEY, "fold", *TE_FEATURES)


@query
def target_encode_test(spark, sf_dir):
    _, test, stats = _target_stats(spark, sf_dir)
    return stats.full(test).select(KEY, *TE_FEATURES)


@query
def target_encode_nested(spark, sf_dir):
    """Encodings that leave out a row's fold of the encoding and its fold of the three-class model."""
    rows = materialize(_categories(spark, sf_dir), "categories")
    train = with_targets(rows.where(F.col("split") == "train"))
    folded = train.join(training.fold_table(train).select(KEY, "fold_te", "fold_mc"), KEY)
    stats = encode.target_stats(folded, "fold_te", second="fold_mc")
    return stats.nested(folded, "fold_te", "fold_mc").select(KEY, "fold_te", "fold_mc", *TE_FEATURES)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(feature_table(_tables(spark, sf_dir)), "features")


def _feature_splits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Feature tables of both splits, stored once for the query."""
    stored = stored_features(spark, sf_dir)
    split = lambda s: stored.where(F.col("split") == s).drop("split")
    return split("train"), split("test").drop(LABEL)


@query
def ordinal_encode(spark, sf_dir):
    columns = categorical()
    train, test = [encode.fill_categories(s) for s in _feature_splits(spark, sf_dir)]
    codes = encode.vocabulary([train, test], columns)
    both = train.select(KEY, *columns).unionByName(test.select(KEY, *columns))
    return encode.ordinal_encode(both, codes, columns)


@query
def feature_matrix(spark, sf_dir):
    """The 130 model inputs of both splits."""
    train, test = _feature_splits(spark, sf_dir)
    train, test = encode_splits(materialize(with_folds(train), "train-folds"), test)
    rounded = lambda df: df.select(
        KEY, *[seven_places(F.col(f)).alias(f) for f in MODEL_FEATURES]
    )
    both = rounded(train).unionByName(rounded(test))
    return encode.dense_matrix(both, MODEL_FEATURES, [KEY])


@query
def class_weights(spark, sf_dir):
    users = _train_users(spark, sf_dir)
    binary = training.class_weights(users, "is_churned", "unbalanced")
    three = training.class_weights(users, "y", "balanced")
    label = lambda df, scheme, c: df.select(
        F.lit(scheme).alias("scheme"), F.col(c).alias("class_id"), "n", "weight"
    )
    return label(binary, "unbalanced", "is_churned").unionByName(label(three, "balanced", "y"))


@query
def class_weights_by_fold(spark, sf_dir):
    """The weights that the fits of each fold use."""
    users = _train_users(spark, sf_dir)
    rows = users.join(training.fold_table(users), KEY)
    parts = []
    for scheme, label, fold in (("unbalanced", "is_churned", "fold_s1"), ("balanced", "y", "fold_mc")):
        known = training.class_weights(rows, label, scheme, fold)
        named = F.lit(scheme).alias("scheme"), F.col(fold).alias("fold"), F.col(label).alias("class_id")
        parts.append(known.select(*named, "n", "weight"))
    return parts[0].unionByName(parts[1])


# --- ensemble and metrics on scores derived from the user table ----------------------------------


def _hashed(multiplier: int, shift: int) -> Column:
    return (F.col(KEY) * multiplier + shift) % 1000


def _scores(spark, sf_dir, split: str) -> DataFrame:
    """Deterministic scores per user in place of model output; the labels come from the data."""
    a, b, c = _hashed(4801, 17), _hashed(3571, 331), _hashed(2909, 727)
    total = (a + b + c + 3).cast("double")
    users = with_targets(_table(spark, sf_dir, "users").where(F.col("split") == split))
    return stratified_folds(users, KEY, "y", training.MODEL_SEED).select(
        KEY,
        "y",
        "is_churned",
        "fold",
        (_hashed(7919, 104729).cast("double") / 1000.0).alias("s1"),
        (_hashed(6007, 15485).cast("double") / 1000.0).alias("s2"),
        ((a + 1).cast("double") / total).alias("m0"),
        ((b + 1).cast("double") / total).alias("m1"),
        ((c + 1).cast("double") / total).alias("m2"),
    )


def _oof(spark, sf_dir) -> DataFrame:
    """Training scores; stage 2 is known for churned users only."""
    scores = _scores(spark, sf_dir, "train")
    second = scores.where(F.col("is_churned") == 1)
    return ensemble.with_second_stage(scores.drop("s2"), second)


FIXED = ensemble.Tuning(0.44, 0.6, 1.1)


def _called(spark, sf_dir) -> DataFrame:
    return ensemble.probabilities(_oof(spark, sf_dir), FIXED)


@query
def label_distribution(spark, sf_dir):
    users = _train_users(spark, sf_dir)
    return metrics.class_distribution(users, "y").select(
        decode(F.col("y")).alias("label"), "y", "n"
    )


@query
def weighted_f1(spark, sf_dir):
    return metrics.weighted_f1(_called(spark, sf_dir))


@query
def fold_f1(spark, sf_dir):
    return metrics.binary_f1(_oof(spark, sf_dir), "is_churned", "s1", by=["fold"])


@query
def fold_report(spark, sf_dir):
    """F1 of the two stages and the three-class scores per fold."""
    rows = _scores(spark, sf_dir, "train").withColumn("is_invol", (F.col("y") == 2).cast("int"))
    scores = lambda df, *c: training.Scores(df.select(KEY, "fold", *c), df, [], ())
    churned = rows.where(F.col("is_churned") == 1)
    return training.fold_report(
        rows, scores(rows, "s1"), scores(churned, "s2"), scores(rows, *ensemble.MULTICLASS)
    )


@query
def classification_report(spark, sf_dir):
    return metrics.classification_report(_called(spark, sf_dir))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_called(spark, sf_dir))


@query
def cascade_proba(spark, sf_dir):
    softened = ensemble.soften(F.col("s1"), F.lit(FIXED.threshold))
    p0, p1, p2 = ensemble.cascade(softened, F.col("s2"))
    rows = _oof(spark, sf_dir).select(KEY, p0.alias("p0"), p1.alias("p1"), p2.alias("p2"))
    return rows.withColumn("pred", ensemble.first_argmax([F.col("p0"), F.col("p1"), F.col("p2")]))


def _swept(spark, sf_dir, grid: list[ensemble.Candidate], value: str) -> DataFrame:
    outcome = ensemble.sweep(_oof(spark, sf_dir), grid)
    return outcome.select("step", F.coalesce(value, F.lit(1.0)).alias("value"), "f1")


@query
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir, ensemble.threshold_grid(), "threshold")


@query
def alpha_sweep(spark, sf_dir):
    return _swept(spark, sf_dir, ensemble.alpha_grid(FIXED.threshold), "alpha")


@query
def vol_scale_sweep(spark, sf_dir):
    return _swept(spark, sf_dir, ensemble.scale_grid(FIXED.threshold, FIXED.alpha), "scale")


def _tuned_test(spark, sf_dir) -> DataFrame:
    tuning = ensemble.tune(materialize(_oof(spark, sf_dir), "oof"))
    return ensemble.probabilities(_scores(spark, sf_dir, "test"), tuning)


@query
def submission(spark, sf_dir):
    """Test classes under the tuning found on the training scores, through the CSV sink."""
    path = scratch_path(spark, "submission")
    write_csv(ensemble.submission(_tuned_test(spark, sf_dir)), path)
    return spark.read.schema(f"{KEY} bigint, {LABEL} string").option("header", True).csv(path)


@query
def predictions_proba(spark, sf_dir):
    """Test probabilities and classes, through the CSV sink."""
    table, path = ensemble.probability_table(_tuned_test(spark, sf_dir)), scratch_path(spark, "proba")
    write_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query
def predicted_distribution(spark, sf_dir):
    return metrics.class_distribution(ensemble.submission(_tuned_test(spark, sf_dir)), LABEL)


@query
def nested_f1(spark, sf_dir):
    """Weighted F1 with each fold called by the tuning of the others."""
    return ensemble.nested_f1(materialize(_oof(spark, sf_dir), "oof"))


# --- models --------------------------------------------------------------------------------------


def _frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return model_frames(*_feature_splits(spark, sf_dir))[:2]


def _one_feature(spark, sf_dir, feature: str) -> tuple[DataFrame, DataFrame]:
    """Vector frames of both splits with a single feature."""
    train, test = _feature_splits(spark, sf_dir)
    train = with_folds(train.select(KEY, LABEL, feature))
    carried = ["y", *TARGETS, *training.FOLD_COLUMNS]
    return (
        materialize(training.model_frame(train, carried, [feature]), "train-vectors"),
        materialize(training.model_frame(test, [], [feature]), "test-vectors"),
    )


def _both(scores: training.Scores) -> DataFrame:
    oof = scores.oof.withColumn("part", F.lit("oof"))
    test = scores.test.withColumns({"fold": F.lit(None).cast("int"), "part": F.lit("test")})
    return oof.unionByName(test)


def _exact(name: str, fit: Callable[..., training.Scores], feature: str, settings=EXACT) -> None:
    """Register a model of one split on one feature with two values."""

    def fn(spark, sf_dir):
        return _both(fit(*_one_feature(spark, sf_dir, feature), settings, features=[feature]))

    register(name, fn)


_exact("stage1_model", training.stage1, "qf_cost")
_exact("stage2_model", training.stage2, "has_purch")
_exact("multiclass_model", training.multiclass, "qf_cost")
_exact("multiclass_forest_model", training.multiclass, "has_purch", replace(EXACT, three_class="forest"))


def _structure(name: str, fit: Callable[..., training.Scores], outputs: Sequence[str]) -> None:
    """Register what holds for a model on all features: who is scored, and in which range."""

    def fn(spark, sf_dir):
        rows = _both(fit(*_frames(spark, sf_dir), SHALLOW))
        total = reduce(lambda x, y: x + y, [F.col(c) for c in outputs])
        within = reduce(lambda x, y: x & y, [F.col(c).between(0, 1) for c in outputs])
        whole = (F.abs(total - 1) < 1e-9) if len(outputs) > 1 else F.lit(True)
        return rows.groupBy("part", "fold").agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct(KEY).alias("users"),
            F.min(within.cast("int")).alias("in_range"),
            F.min(whole.cast("int")).alias("sums_to_one"),
        )

    register(name, fn)


_structure("stage1_structure", training.stage1, ["s1"])
_structure("stage2_structure", training.stage2, ["s2"])
_structure("multiclass_structure", training.multiclass, ensemble.MULTICLASS)


@query
def feature_importance(spark, sf_dir):
    """Importances of all 130 features of the three-class model, through the CSV sink."""
    table = training.importances(training.multiclass(*_frames(spark, sf_dir), SHALLOW))
    path = scratch_path(spark, "importances")
    write_csv(table.coalesce(1), path)
    back = spark.read.schema(table.schema).option("header", True).csv(path)
    total = back.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))
    rows = back.select("feature", (F.col("importance") >= 0).alias("not_negative"))
    return rows.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")


@query
def importance_splits(spark, sf_dir):
    """Splits, rows and gain per feature over the nodes of saved models of one split on one feature."""
    scores = training.stage1(*_one_feature(spark, sf_dir, "qf_cost"), EXACT, features=["qf_cost"])
    return scores.split_importances().select("feature", "importance", "splits", "rows", "gain")


@query
def best_rounds(spark, sf_dir):
    """Rounds kept with patience, over curves of mean event costs in place of held-out losses."""
    events = _table(spark, sf_dir, "generations")
    round_ = (F.col("event_id") % 40 + 1).cast("int")
    fold = (F.col(KEY) % 5).cast("int")
    curves = events.groupBy(fold.alias("fold"), round_.alias("round")).agg(F.avg("credit_cost").alias("loss"))
    curves = materialize(curves.withColumn("member", F.lit(0)), "curves")
    parts = [boosting.best_rounds(curves, p).withColumn("patience", F.lit(p)) for p in (1, 3, 8, 100)]
    return reduce(DataFrame.unionByName, parts)


@query
def top_importances(spark, sf_dir):
    """The report of the top features, over the share of users with a value in place of model output."""
    shares = [F.avg((F.col(c) != 0).cast("double")).alias(c) for c in zero_filled()]
    ranked = stored_features(spark, sf_dir).agg(*shares).unpivot([], zero_filled(), "feature", "importance")
    return training.top_features(ranked)


# --- analytics -----------------------------------------------------------------------------------


def _features_once(spark, sf_dir) -> DataFrame:
    """The feature table for one pass: what the pass does not read is not computed."""
    return feature_table(_tables(spark, sf_dir))


@query
def class_profile(spark, sf_dir):
    return analytics.class_profile(_features_once(spark, sf_dir))


@query
def daily_activity_by_class(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return analytics.daily_activity_by_class(t["users"], t["generations"], t["properties"])


@query
def risk_lift(spark, sf_dir):
    return analytics.risk_lift(_features_once(spark, sf_dir))


@query
def top_risk_countries(spark, sf_dir):
    return analytics.top_risk_countries(_features_once(spark, sf_dir))


@query
def churn_reasons(spark, sf_dir):
    """Reasons and actions of the test users, for the class called by the tuned scores."""
    features = stored_features(spark, sf_dir)
    certain = F.greatest("p0", "p1", "p2").alias("certain")
    called = _tuned_test(spark, sf_dir).select(KEY, decode(F.col("pred")).alias("called"), certain)
    risky = analytics.top_risk_countries(features)
    return analytics.churn_reasons(features.join(called, KEY), "called", risky, probability="certain")


@query
def intervention_triggers(spark, sf_dir):
    return analytics.intervention_triggers(stored_features(spark, sf_dir), _events(spark, sf_dir))
