"""The whole run: features, encodings, models, tuning, reports and files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import decode, with_targets
from tidemark.functions.numeric import first_argmax
from tidemark.plans import analytics, encode, ensemble, metrics, training
from tidemark.plans.assemble import feature_table
from tidemark.schemas import KEY, LABEL, TARGETS, categorical
from tidemark.session import configure, materialize, scratch_space
from tidemark.sources.csv import FOLDERS, Checked, check_contracts, load_split, split_paths, store_checked
from tidemark.sources.sinks import write_csv
from tidemark.sources.store import build_or_load


@dataclass(frozen=True)
class Outcome:
    """What a run reports. ``tuning`` holds the F1 of each sweep, ``multiclass_f1`` that of the three-class
    model alone, ``predicted`` the distribution of the classes called on the test users, ``splits`` the features by their number
    of splits, ``rounds`` what each model keeps."""

    tuning: ensemble.Tuning
    f1: float
    nested_f1: float
    multiclass_f1: float
    classes: DataFrame
    predicted: DataFrame
    fold_f1: DataFrame
    report: DataFrame
    confusion: DataFrame
    importances: DataFrame
    splits: DataFrame
    rounds: DataFrame
    submission: DataFrame
    probabilities: DataFrame
    reasons: DataFrame


def reject_counts(spark: SparkSession, parsed: Mapping[str, Checked]) -> DataFrame:
    """Per table the rows read and what was wrong with them, as counted while parsing."""
    names = ("rows", "broken", "keyless", "unread")
    rows = [(t, *[c.counts[n] for n in names]) for t, c in parsed.items()]
    return spark.createDataFrame(rows, "table string, " + ", ".join(f"{n} long" for n in names))


def features(
    spark: SparkSession,
    root: str,
    split: str,
    store: str,
    scan: Mapping | None = None,
    part: str = "features",
    **options,
) -> DataFrame:
    """Stored feature table of a split of CSV files, built if its inputs or options are new.

    ``scan`` are options of the CSV scan, the others those of the feature table. ``part`` may be "rejects", the problems of
    the input by table and row, or "counts", their numbers.
    """
    scan = dict(scan or {})

    def build() -> tuple[DataFrame, dict[str, DataFrame]]:
        # Events and attempts are read several times, so the text is parsed once and kept as columns.
        found = load_split(spark, root, split, checked=True, **scan)
        parsed = {t: store_checked(df, f"{split}-{t}") for t, df in found.items()}
        tables = {t: c.rows for t, c in parsed.items()}
        check_contracts(tables)
        rejects = [
            c.rejects.select(F.lit(t).alias("table"), F.col(KEY).cast("string").alias("key"), "reason", "column", "text")
            for t, c in parsed.items()
        ]
        return feature_table(tables, **options), {
            "rejects": reduce(DataFrame.unionByName, rejects),
            "counts": reject_counts(spark, parsed),
        }

    folders = scan.get("folders", FOLDERS)
    paths = list(split_paths(root, split, folders).values())
    with scratch_space(spark):
        return build_or_load(spark, store, split, paths, build, {"scan": scan, "features": options}, part)


def with_folds(train: DataFrame, key: str = KEY) -> DataFrame:
    """Add targets and all fold columns; the wide rows move once, by key."""
    labelled = with_targets(train)
    return labelled.join(training.fold_table(labelled, key), key)


def encode_splits(
    train: DataFrame, test: DataFrame, encoding: str = "own", key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """Add target encodings and replace categories by codes; ``train`` carries targets and folds.

    Target encoding comes first: it leaves missing categories missing. ``encoding`` names the folds that it leaves
    out: its "own", those "shared" with the three-class model, or both ("nested").
    """
    if encoding not in ("own", "shared", "nested"):
        raise ValueError(f"encoding must be 'own', 'shared' or 'nested', not {encoding!r}")
    columns = categorical()
    codes = encode.vocabulary([encode.fill_categories(s, columns) for s in (train, test)], columns)
    fold, second = "fold_mc" if encoding == "shared" else "fold_te", "fold_mc" if encoding == "nested" else None
    stats = encode.target_stats(train, fold, second=second)
    return (
        encode.encode_all(train, codes, stats, columns, fold, key, second),
        encode.encode_all(test, codes, stats, columns, key=key),
    )


def model_frames(
    train: DataFrame,
    test: DataFrame,
    key: str = KEY,
    declare_categories: bool = False,
    encoding: str = "own",
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Encoded splits as stored vector frames with targets and folds, and the sizes of declared categories.

    By default codes are ordinary numbers to the trees; ``declare_categories`` marks them as categories.
    """
    train, test = encode_splits(materialize(with_folds(train, key), "train-folds"), test, key=key)
    sizes = training.category_sizes([train, test], categorical()) if declare_categories else {}
    carried = ["y", *TARGETS, *training.FOLD_COLUMNS]
    return (
        materialize(training.model_frame(train, carried, key=key, sizes=sizes), "train-vectors"),
        materialize(training.model_frame(test, [], key=key, sizes=sizes), "test-vectors"),
        sizes,
    )


def fit_and_report(
    train: DataFrame,
    test: DataFrame,
    settings: training.Settings = training.Settings(),
    parity: bool = False,
    key: str = KEY,
    models: str | None = None,
) -> Outcome:
    """Train the three models on feature tables, tune the ensemble, report and predict.

    Fitted folds are kept below ``models``, if given, and found there by a run that was interrupted.
    """
    fit_on, predict_on, sizes = model_frames(train, test, key, settings.declare_categories, settings.encoding)
    settings = replace(settings, bins=max([settings.bins, *sizes.values()]))
    s1 = training.stage1(fit_on, predict_on, settings, key=key, store=models)
    s2 = training.stage2(fit_on, predict_on, settings, key=key, store=models)
    mc = training.multiclass(fit_on, predict_on, settings, key=key, store=models)
    oof = materialize(training.oof_scores(fit_on, s1, s2, mc, parity, key), "oof-scores")
    unseen = materialize(training.test_scores(s1, s2, mc, key), "test-scores")
    tuning = ensemble.tune(oof)
    called = ensemble.probabilities(oof, tuning)
    scored = ensemble.probabilities(unseen, tuning)
    alone = oof.withColumn("pred", first_argmax([F.col(m) for m in ensemble.MULTICLASS]))
    certain = F.greatest("p0", "p1", "p2").alias("probability")
    explained = test.join(scored.select(key, decode(F.col("pred")).alias("called"), certain), key)
    return Outcome(
        tuning=tuning,
        f1=metrics.weighted_f1(called).first()["f1"],
        nested_f1=ensemble.nested_f1(oof).first()["f1"],
        multiclass_f1=metrics.weighted_f1(alone).first()["f1"],
        classes=metrics.class_distribution(train, LABEL),
        predicted=metrics.class_distribution(ensemble.submission(scored, key), LABEL),
        fold_f1=training.fold_report(fit_on, s1, s2, mc, key),
        report=metrics.classification_report(called),
        confusion=metrics.confusion_matrix(called),
        importances=training.importances(mc),
        splits=mc.split_importances(),
        rounds=reduce(
            DataFrame.unionByName,
            [m.rounds().select(F.lit(n).alias("model"), "*") for n, m in (("stage1", s1), ("stage2", s2), ("multiclass", mc))],
        ),
        submission=ensemble.submission(scored, key),
        probabilities=ensemble.probability_table(scored, key),
        reasons=analytics.churn_reasons(
            explained, "called", analytics.top_risk_countries(train), key, "probability"
        ),
    )


def run(
    spark: SparkSession,
    root: str,
    store: str,
    out: str,
    settings: training.Settings = training.Settings(),
    parity: bool = False,
    scan: Mapping | None = None,
    **options,
) -> Outcome:
    """CSV folders in, CSV folders out: importances, submission, probabilities, and the reports as Parquet.

    ``scan`` reaches the CSV reader (``timestamp_format``, ``multi_line``, ``mode``, ``folders``); ``parity`` also
    reads "NA" as missing there. Tables of the outcome are read back from ``out``, and the scratch tables of the
    run are removed.
    """
    configure(spark)
    scan = {"parity": parity, **(scan or {})}
    train = features(spark, root, "train", store, scan, **options)
    test = features(spark, root, "test", store, scan, **options)
    files = {"importances": "feature_importance", "submission": "submission", "probabilities": "predictions_proba"}
    with scratch_space(spark):
        outcome = fit_and_report(train, test, settings, parity, models=f"{store}/models")
        tables = {f.name: getattr(outcome, f.name) for f in fields(outcome)}
        tables = {name: df for name, df in tables.items() if isinstance(df, DataFrame)}
        for name, df in tables.items():
            if name in files:
                write_csv(df.coalesce(1) if name == "importances" else df, f"{out}/{files[name]}")
            else:
                df.write.mode("overwrite").parquet(f"{out}/reports/{name}")
    kept = {
        name: spark.read.schema(df.schema).option("header", True).csv(f"{out}/{files[name]}")
        if name in files
        else spark.read.parquet(f"{out}/reports/{name}")
        for name, df in tables.items()
    }
    return replace(outcome, **kept)
