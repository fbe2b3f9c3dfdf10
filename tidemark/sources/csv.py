"""Typed CSV scans, split resolution and input contracts."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.nulls import nan_to_null
from tidemark.functions.time import parse
from tidemark.schemas import CLASSES, COUNTRY_COLUMNS, KEY, LABEL, SEQUENCE, TABLES, UNIQUE
from tidemark.session import materialize

# Text that stands for a missing value.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# Folder per split and file suffix per table, behind the prefix "<split>_users".
FOLDERS = {"train": "Train Data", "test": "Test Data"}
SUFFIXES = {
    "users": "",
    "generations": "_generations",
    "properties": "_properties",
    "purchases": "_purchases",
    "quizzes": "_quizzes",
    "transactions": "_transaction_attempts_v1",
}


def split_paths(root: str, split: str, folders: Mapping[str, str] = FOLDERS) -> dict[str, str]:
    """CSV path of every table of a split."""
    return {t: f"{root}/{folders[split]}/{split}_users{s}.csv" for t, s in SUFFIXES.items()}


def _from_text(column: T.StructField, parity: bool, timestamp_format: str | None) -> Column:
    tokens = NULL_TOKENS
    if column.name in COUNTRY_COLUMNS and not parity:
        tokens = tuple(t for t in tokens if t != "NA")  # the code of Namibia
    raw = F.col(f"`{column.name}`")
    text = F.when(~raw.isin(*tokens), raw)
    if isinstance(column.dataType, T.TimestampNTZType):
        return parse(text, timestamp_format)
    return text if isinstance(column.dataType, T.StringType) else text.try_cast(column.dataType)


def _typed(
    column: T.StructField, given: T.DataType, parity: bool, timestamp_format: str | None
) -> Column:
    if isinstance(given, T.StringType):
        value = _from_text(column, parity, timestamp_format)
    else:
        value = F.col(f"`{column.name}`").cast(column.dataType)
    return nan_to_null(value) if isinstance(column.dataType, T.DoubleType) else value


_PROBLEM = "struct<reason: string, column: string, text: string>"
_LINE = "_line"
PROBLEMS = "_problems"
#: Why something of the input is not among the typed values.
BROKEN, KEYLESS, UNREAD = "broken line", "no key", "not converted"


def _problems(raw: DataFrame, table: str, fields: list[T.StructField], parity: bool, timestamp_format: str | None) -> Column:
    """What is wrong with a row: a line with another number of fields, no key, texts that no type could be made of."""

    def problem(when: Column, reason: str, column: str | None, text: Column) -> Column:
        made = F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column"), text.cast("string").alias("text"))
        return F.when(when, made)

    found = []
    if _LINE in raw.columns:
        found.append(problem(F.col(_LINE).isNotNull(), BROKEN, None, F.col(_LINE)))
    for f in fields:
        own, given = F.col(f"`{f.name}`"), raw.schema[f.name].dataType
        value = _typed(f, given, parity, timestamp_format)
        if f.name == KEY:
            found.append(problem(value.isNull(), KEYLESS, f.name, own))
        elif isinstance(given, T.StringType) and not isinstance(f.dataType, T.StringType):
            found.append(problem(value.isNull() & ~own.isin(*NULL_TOKENS), UNREAD, f.name, own))
    return F.filter(F.array(*found).cast(f"array<{_PROBLEM}>"), lambda p: p.isNotNull())


def conform(
    raw: DataFrame, table: str, parity: bool = False, timestamp_format: str | None = None, checked: bool = False
) -> DataFrame:
    """Pick the declared columns by name, null the missing-value tokens, convert, drop rows without key.

    Text that does not convert becomes null; columns that already have a type are only cast, so typed
    sources such as Parquet pass through here as well. ``parity`` reads "NA" as missing in country columns too.
    The label is optional; any other absent column is an error. ``checked`` keeps rows without key and says in a further
    column what is wrong with a row.
    """
    absent = [c for c in TABLES[table].names if c not in raw.columns and c != LABEL]
    if absent:
        raise ValueError(f"table {table} lacks {', '.join(absent)}")
    fields = [f for f in TABLES[table].fields if f.name in raw.columns]
    typed = [
        _typed(f, raw.schema[f.name].dataType, parity, timestamp_format).alias(f.name) for f in fields
    ]
    carried = [SEQUENCE[table]] if SEQUENCE.get(table) in raw.columns else []
    if checked:
        return raw.select(*typed, *carried, _problems(raw, table, fields, parity, timestamp_format).alias(PROBLEMS))
    return raw.select(*typed, *carried).where(F.col(KEY).isNotNull())


def file_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and its ``number`` in the order of names; from the listing alone, one row a file."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = sorted(r[0] for r in listing.select("_metadata.file_path").collect())
    # From Arrow it is a local relation of known size, so that Catalyst can send it to the scan.
    numbers = pa.table({"file": pa.array(names, pa.string()), "number": pa.array(range(len(names)), pa.int32())})
    return spark.createDataFrame(numbers)


def _with_file_order(raw: DataFrame, name: str, path: str) -> DataFrame:
    """Position of a row in its input, comparable across the splits of a scan: three numbers.

    The path of a row meets the numbered listing in the scan's own stage; only the number goes on.
    """
    placed = raw.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_row": F.monotonically_increasing_id(),
    })
    numbers = file_numbers(raw.sparkSession, path)
    found = placed.join(numbers, F.col("_file") == F.col("file"), "left")
    order = F.struct(F.col("number").alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row"))
    return found.select(*raw.columns, order.alias(name))


def scan(
    spark: SparkSession,
    path: str,
    table: str,
    parity: bool = False,
    timestamp_format: str | None = None,
    multi_line: bool = False,
    mode: str = "PERMISSIVE",
    checked: bool = False,
) -> DataFrame:
    """One typed input table; every value is read as text first, so no inference pass is needed.

    Tables whose row order matters get a sequence column from the file position unless they have one.
    ``multi_line`` admits line breaks inside quotes at the price of unsplittable files. Lines with too many
    or too few fields are cut or padded; ``mode="FAILFAST"`` refuses them. ``checked`` is that of ``conform`` and finds
    such lines too.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "mode": mode}
    named = spark.read.options(**options).csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType()) for name in named])
    # Every file is held against these names, so parts in another column order fail.
    if checked:
        # All fields of a line must be parsed to see whether there are as many as there should be.
        options |= {"columnNameOfCorruptRecord": _LINE, "columnPruning": False}
        text = text.add(_LINE, T.StringType())
    raw = spark.read.options(**options, enforceSchema=False).schema(text).csv(path)
    if table in SEQUENCE and SEQUENCE[table] not in raw.columns:
        raw = _with_file_order(raw, SEQUENCE[table], path)
    elif table in SEQUENCE:
        raw = raw.withColumn(SEQUENCE[table], _orderable(F.col(SEQUENCE[table])))
    return conform(raw, table, parity, timestamp_format, checked)


@dataclass(frozen=True)
class Checked:
    """A stored table, what was wrong with its rows, and how often.

    ``rejects`` has a row per problem: reason, column, the text as it was given, and the key of the row. ``counts`` were taken
    in the pass that parsed the text.
    """

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def store_checked(df: DataFrame, name: str) -> Checked:
    """Store a checked scan and split it: typed rows with a key, and the problems of all rows.

    Rows with a text that did not convert stay, with null in its place, and so do broken lines, padded or cut.
    """
    has = lambda reason: F.exists(PROBLEMS, lambda p: p["reason"] == reason)
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has(BROKEN)).alias("broken"),
        F.count_if(has(KEYLESS)).alias("keyless"),
        F.sum(F.size(F.filter(PROBLEMS, lambda p: p["reason"] == UNREAD))).alias("unread"),
    )
    stored = materialize(watched, name)
    problems = stored.where(F.size(PROBLEMS) > 0).select(KEY, F.inline(PROBLEMS))
    counts = {k: v or 0 for k, v in seen.get.items()}
    return Checked(stored.where(F.col(KEY).isNotNull()).drop(PROBLEMS), problems, counts)


def _orderable(sequence: Column) -> Column:
    """A sequence given as text: whole numbers in their order, then other text in its own."""
    number = sequence.try_cast("long")
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), sequence.alias("text"))


def load_split(
    spark: SparkSession, root: str, split: str, folders: Mapping[str, str] = FOLDERS, **options
) -> dict[str, DataFrame]:
    """All six tables of a split; ``options`` are those of ``scan``."""
    return {t: scan(spark, p, t, **options) for t, p in split_paths(root, split, folders).items()}


def assert_unique(df: DataFrame, *keys: str) -> None:
    """Fail if a key repeats; runs one partially aggregated count."""
    keys = keys or (KEY,)
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys).limit(3).collect()
    if repeated:
        raise ValueError(f"{', '.join(keys)} repeats, for example {[tuple(r) for r in repeated]}")


def assert_labels(users: DataFrame) -> None:
    """Fail on a missing or unknown class, which no fold could hold."""
    known = F.coalesce(F.col(LABEL).isin(*CLASSES), F.lit(False))
    odd = users.where(~known).select(LABEL).limit(3).collect()
    if odd:
        raise ValueError(f"{LABEL} has values outside {CLASSES}, for example {[r[0] for r in odd]}")


def check_contracts(tables: Mapping[str, DataFrame], key: str = KEY) -> None:
    """Tables with one row per user must not fan out the joins, the sequence of a user's rows must order
    them, and labels must be known classes."""
    for table in UNIQUE:
        assert_unique(tables[table], key)
    for table, sequence in SEQUENCE.items():
        if table in tables:
            assert_unique(tables[table], key, sequence)
    if LABEL in tables["users"].columns:
        assert_labels(tables["users"])
