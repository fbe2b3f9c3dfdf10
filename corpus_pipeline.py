"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, near_dup, packing, toxicity
from tidemark.llm.queries import fold, table
from tidemark.session import configure, remove, scratch_path, scratch_space


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", size)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from the labels, scores below 0.5."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, machine).where("score < 0.5").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; copies are left to the next stage."""
    configure(spark)
    return _sized(line_dedup.remove_boilerplate(docs, keep_copies=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of repeated rows one."""
    configure(spark)
    gone = near_dup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    return left.dropDuplicates(["doc_id", "text"])


def scrub_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the passages of benchmark items cut out of their texts."""
    return _sized(decontam.scrub(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dup", drop_near_duplicates),
    ("decontamination", scrub_benchmark),
    ("packing", pack),
]

#: The first stage is a fitted model, so the rows have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every stage reads what the one before it has written.

    Scratch tables go with their stage, and a stage's output once the next one is written. What the last
    stage reads and writes stays, since its rows are still to be read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_space(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
