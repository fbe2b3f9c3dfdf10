"""The registered queries of the operators: whole tables in, the agreed columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    collocations,
    decontam,
    host_quality,
    langid,
    line_dedup,
    merkle,
    near_dup,
    packing,
    suffix_repeats,
    toxicity,
    url_filter,
    warc,
)
from tidemark.llm.oracles import ORACLES
from tidemark.session import configure

__all__ = ["ORACLES", "QUERIES", "URL_RULES", "fold", "table"]

#: Host, path and verdict of the listed rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The columns that a leaf of the manifest hashes, in this order.
MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, in a session that splits skewed joins even if that costs another shuffle."""
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, number: int) -> Column:
    """The fold of a document: a checksum of its key's decimal digits."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % number


def op1_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return host_quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return langid.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_repeats.repeats(table(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), keep_ids=False)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontam.contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    machine = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, machine, columns=["doc_id"]).select("row.doc_id", "score")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.boilerplate_report(table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(table(spark, folder, "documents"), packed=True))
    return tokens.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.coalesce(fold("doc_id", 2) == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(table(spark, folder, "documents"), MANIFEST_COLUMNS, {"text": text})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_host_quality,
        op2_language_id,
        op3_suffix_repeats,
        op4_packing,
        op5_decontamination,
        op6_toxicity,
        op7_near_dup,
        op8_warc,
        op9_line_dedup,
        op10_url_filter,
        op11_collocations,
        op12_bpe,
        op13_merkle_manifest,
    )
}
