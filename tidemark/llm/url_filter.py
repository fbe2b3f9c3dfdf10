"""Filtering of URLs by listed hosts and paths, with DataFrame functions only.

A listed entry is a host and the beginning of a path. A URL has few entries that can fit it: the ends of
its host at the dots, with the beginnings of its path of the lengths that the list has. A blocked Bloom filter of
the list, a table of 64-bit words by block, takes out nearly all that are not listed; an exact join removes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ENTRY = 16
BITS_SET = 4
FEWEST_BLOCKS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null or a URL without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks).cast("long"))


def _mask(entry: Column) -> Column:
    """``BITS_SET`` bits of a word, from another hash than the block's."""
    code = F.xxhash64(entry, F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(BITS_SET):
        bit = F.shiftright(code, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """``block`` and ``word``, the bits of all entries that fall into the block; empty blocks have no row."""
    words = entries.select(_block(F.col("entry"), blocks).alias("block"), _mask(F.col("entry")).alias("bits"))
    return words.groupBy("block").agg(F.bit_or("bits").alias("word"))


def possible(tried: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``tried`` whose ``entry`` may be listed: all bits of it are set in its block's word."""
    mask = _mask(F.col("entry"))
    rows = tried.withColumn("block", _block(F.col("entry"), blocks)).join(words, "block")
    return rows.where(F.col("word").bitwiseAND(mask) == mask).select(tried.columns)


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule`` (host and path of it) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all below it if the URL's path
    begins with the rule's. The longest rule wins, among equally long ones that with the longer host; a
    rule listed twice counts with its smallest verdict. Without a rule the verdict is ``default``: such a URL is
    not listed. Null and malformed URLs have empty host and path; other columns are not read. Repeated rows are
    judged alike and stay; no pages give no rows, no rules the default for all. The filter grows with the list and
    is joined by block, so Spark broadcasts a short one and shuffles a long one.
    """
    listed = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path"), "verdict"
    ).where("host IS NOT NULL AND path IS NOT NULL")
    listed = listed.groupBy(F.concat("host", "path").alias("entry")).agg(
        F.min("verdict").alias("verdict"),
        F.max(F.length("host")).alias("host_size"),
        F.max(F.size(F.split("host", "\\."))).alias("labels"),
        F.max(F.length("path")).alias("path_size"),
    )
    shape = listed.agg(
        F.count("*").alias("n"), F.max("labels").alias("labels"), F.collect_set("path_size").alias("sizes")
    ).first()
    blocks = max(FEWEST_BLOCKS, shape["n"] * BITS_PER_ENTRY // 64)

    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    # A verdict depends on host and path alone.
    names = rows.select("host", "path").distinct().withColumn("labels", F.split("host", "\\."))
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(shape["labels"] or 1))),
        lambda n: F.array_join(F.slice("labels", -n, n), "."),
    )
    sizes = F.array(*[F.lit(n) for n in sorted(shape["sizes"])]).cast("array<int>")
    starts = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    tried = F.flatten(F.transform(ends, lambda end: F.transform(starts, lambda start: F.concat(end, start))))
    tried = names.select("host", "path", F.explode(tried).alias("entry"))
    fits = possible(tried, bloom_filter(listed, blocks), blocks).join(listed, "entry")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("entry").alias("size"), "host_size", "entry", "verdict")).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("best.entry").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
