"""Removal of boilerplate lines that many sites share, with DataFrame functions only.

A line on at least ``min_sites`` distinct sites is removed wherever it occurs, also if nothing else of the
text is left.

``keep_copies`` is for tables that still hold copies and are rid of them later: a text that has equal copies
on several sites then keeps the lines that are on so many sites by copies only. For those each copied text counts
once, beside the sites that have the line in a text of their own. So copies of a page do not make its
lines boilerplate and empty the page.

Lines with enough occurrences get HyperLogLog sketches of their sites; partial sketches merge by
aggregation, so a line that occurs everywhere costs two sketches a task. Lines whose estimate is near the
threshold get an exact distinct count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

MIN_SITES = 10
#: 2 ** LG_K registers: a standard error of 1.6 %. Estimates within MARGIN of the threshold are checked.
LG_K = 12
MARGIN = 0.15
_BLANK = " \t\r"


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(docs: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """Lines of any length that are not blank: document, its text's digest, position, site and digest."""
    rows = docs.select(
        F.col(key).alias("key"),
        _digest(F.col(text)).alias("whole"),
        F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("at", "raw"),
    )
    line = F.btrim("raw", F.lit(_BLANK))
    rows = rows.withColumn("line", line).where("line <> ''")
    return rows.select("key", "whole", "at", "site", _digest(F.col("line")).alias("line"))


def _sketched(site: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(site, LG_K))


def _counts(rows: DataFrame, count: Callable[[Column], Column], keep_copies: bool) -> DataFrame:
    """``line``, its ``sites``, and ``places``, where copied texts count once with ``keep_copies``.

    ``count`` counts distinct sites.
    """
    rows = rows.where("site IS NOT NULL")
    sites = rows.groupBy("line").agg(count(F.col("site")).alias("sites"))
    if not keep_copies:
        return sites.withColumn("places", F.col("sites"))
    texts = rows.groupBy("line", "whole").agg(F.min("site").alias("lo"), F.max("site").alias("hi"))
    copied = F.col("lo") != F.col("hi")
    texts = texts.groupBy("line").agg(
        count(F.when(~copied, F.col("lo"))).alias("own"), F.count_if(copied).alias("copied")
    )
    return sites.join(texts, "line").select("line", "sites", (F.col("own") + F.col("copied")).alias("places"))


def spread_lines(lines: DataFrame, min_sites: int, keep_copies: bool = False) -> DataFrame:
    """The ``line`` digests found on at least ``min_sites`` distinct sites. Null is no site.

    ``wide`` says that this holds too where copied texts count once; without ``keep_copies`` it always does.
    """
    often = lines.groupBy("line").agg(
        F.count("site").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi")
    )
    # The number of sites is at most the number of occurrences.
    often = often.where((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1)))
    # As a table, so that the join below can split the rows of a very frequent line.
    often = materialize(often, "frequent-lines")
    seen = lines.select("line", "whole", "site").join(often.select("line"), "line")
    sketches = materialize(_counts(seen, _sketched, keep_copies), "line-sites")
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    sure = (F.col("sites") > high) & ~F.col("places").between(low, high)
    near = sketches.where((F.col("sites") >= low) & ~sure).select("line")
    exact = _counts(lines.join(near, "line", "left_semi"), F.count_distinct, keep_copies)
    counts = sketches.where(sure).union(exact.where(F.col("sites") >= min_sites))
    return counts.select("line", (F.col("places") >= min_sites).alias("wide"))


def _removed(lines: DataFrame, spread: DataFrame, keep_copies: bool) -> DataFrame:
    """The rows of ``lines`` that go."""
    found = lines.join(spread, "line")
    if not keep_copies:
        return found
    narrow = found.where("NOT wide")
    texts = narrow.groupBy("line", "whole").agg(F.min("site").alias("lo"), F.max("site").alias("hi"))
    copied = texts.where("lo <> hi").select("line", "whole")
    return found.where("wide").union(narrow.join(copied, ["line", "whole"], "left_anti").select(found.columns))


def _marked(docs: DataFrame, key: str, site: str, text: str, min_sites: int, keep_copies: bool) -> DataFrame:
    """``row`` with the input columns, ``lines`` of the text, and ``drop``, positions to remove or null."""
    lines = materialize(_lines(docs, key, site, text), "lines")
    spread = materialize(spread_lines(lines, min_sites, keep_copies), "spread-lines")
    drops = _removed(lines, spread, keep_copies).groupBy("key", "whole").agg(F.collect_set("at").alias("drop"))
    drops = drops.select(F.col("key").alias("k"), F.col("whole").alias("w"), "drop")
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.col(f"row.{key}")).withColumn("whole", _digest(F.col("text")))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("whole") == F.col("w"))
    marked = rows.join(drops, same, "left")
    return marked.select("row", "text", F.split("text", "\n").alias("lines"), "drop")


def _kept_text() -> Column:
    """The lines left, joined again; texts without a removal stay as they are."""
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(left, lambda at: F.element_at("lines", at + 1)), "\n")
    return F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept)


def remove_boilerplate(
    docs: DataFrame,
    key: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    keep_copies: bool = False,
) -> DataFrame:
    """``docs`` with the same rows and columns, where boilerplate lines are taken out of the text.

    Null texts stay null and empty ones empty. Rows without a site do not count for the spread, but lose
    the lines too. Repeated rows stay repeated. A text of nothing but boilerplate becomes empty; its row
    stays. An empty table gives no rows. ``keep_copies`` spares lines that are widespread by copies of a whole
    text only.
    """
    marked = _marked(docs, key, site, text, min_sites, keep_copies)
    cleaned = F.col("row").withField(text, _kept_text())
    return marked.select(cleaned.alias("row")).select("row.*")


def boilerplate_report(
    docs: DataFrame,
    key: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    keep_copies: bool = False,
) -> DataFrame:
    """One row per document: ``key``, ``n_lines``, ``n_removed`` and the text that is left.

    Null has 0 lines and stays null, an empty text one empty line. Repeated rows stay repeated, an empty
    table gives no rows, other columns are not read.
    """
    marked = _marked(docs, key, site, text, min_sites, keep_copies)
    return marked.select(
        F.col(f"row.{key}").alias(key),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_removed"),
        _kept_text().alias("text"),
    )
