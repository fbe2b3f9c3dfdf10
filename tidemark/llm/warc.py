"""WARC archives: writing captures of pages and assembling them again.

A capture is a transaction of three records: the response (or a revisit that refers to an equal
payload), and a request and metadata that name it by ``WARC-Concurrent-To``. Records are strings, so
Spark's text writer makes the archives, with the blank lines between records as its separator. Reading goes by
``Content-Length``, since a payload may hold any separator.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.textops import small_batches
from tidemark.session import materialize, scratch_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 9000
#: An archive is read as one value, so its bytes before compression are bounded too.
ARCHIVE_BYTES = 64 << 20
#: Captures below 2 ** 14 bytes count as that; the headers of one take less than ``HEAD_BYTES``.
SMALLEST = 14
HEAD_BYTES = 4096
#: About so many pages of one key and payload are numbered together.
TOGETHER = 1000
SEED = 8
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record_id(*parts: Column) -> Column:
    code = F.md5(F.concat_ws("\x1f", *parts))
    cut = [F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def captures(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Each page with the digest and size of its payload, the page that it revisits, if any, and its ``id``.

    Only narrow rows are grouped by digest; payloads move at most to meet a large table of marks. Pages of one key
    and payload need different ids: those that repeat are numbered in ``spread`` parts of about ``TOGETHER`` rows,
    and the first row of part 0 has the id that revisits name.
    """
    rows = pages.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"),
        F.col(key).alias("order"),
        F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
        F.rand(SEED).alias("at"),
    )
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    known = rows.groupBy("name", "digest").agg(
        F.max("order").alias("order"), F.max("size").alias("size"), F.count("*").alias("n")
    )
    known = materialize(known, "payloads")
    groups = known.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("order").alias("last"), F.count("*").alias("names")
    )
    # A key that is alone with its payload refers to nothing; neither do payloads without any key.
    groups = groups.where("names > 1 AND last IS NOT NULL").select("digest", "last")
    marks = known.join(groups, "digest", "left").select(
        "name",
        "digest",
        F.when(F.col("order").isNull() | (F.col("order") != F.col("last")), F.col("last").cast("string")).alias("refers"),
        F.ceil(F.col("n") / TOGETHER).alias("spread"),
        (F.col("n") > 1).alias("repeated"),
    )
    marks = materialize(marks.where("refers IS NOT NULL OR repeated"), "marks")
    rows = rows.join(marks, ["name", "digest"], "left")
    repeated = F.coalesce("repeated", F.lit(False))
    ids = _record_id(F.col("name"), F.col("digest"), F.lit("1"))
    out = rows.where(~repeated).withColumn("id", ids)
    if not marks.where("repeated").isEmpty():
        part = F.floor(F.col("at") * F.col("spread"))
        number = F.row_number().over(Window.partitionBy("name", "digest", part).orderBy("at"))
        number = F.when(part == 0, number.cast("string")).otherwise(F.concat_ws("-", part, number))
        out = out.union(rows.where(repeated).withColumn("id", _record_id(F.col("name"), F.col("digest"), number)))
    return out.withColumn("page", F.col("order").cast("string")).drop("order", "at", "spread", "repeated", "name")


def _archive(cost: Column) -> Column:
    """A part of its task's captures that holds at most ``ARCHIVE_BYTES``, or one larger capture.

    Captures are classed by powers of two of their bytes. So many neighbouring rows of a task make a part as may all
    be as large as their class allows.
    """
    size = F.greatest(F.lit(SMALLEST), F.ceil(F.log2(cost))).cast("int")
    each = F.greatest(F.lit(1.0), F.lit(float(ARCHIVE_BYTES)) / F.pow(F.lit(2.0), size))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.concat_ws("-", size, F.floor(row / F.floor(each)))


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = DATE,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write request, response or revisit, and metadata records of every page as gzip archives.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the largest key is a
    response and the others revisit it; smaller payloads are always responses. A page without a key revisits
    a page that has one. Null payloads are empty; repeated rows are captures of their own. An archive holds at most
    ``records_per_file`` records and ``ARCHIVE_BYTES`` bytes, but for one capture that is larger. No pages give no
    archives.
    """
    rows = captures(pages, key, url, html)
    revisit = F.col("refers").isNotNull()
    cost = F.when(revisit, 0).otherwise(F.col("size")) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES
    rows = rows.withColumn("part", _archive(cost))
    target = F.when(revisit, _record_id(F.col("refers"), F.col("digest"), F.lit("1")))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", F.col("id")),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", target),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(F.lit(_HTTP), F.when(revisit, "").otherwise(F.col("payload"))),
    )
    rest = F.coalesce(F.regexp_extract("url", "^[^:]*://[^/?#]*([^#]*)", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1), F.lit(""))
    request = _record(
        F.lit("request"),
        [
            ("WARC-Record-ID", _record_id(F.lit("request"), F.col("id"))),
            *common,
            ("WARC-Concurrent-To", F.col("id")),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(
            F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2)
        ),
    )
    fields = [F.concat(F.lit("page: "), F.col("page")), F.concat(F.lit("payloadBytes: "), F.col("size").cast("string"))]
    metadata = _record(
        F.lit("metadata"),
        [
            ("WARC-Record-ID", _record_id(F.lit("metadata"), F.col("id"))),
            *common,
            ("WARC-Concurrent-To", F.col("id")),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.concat_ws(END, *fields), F.lit(END)),
    )
    records = rows.select("part", F.explode(F.array(request, response, metadata)).alias("value"))
    options = {"lineSep": END * 2, "compression": "gzip", "maxRecordsPerFile": str(records_per_file)}
    records.write.options(**options).partitionBy("part").text(path)


def parse_records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := archive.readline():
        if not line.strip():
            continue
        headers = {"version": line.strip().decode()}
        while (line := archive.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, archive.read(int(headers["content-length"]))


_RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "content_type string, digest string, block_bytes long, payload string, payload_bytes long, "
    "payload_sha1 string"
)
_HEADERS = (
    "warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-concurrent-to", "warc-refers-to",
    "content-type", "warc-payload-digest",
)
_FLUSH = 4 << 20


def _parse_batch(batches):
    names = [f.split()[0] for f in _RECORD.split(", ")]
    types = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            archive = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))
            for headers, block in parse_records(archive):
                payload = block
                if headers.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                rows.append((
                    *(headers.get(h) for h in _HEADERS),
                    len(block),
                    payload.decode("utf-8", "replace"),
                    len(payload),
                    hashlib.sha1(payload).hexdigest(),
                ))
                size += len(block)
                if size > _FLUSH:
                    yield emit(rows)
                    rows, size = [], 0
            if rows:
                yield emit(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip archives below ``path``, written to the shared folder once parsed."""
    small_batches(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # one archive at a time
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    try:
        return materialize(files.mapInArrow(_parse_batch, _RECORD), "records", "zstd")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response``, ``request`` and ``metadata`` as structs of record columns.

    Requests and metadata find their response by ``concurrent_to``; where several name one response, that with
    the smallest record id counts. Captures without a request or metadata have null there; requests and
    metadata that name no response are left out.
    """
    every = F.struct("*")
    captured = records.where("type IN ('response', 'revisit')").select(
        F.col("record_id").alias("capture"), every.alias("response")
    )

    def part(kind: str) -> DataFrame:
        own = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        first = own.groupBy(F.col("concurrent_to").alias("capture")).agg(F.min("record_id").alias("record_id"))
        first = first.select("capture", F.col("record_id").alias("id"))
        found = own.join(first, (own.record_id == first.id) & (own.concurrent_to == first.capture))
        return found.select("capture", F.struct(*records.columns).alias(kind)).dropDuplicates(["capture"])

    return captured.join(part("request"), "capture", "left").join(part("metadata"), "capture", "left")


def _field(name: str) -> Column:
    found = F.regexp_extract("metadata.payload", rf"(?m)^{name}: (.*?)\r?$", 1)
    return F.when(found != "", found)


def round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", path: str | None = None
) -> DataFrame:
    """Write archives below ``path`` (by default in the shared folder), read and assemble them again.

    Returns ``capture``, ``key``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (the key of
    the response that a revisit names) and the nested records.
    """
    path = path or scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, key, url, html)
    found = assemble(read_records(pages.sparkSession, path))
    kind = pages.schema[key].dataType
    revisit = F.col("response.type") == "revisit"
    found = found.select(
        "capture",
        _field("page").cast(kind).alias("key"),
        F.when(revisit, _field("payloadBytes").cast("long")).otherwise(F.col("response.payload_bytes")).alias("bytes"),
        F.when(revisit, F.substring("response.digest", 6, 40)).otherwise(F.col("response.payload_sha1")).alias("digest"),
        F.col("response.type").alias("type"),
        F.col("response.refers_to").alias("target"),
        "response",
        "request",
        "metadata",
    )
    # Few responses are referred to, each perhaps by many revisits.
    targets = found.where("target IS NOT NULL").groupBy(F.col("target").alias("capture")).agg(F.lit(1).alias("n"))
    targets = found.select("capture", "key").join(targets, "capture").select(
        F.col("capture").alias("target"), F.col("key").alias("refers_to")
    )
    return found.join(targets, "target", "left").select(
        "capture",
        F.col("key").alias(key),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "response",
        "request",
        "metadata",
    )
