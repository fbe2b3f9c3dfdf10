"""Each operator on nulls, empty and very long texts, ties, repeated rows, no rows and clashing columns."""

import gzip
from pathlib import Path

import pytest
from cases import edge_rows, prose, rows
from pyspark.sql import functions as F

import corpus_pipeline
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
from tidemark.llm.queries import MANIFEST_COLUMNS, URL_RULES
from tidemark.session import scratch_space

N = len(edge_rows())


@pytest.fixture(scope="module")
def benchmark(spark):
    base = edge_rows()[0][1].split()
    items = [(1, " ".join(base[5:25])), (2, "word"), (3, None), (4, ""), (None, prose(9, 12)), (1, prose(3, 60))]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    marks = [(k, 1, int(k == 11)) for k in range(1, 12)] + [(1, 1, None), (2, 0, 0), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def operators(spark, benchmark, labels):
    def tox(docs):
        machine = toxicity.fit(docs, labels, F.lit(True))
        return toxicity.score(docs, machine, columns=["doc_id"]).select("row.doc_id", "score")

    return {
        "quality": host_quality.judge,
        "language": lambda docs: langid.predict(docs, langid.fit(docs, F.lit(True), fit_rows=3)),
        "repeats": suffix_repeats.repeats,
        "packing": lambda docs: packing.pack(docs).drop("sequence_id", "offset"),
        "decontamination": lambda docs: decontam.contamination(docs, benchmark),
        "toxicity": tox,
        "near": near_dup.near_duplicates,
        "lines": line_dedup.boilerplate_report,
        "phrases": lambda docs: collocations.collocations(docs, least=2),
        "tokens": lambda docs: bpe.decode(bpe.encode(docs)),
        "manifest": lambda docs: merkle.verify(docs, MANIFEST_COLUMNS, {"text": F.upper("text")}),
    }


NAMES = ["quality", "language", "repeats", "packing", "decontamination", "toxicity", "near", "lines"]
NAMES += ["phrases", "tokens", "manifest"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows_give_defined_rows_whatever_else_the_table_holds(operators, edges, clashing, name):
    plain = operators[name](edges)
    found = plain.collect()
    if name not in ("repeats", "packing", "phrases"):
        assert len(found) == N
    if name != "packing":
        assert rows(operators[name](clashing(edges))) == sorted(tuple(map(str, r)) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows_give_no_rows(operators, no_rows, name):
    assert operators[name](no_rows).collect() == []


def test_quality_counts(edges):
    found = {r.doc_id: r for r in host_quality.judge(edges).where("doc_id IS NOT NULL").collect()}
    assert found[3].n_words == found[4].n_words == found[5].n_words == 0 and found[3].base_failed
    assert found[6].n_words == 40_000 and not found[6].base_failed
    # Two of three documents of s3 are short; a document without a host is judged alone.
    assert not found[6].host_kept and not found[6].kept and found[5].host_kept
    assert found[11].n_symbols == 300 and found[11].n_repeat_words == 500 and found[11].base_failed


def test_hosts_beyond_the_prior_are_rejected_and_tiny_ones_spared(spark):
    """A hundred usual hosts, one where most documents are short, and one with a single document, which is short."""
    data = [(f"h{h}", "short" if k == 0 else prose(k, 60)) for h in range(100) for k in range(50)]
    data += [("bad", "short" if k % 5 < 3 else prose(k, 60)) for k in range(300)] + [("tiny", "short"), (None, prose(1, 60))]
    table = spark.createDataFrame([(k, t, "en", h, 0) for k, (h, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    found = host_quality.judge(table).groupBy(F.element_at(F.array(*[F.lit(h) for h, _ in data]), (F.col("doc_id") + 1).cast("int")).alias("h"))
    kept = {r.h: r.kept for r in found.agg(F.min("host_kept").alias("kept")).collect()}
    assert [h for h, k in kept.items() if not k] == ["bad"]
    wide = host_quality.judge(table, max_rate=0.9, spread=6.0).where("NOT host_kept")
    assert wide.isEmpty()
    by_host_only = host_quality.judge(table).where("NOT base_failed AND NOT kept").count()
    assert by_host_only == 120


def test_language_of_texts_without_letters(edges):
    found = {r.doc_id: r for r in langid.predict(edges, langid.fit(edges, F.lit(True))).collect()}
    assert {found[k].lang_pred for k in (3, 4, 5)} == {"und"} and found[4].score == 0
    assert found[1].lang_pred == "en" and 0 < found[1].score <= 1


def test_near_duplicates_of_edge_rows(edges):
    found = near_dup.near_duplicates(edges).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[2].component_id == by[9].component_id == 1 and by[1].kept and not by[2].kept
    assert by[3].n_shingles == by[4].n_shingles == 0 and by[3].kept and by[4].kept
    assert by[7].n_shingles == by[8].n_shingles == 1 and by[7].component_id == 7
    unnamed = sorted((r.component_id or 0, r.kept) for r in found if r.doc_id is None)
    assert unnamed == [(0, True), (1, False)]


def test_decontamination_of_edge_rows(edges, benchmark):
    found = {r.doc_id: r for r in decontam.contamination(edges, benchmark).collect()}
    assert found[1].n_hit == 20 and found[1].items == ["1"]
    assert found[7].n_hit == 1 and found[7].items == ["2"]
    assert found[10].n_hit == 60 and found[3].n_words == 0 and found[4].items == []


def test_an_empty_benchmark_hits_nothing(spark, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(edges, none).where("n_hit > 0").count() == 0
    assert rows(decontam.scrub(edges, none)) == rows(edges)


def test_no_labels_score_everything_at_a_half(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = toxicity.score(edges, toxicity.fit(edges, none, F.lit(True)))
    assert {r.score for r in scored.collect()} == {0.5} and scored.count() == N


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 600 + "</p>"
    data = [
        (1, "http://A.example.com/en/x?q#f", big),
        (2, "https://www.example.com/en/", big),
        (3, "https://b.net/es/1", big),
        (3, "https://b.net/es/1", big),
        (4, None, None),
        (5, "no address", ""),
        (6, "https://c.net/fr", "short\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
        (7, "https://d.net/fr/\r\nX: y", "short"),
        (None, "https://e.org/", big),
        (8, "http://example.com", "x" * 300_000),
    ]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_archives_of_edge_rows(pages, clashing):
    found = warc.round_trip(pages)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in found.collect())
    assert got == [
        (0, 1207, "revisit", 3),
        (1, 1207, "revisit", 3),
        (2, 1207, "revisit", 3),
        (3, 1207, "response", 0),
        (3, 1207, "response", 0),
        (4, 0, "response", 0),
        (5, 0, "response", 0),
        (6, 40, "response", 0),
        (7, 5, "response", 0),
        (8, 300_000, "response", 0),
    ]
    one = found.where("page_id = 6").first()
    assert one.response.payload.startswith("short\r\n\r\nWARC") and one.request.payload == ""
    assert one.metadata.concurrent_to == one.request.concurrent_to == one.response.record_id
    again = warc.round_trip(clashing(pages)).drop("request", "response", "metadata", "capture")
    assert rows(again) == rows(found.drop("request", "response", "metadata", "capture"))


def test_no_pages_make_no_archives(pages):
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_a_page_repeated_often_has_an_id_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(warc, "TOGETHER", 50)
    big = "<p>" + "b" * 2000
    data = [(7, "https://a.org/7", big)] * 2000 + [(k, f"https://a.org/{k}", big) for k in range(7)]
    data += [(None, None, big)] * 300
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    found = warc.round_trip(pages)
    assert found.select("capture").distinct().count() == found.count() == 2307
    got = found.groupBy("page_id", "record_type", "refers_to", "request.target_uri").count().collect()
    assert {tuple(r)[:3]: r["count"] for r in got if r.page_id == 7} == {(7, "response", None): 2000}
    assert all(tuple(r)[1:3] == ("revisit", 7) for r in got if r.page_id != 7)
    assert sum(r["count"] for r in got if r.page_id is None) == 300


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    sizes = {k: 5_000_000 if k % 40 == 0 else 100_000 if k % 5 == 0 else 900 for k in range(200)}
    data = [(k, f"https://a.org/{k}", prose(k, 300)[: min(n, 900)] + "x" * (n - 900)) for k, n in sizes.items()]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2)
    found = warc.round_trip(pages, path=str(tmp_path / "archives"))
    assert {r.page_id: r.payload_bytes for r in found.select("page_id", "payload_bytes").collect()} == {
        k: len(h) for k, _, h in data
    }
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").rglob("*.gz")]
    assert sum(len(f) > 1 << 20 for f in files) == 5
    assert all(f.count(b"WARC-Type: response") == 1 for f in files if len(f) > 1 << 20)
    assert len(files) < 40


def test_addresses_of_edge_rows(spark, pages, clashing):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    found = url_filter.judge_urls(pages, rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert found.count() == 10
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("b.net", "/es/1", "net/es/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("c.net", "/fr", None, "allow") and got[8] == ("example.com", "", None, "allow")
    assert rows(url_filter.judge_urls(clashing(pages), rules)) == rows(found)
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, benchmark, labels):
    path = str(tmp_path_factory.mktemp("tables"))
    benchmark.coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("stage", STAGES)
def test_stages_bear_edge_rows_and_other_columns(spark, edges, clashing, folder, stage):
    docs = clashing(edges)
    found = STAGES[stage](spark, docs, folder)
    if stage != "packing":
        assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
    number = found.count()
    assert number == N if stage in ("line_dedup", "decontamination") else number > 0
    assert STAGES[stage](spark, docs.limit(0), folder).count() == 0


def test_a_run_leaves_the_tables_of_its_last_stage_only(spark, edges, folder):
    edges.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    with scratch_space(spark) as scratch:
        found = corpus_pipeline.run(spark, folder)
        assert found.count() > 0
        left = {p.name.split("-")[0] for p in Path(scratch).iterdir()}
        assert left == {"decontamination", "pieces"}
