"""Operators without SQL against brute force, exact round trips and held-out accuracy."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, docs, prose, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    decontam,
    fm_index,
    langid,
    line_dedup,
    near_dup,
    packing,
    spread,
    suffix_repeats,
    textops,
    tokens,
    toxicity,
    url_filter,
)
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES, fold

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

text = st.text(st.sampled_from(list("ab A\n\t'.é½1中 ")), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(text, min_size=1, max_size=8), st.integers(1, 40))
def test_words_and_hashes_do_not_depend_on_pieces(texts, size):
    seen = {}
    for piece in textops.pieces(pa.array(texts), size):
        found, hashes = piece.words(), piece.words().hashes()
        for row, (low, high) in enumerate(zip(found.bounds[:-1], found.bounds[1:])):
            want = WORD.findall(texts[piece.first + row])
            assert high - low == len(want)
            for word, code in zip(want, hashes[low:high].tolist()):
                assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


def test_words_beyond_a_block_have_a_hash_of_their_own():
    long = "x" * (textops.BLOCK + 5)
    (piece,) = textops.pieces(pa.array([f"a {long} b", f"{long} {long}y"]), 1 << 30)
    codes = piece.words().hashes().tolist()
    assert codes[1] == codes[3] and len(set(codes)) == 4


# --- near duplicates ---


def jaccard_components(texts: dict[int, str], percent: int = 75) -> dict[int, int]:
    sets = {}
    for k, t in texts.items():
        own = WORD.findall((t or "").translate(LOWER))
        sets[k] = set(zip(*(own[i:] for i in range(5)))) if len(own) >= 5 else {tuple(own)} - {()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def edited(base: list[str], share: float, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"q{rng.randint(0, 9**9)}" if rng.random() < share else w for w in base)


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """Copies with few and many edits, so that hubs alone do not settle the groups, beside a shared passage."""
    monkeypatch.setattr(near_dup, "BLOCK_NODES", block)
    shared, texts = prose(99, 60), []
    for group in range(4):
        base = words(group, 150)
        texts += [edited(base, 0.005 + 0.01 * (k % 5), 100 * group + k) for k in range(25)]
    texts += [prose(500 + k, 90) + " " + shared for k in range(15)]
    texts += [prose(700, 3), prose(700, 3), prose(701, 4), "A b C d E f", "a B c D e F", "", None]
    found = near_dup.near_duplicates(docs(spark, texts)).collect()
    want = jaccard_components(dict(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in found} == want
    assert len({v for v in want.values()}) < len(texts) - 50


def test_a_row_repeated_thousands_of_times_is_one_node(spark, monkeypatch):
    base = words(1, 150)
    near, seen, confirmed = edited(base, 0.01, 5), [], near_dup._confirmed
    rows = [(1, " ".join(base), "en", "s", 0)] * 2000 + [(2, near, "en", "s", 0)] * 2000 + [(3, prose(9, 80), "en", "s", 0)]
    monkeypatch.setattr(near_dup, "_confirmed", lambda *a: seen.append(confirmed(*a)) or seen[-1])
    found = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 2000), (2, 1, 2000), (3, 3, 1)]
    assert sum(df.count() for df in seen) == 1


def test_different_texts_of_one_key_do_not_depend_on_the_layout(spark):
    base = words(1, 150)
    rows = [(1, " ".join(base), "en", "s", 0), (1, prose(2, 100), "en", "s", 0), (1, "", "en", "s", 0)]
    rows += [(5, edited(base, 0.01, 5), "en", "s", 0), (6, prose(2, 100), "en", "s", 0), (7, edited(words(2, 100), 0.01, 1), "en", "s", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    results = {
        tuple(sorted(map(tuple, near_dup.near_duplicates(t).collect())))
        for t in (table.coalesce(1), table.repartition(5), table.orderBy(F.desc("doc_id"), F.desc("text")))
    }
    assert len(results) == 1
    (found,) = results
    # All rows of a key have one component, and the texts it shares with other keys still link those.
    assert {c for k, _, c, _ in found if k == 1} == {1}
    assert {c for k, _, c, _ in found if k in (6, 7)} in ({1}, {6})


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(139, 200), (300, 300)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == 21 + 41
    assert {r.component for r in found if r.node <= 20} == {0}
    assert {r.component for r in found if r.node >= 100} == {100}


# --- repeats ---


def repeated_words(texts: list[str], least: int = 50) -> dict[int, np.ndarray]:
    runs = defaultdict(set)
    split = [WORD.findall(t or "") for t in texts]
    for k, own in enumerate(split):
        for i in range(len(own) - least + 1):
            runs[tuple(own[i : i + least])].add(k)
    out = {}
    for k, own in enumerate(split):
        cover = np.zeros(len(own), bool)
        for i in range(len(own) - least + 1):
            if len(runs[tuple(own[i : i + least])]) > 1:
                cover[i : i + least] = True
        if cover.any():
            out[k] = cover
    return out


def covered(found, split) -> dict[int, np.ndarray]:
    out = {}
    for r in found:
        out[r.doc_id] = np.zeros(len(split[r.doc_id]), bool)
        for span in r.spans:
            out[r.doc_id][span.start : span.end] = True
    return out


def test_a_frequent_key_is_dealt_over_tasks(spark, conf, monkeypatch):
    """One key with most of the rows, rare ones, one of a side only and a null, against a plain join."""
    conf(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")
    monkeypatch.setattr(spread, "LEAST_ROWS", 10)
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id < 3000 THEN 1 WHEN id < 3999 THEN id END AS k")
    counts = rows.where("k < 3500").groupBy("k").agg(F.count("*").alias("copies"))
    keys = counts.selectExpr("k", "k * 2 AS twice", "copies").union(spark.range(7000, 7003).selectExpr("id", "id", "1L"))
    found = spread.spread_join(rows, keys, ["k"], ["id"])
    assert found.columns == ["k", "id", "twice"]
    want = rows.join(keys.drop("copies"), "k")
    assert sorted(found.collect()) == sorted(want.collect())
    sizes = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count_if(F.col("k") == 1).alias("n"))
    assert max(r.n for r in sizes.collect()) < 1000
    assert spread.spread_join(rows, keys.where("false"), ["k"], ["id"]).count() == 0
    assert spread.spread_join(rows.where("false"), keys, ["k"], ["id"]).count() == 0


@pytest.mark.parametrize("least", [2, 256])
def test_repeats_equal_brute_force(spark, monkeypatch, least):
    """Passages of lengths around the least, alone and many times, at both ends and inside."""
    monkeypatch.setattr(spread, "LEAST_ROWS", least)
    monkeypatch.setattr(spread, "PARTS", 4 * least)
    texts = []
    for k in range(60):
        passage = prose(1000 + k % 6, 45 + 2 * (k % 6))
        parts = [prose(2000 + k, 10 + k), passage, prose(3000 + k, 5 + k % 17)]
        texts.append(" ".join(parts[k % 2 : 3 - (k % 3 == 0)]))
    long = prose(5, 400)
    texts += [long, long, " ".join(long.split()[100:250]), prose(6, 60) + " " + prose(6, 60), "short", None]
    found = suffix_repeats.repeats(docs(spark, texts)).collect()
    want, got = repeated_words(texts), covered(found, [WORD.findall(t or "") for t in texts])
    assert set(got) == set(want)
    assert all((got[k] == want[k]).all() for k in want)
    assert all(r.partner != r.doc_id and r.partner in want for r in found)


def test_a_suffix_that_matches_a_third_text_on_the_left_is_found(spark):
    """B shares more on the right with A than C does, so C is no neighbour; A and C share 50 words."""
    left, middle, right = prose(1, 15), prose(2, 40), prose(3, 25)
    texts = [
        " ".join([prose(4, 20), left, middle, right]),
        " ".join([prose(5, 20), middle, right[: len(right) // 3]]),
        " ".join([prose(6, 20), left, middle, prose(7, 30)]),
    ]
    texts += [" ".join([prose(k, 9), middle, prose(k + 50, 12)]) for k in range(100, 130)]
    found = suffix_repeats.repeats(docs(spark, texts)).collect()
    assert {0, 2} <= {r.doc_id for r in found}
    assert {r.doc_id for r in found} == set(repeated_words(texts))


def test_blocks_that_recombine_give_whole_spans(spark):
    """Every two texts with a side in common share 20 words there beside the 30 in the middle."""
    lefts, rights = ([prose(20 * k + side, 20) for k in range(3)] for side in (1, 2))
    # A middle whose start is the first position that is retained.
    middle, texts = prose(1354, 30), []
    for k in range(9):
        texts.append(" ".join([lefts[k // 3], middle, rights[k % 3], prose(300 + k, 25)]))
    found = suffix_repeats.repeats(docs(spark, texts)).collect()
    want, got = repeated_words(texts), covered(found, [t.split() for t in texts])
    assert set(got) == set(want) == set(range(9))
    assert all((got[k] == want[k]).all() for k in want)


def test_neighbours_meet_across_partitions(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="64")
    passage = prose(8, 52)
    texts = [f"{prose(100 + k, 30)} {passage} {prose(200 + k, 30)}" for k in range(12)]
    found = suffix_repeats.repeats(docs(spark, texts)).collect()
    assert {r.doc_id: r.n_repeat_words for r in found} == {k: 52 for k in range(12)}


# --- packing ---


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


# Among them the string of a token that is taken out of a text before it is split, whole and in parts.
rough = st.lists(
    st.sampled_from([*"ab 'stremld\n\t.!1é×²中\x1f ", "<|endoftext|>", "<|", "endoftext", "|>"]), max_size=50
).map("".join)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(rough, min_size=1, max_size=6))
def test_ids_equal_the_tokenizers(texts, tokenizer):
    import public_tokenizers

    encoder = tokens.Encoder.of(public_tokenizers.path(packing.TOKENIZER))
    (piece,) = textops.pieces(pa.array(texts, pa.string()), 1 << 30)
    for text, ids in zip(texts, encoder.rows(piece)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_rows_with_the_string_of_a_token_and_a_full_cache(tokenizer, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "CACHE_IDS", 40)
    texts = ["a <|endoftext|> b", "a <|", "endoftext|> b", prose(1, 60), "<|endoftext|>" * 3, "", prose(2, 60)]
    encoder = tokens.Encoder(public_tokenizers.path(packing.TOKENIZER))
    for size in (1, 30, 1 << 20):
        for piece in textops.pieces(pa.array(texts), size):
            for k, ids in enumerate(encoder.rows(piece)):
                assert ids.tolist() == tokenizer.encode(texts[piece.first + k], add_special_tokens=False).ids
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def check_packing(found, ids, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        own = ids[r.doc_id]
        part = own[r.start : r.start + r.length]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, own in ids.items():
        at = 0
        for start, size in sorted(by_doc[k]):
            assert start == at and size > 0
            at += size
        assert at == len(own)
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    # Nothing is padded: full sequences, and powers of two at the end.
    assert all(s == length or s & (s - 1) == 0 for s in sizes)
    assert sum(s != length for s in sizes) <= length.bit_length()


@pytest.mark.parametrize("merge", [2, 32])
def test_packing_is_an_exact_round_trip(spark, tokenizer, monkeypatch, merge):
    monkeypatch.setattr(packing, "MERGE", merge)
    texts = [prose(k, (k * 37) % 300) for k in range(150)] + [None, "", "x", prose(1, 4000), "it's 'tis'll  \n x"]
    table = docs(spark, texts).repartition(7)
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    found = packing.pack(table, length=256, open_windows=4).collect()
    check_packing(found, ids, 256)
    assert all(list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] for r in found)


def test_packing_of_the_documents(spark, tokenizer):
    found = QUERIES["op4_packing"](spark, SMALL).collect()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    check_packing(found, ids, 2048)


# --- decontamination ---


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.lists(st.integers(1, 6), min_size=1, max_size=4))
def test_index_finds_all_occurrences(symbols, phrase):
    text = [fm_index.FIRST + s for s in symbols] + [fm_index.GAP]
    index = fm_index.FMIndex(np.array(text))
    want = np.array([fm_index.FIRST + s for s in phrase])
    low, high = index.search(want[None, :])
    at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert at == [i for i in range(len(text)) if text[i : i + len(want)] == want.tolist()]


@pytest.fixture(scope="module")
def leaks(spark):
    items = [(k, prose(k, 8 + k)) for k in range(12)]
    texts = []
    for k in range(40):
        item = items[k % 12][1].upper().split()
        cut = item[k % 4 :] if k % 5 else item
        texts.append(f"{prose(100 + k, 30)}; {', '.join(cut)}! {prose(200 + k, 20)}" if k % 3 else prose(300 + k, 50))
    return docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")


def test_one_block_of_windows_at_a_time(leaks, monkeypatch):
    import gc
    import weakref

    table, items = leaks
    made, alive, block = [], [], decontam._block

    def counted(rows):
        gc.collect()
        alive.append(sum(ref() is not None for ref in made))
        found = block(rows)
        made.append(weakref.ref(found))
        return found

    monkeypatch.setattr(decontam, "_block", counted)
    decontam.contamination(table, items, block_windows=20)
    assert len(alive) > 2 and max(alive) == 0


def test_blocks_and_shards_do_not_change_the_result(leaks, monkeypatch):
    table, items = leaks
    whole = sorted(map(str, decontam.contamination(table, items).collect()))
    blocked = sorted(map(str, decontam.contamination(table, items, block_windows=20).collect()))
    monkeypatch.setattr(decontam, "SHARD_BYTES", 500)
    small = sorted(map(str, decontam.contamination(table.coalesce(1), items).collect()))
    assert whole == blocked == small


@pytest.mark.parametrize("block", [20, 100_000])
def test_scrubbed_texts_hold_no_window(leaks, block):
    table, items = leaks
    clean = decontam.scrub(table, items, block_windows=block)
    assert clean.columns == table.columns
    report = {r.doc_id: r for r in decontam.contamination(table, items).collect()}
    assert sum(r.n_hit > 0 for r in report.values()) > 15
    assert decontam.contamination(clean, items).where("n_hit > 0").count() == 0
    before = {r.doc_id: r.text for r in table.collect()}
    for r in clean.collect():
        kept = before[r.doc_id]
        for span in reversed(report[r.doc_id].spans):
            kept = kept[: span.start] + kept[span.end :]
        assert r.text == kept


# --- models ---


def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.98


def test_texts_unlike_any_learned_are_rejected(spark):
    table = docs(spark, [prose(k, 100) for k in range(60)])
    model = langid.fit(table, F.lit(True))
    other = docs(spark, ["ξένη γλώσσα με άλλα γράμματα " * 10, prose(7, 100)])
    found = {r.doc_id: r for r in langid.predict(other, model).collect()}
    assert found[0].rejected and found[0].lang_pred == "en" and not found[1].rejected


def test_language_scores_equal_a_plain_count(spark):
    """N-grams, weights and cosines once more, one at a time."""
    texts = [prose(k, 5 + 3 * k) + t for k, t in enumerate(["", "!", " É", " 12 a", "中文 x", "  A  b"] * 4)]
    table = docs(spark, texts)
    model = langid.fit(table, F.lit(True), centroids=2)

    def vector(text):
        folded = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in text.translate(LOWER).encode())
        folded = b" " + b" ".join(folded.split()) + b" " if folded.split() else b" "
        out = np.zeros(langid.SLOTS)
        for n in (1, 2, 3):
            for i in range(len(folded) - n + 1):
                code = (int.from_bytes(folded[i : i + n], "big") + (n << 24)) * 2654435761 % (1 << 32)
                out[code >> 20] += 1
        weighted = np.log1p(out) * model.idf
        return weighted / np.linalg.norm(weighted)

    found = {r.doc_id: r for r in langid.predict(table, model).collect()}
    for k, t in enumerate(texts):
        cosine = model.centroids @ vector(t)
        assert found[k].score == pytest.approx(min(1, cosine.max()), abs=1e-5)
        assert found[k].rejected == (found[k].score < model.radius[cosine.argmax()])


def test_a_row_repeated_thousands_of_times_is_learned_once(spark):
    rows = [(k, prose(k, 60), "en" if k % 2 else "de", "s", 0) for k in range(40)]
    plain = spark.createDataFrame(rows, SCHEMA)
    many = spark.createDataFrame(rows + rows[:1] * 3000, SCHEMA)
    one, other = (langid.fit(t, F.lit(True), fit_rows=30) for t in (plain, plain.union(plain.where("doc_id = 0"))))
    assert one.centroids.shape == other.centroids.shape
    labels = spark.createDataFrame([(k, 1, k % 3 == 0) for k in range(40)], "doc_id long, quality int, toxic boolean")
    first, again = (toxicity.fit(t, labels, F.lit(True)) for t in (plain, many.repartition(7)))
    assert first.bias == again.bias and (first.slots == again.slots).all() and (first.vectors == again.vectors).all()


def test_toxicity_scores_equal_a_sum_over_pairs():
    rng = np.random.default_rng(1)
    texts = [prose(k, 12) for k in range(20)] + ["", "word", "word word"]
    (piece,) = textops.pieces(pa.array(texts), 1 << 30)
    rows, slots = toxicity.terms(piece)
    known = np.unique(slots)[::2]
    machine = toxicity.Machine(0.3, known, rng.normal(size=len(known)), rng.normal(size=(len(known), 3)) / 5)
    place = {s: k for k, s in enumerate(known.tolist())}
    for k, score in enumerate(machine.scores(piece)):
        own = [place[s] for s in sorted(set(slots[rows == k].tolist())) if s in place]
        total = 0.3 + sum(machine.weights[a] for a in own)
        total += sum(machine.vectors[a] @ machine.vectors[b] for i, a in enumerate(own) for b in own[:i])
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def toxic_rows(n: int, seed: int):
    """Toxic if it holds an insult, or both halves of a pair that are harmless alone."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = words(seed * 100_000 + k, 60)
        kind = rng.choice(["clean"] * 4 + ["insult", "one", "two", "pair"])
        own += {"clean": [], "insult": ["zzinsult"], "one": ["zzgroup"], "two": ["zzthey"], "pair": ["zzgroup", "zzthey"]}[kind]
        rng.shuffle(own)
        out.append((k, " ".join(own), int(kind in ("insult", "pair"))))
    return out


def test_pairs_of_terms_are_learned(spark):
    rows = toxic_rows(1500, 1)
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(table, labels, fold("doc_id", 5) != 0)
    found = toxicity.score(table, machine, columns=["doc_id"]).select("row.doc_id", "score").collect()
    held = [(r.score, rows[r.doc_id][2]) for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.97


def test_pairs_are_learned_whose_terms_say_nothing_alone():
    """Toxic with exactly one of two terms, each in half of all texts: no linear weight tells them apart."""
    rng, examples = random.Random(1), []
    for _ in range(5000):
        own, one, two = {rng.randrange(100, 3100) for _ in range(60)}, rng.random() < 0.5, rng.random() < 0.5
        own |= {1} if one else set()
        own |= {2} if two else set()
        examples.append((int(one != two), np.array(sorted(own))))
    machine = toxicity.train(examples[:3000])

    def margin(own):
        at = np.flatnonzero(np.isin(machine.slots, own))
        vector = machine.vectors[at]
        total = vector.sum(axis=0)
        return machine.bias + machine.weights[at].sum() + (total @ total - (vector * vector).sum()) / 2

    assert np.mean([(margin(own) >= 0) == label for label, own in examples[3000:]]) >= 0.9


def test_long_texts_do_not_throw_the_vectors_out():
    """Texts of hundreds of shared terms, whose pairs say nothing; margins ran into the thousands without a bound."""
    rng, examples = np.random.default_rng(3), []
    for _ in range(800):
        own, label = set((rng.zipf(1.3, 3000) % 20000 + 10).tolist()), int(rng.random() < 0.1)
        own |= {int(rng.integers(0, 4))} if label else set()
        examples.append((label, np.array(sorted(own))))
    machine = toxicity.train(examples[:600])
    for _, own in examples[600:]:
        at = np.flatnonzero(np.isin(machine.slots, own))
        vector = machine.vectors[at]
        total = vector.sum(axis=0)
        assert abs(machine.bias + machine.weights[at].sum() + (total @ total - (vector * vector).sum()) / 2) < 50


def test_toxicity_reads_the_whole_text(spark):
    rows = toxic_rows(800, 2)
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(table, labels, F.lit(True))
    filler = " ".join(f"w{k}" for k in range(30_000))
    long = docs(spark, [filler + " zzinsult", filler])
    found = {r.row.doc_id: r.score for r in toxicity.score(long, machine).collect()}
    assert found[0] >= 0.5 > found[1]


# --- lines and addresses ---


def test_sketches_decide_like_exact_counts(spark):
    """Lines on 2 to 40 of 400 sites against a threshold of 20, with sketches for all but the near ones."""
    data = []
    for line in range(39):
        data += [(k, f"text {line} {k} and so on\nboilerplate {line}\nmore text {line} of {k}", "en", f"s{(line * 7 + k) % 400}", 0)
                 for k in range(line + 2)]
    table = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(data)], SCHEMA)
    found = line_dedup.boilerplate_report(table, min_sites=20)
    gone = {int(t.split()[1]) for t, n in found.select("text", "n_removed").collect() if n}
    assert gone == set(range(18, 39))


def test_copies_keep_their_lines(spark):
    page = "\n".join(prose(k, 12) for k in range(6))
    data = [(k, page, "en", f"s{k}", 0) for k in range(30)]
    data += [(100 + k, f"{prose(k, 40)}\nall rights reserved", "en", f"s{k}", 0) for k in range(30)]
    found = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), keep_copies=True).collect()
    assert all(r.text == page for r in found if r.doc_id < 100)
    assert all("rights" not in r.text for r in found if r.doc_id >= 100)


def test_lines_spread_by_copies_go_unless_copies_are_kept(spark):
    page = "\n".join(prose(k, 12) for k in range(6))
    data = [(k, page, "en", f"s{k % 12}", 0) for k in range(30)]
    data += [(100 + k, f"{page}\n{prose(k, 40)}", "en", f"s{k % 9}", 0) for k in range(30)]
    found = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r.text == ("" if r.doc_id < 100 else prose(r.doc_id - 100, 40)) for r in found)


def test_short_texts_lose_boilerplate_that_is_most_of_them(spark):
    foot = "\n".join(prose(k, 12) for k in range(3))
    data = [(k, f"{prose(100 + k, 4)}\n{foot}", "en", f"s{k}", 0) for k in range(12)]
    data += [(50, foot, "en", "s1", 0), (51, f"{foot}\n{prose(1, 40)}", "en", None, 0)]
    found = {r.doc_id: r for r in line_dedup.boilerplate_report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(found[k].n_removed == 3 for k in found)
    assert all(found[k].text == prose(100 + k, 4) for k in range(12))
    assert found[50].text == "" and found[51].text == prose(1, 40)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.sampled_from("abcdef"), st.integers(0, 2)), max_size=40))
def test_only_copies_keep_lines_that_spread_by_copies(spark, places):
    """Texts on some of six sites, against the definition."""
    data = [(k, f"line {group}\ntext {own} of {group}", "en", site, 0) for k, (own, site, group) in enumerate(places)]
    found = line_dedup.boilerplate_report(spark.createDataFrame(data, SCHEMA), min_sites=3, keep_copies=True).collect()
    on = defaultdict(set)
    for own, site, group in places:
        on[group, own].add(site)
    for r in found:
        own, _, group = places[r.doc_id]
        texts = [sites for (g, _), sites in on.items() if g == group]
        sites = set().union(*texts)
        alone = set().union(*(s for s in texts if len(s) == 1))
        wide = len(alone) + sum(len(s) > 1 for s in texts) >= 3
        gone = len(sites) >= 3 and (wide or len(on[group, own]) == 1)
        # The second line is the text's own, so only its copies have it.
        assert r.n_removed == gone and r.text.endswith(f"text {own} of {group}")


def test_a_passage_of_a_copied_page_goes_from_other_texts(spark):
    quote = prose(1, 30)
    data = [(k, f"{quote}\n{prose(2, 50)}", "en", f"s{k}", 0) for k in range(12)]
    data += [(50, f"{prose(3, 50)}\n{quote}", "en", "s50", 0)]
    found = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), keep_copies=True).collect()}
    assert found[50] == prose(3, 50) and all(found[k] == data[k][1] for k in range(12))


def test_long_lines_are_judged_by_their_sites(spark):
    notice = prose(1, 93)
    data = [(k, f"{prose(100 + k, 60)}\n{notice}", "en", f"s{k}", 0) for k in range(11)]
    data += [(50 + k, f"{prose(200 + k, 60)}\n{prose(2, 93)}", "en", f"s{k}", 0) for k in range(9)]
    found = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r.text == prose(100 + r.doc_id, 60) for r in found if r.doc_id < 50)
    assert all(r.text == data[r.doc_id - 39][1] for r in found if r.doc_id >= 50)


hosts = st.lists(st.sampled_from(["a", "b", "com", "net", "x1"]), min_size=1, max_size=4).map(".".join)
paths = st.sampled_from(["", "/", "/en", "/en/", "/en/x", "/es/"])


@settings(max_examples=4, deadline=None)
@given(
    st.lists(st.tuples(hosts, paths), min_size=10, max_size=30),
    st.lists(st.tuples(hosts, paths, st.sampled_from(["allow", "block"])), min_size=1, max_size=12),
)
def test_rules_equal_brute_force(spark, urls, rules):
    pages = [(k, f"https://{h}{p}?q") for k, (h, p) in enumerate(urls)]
    found = url_filter.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame(rules, "host string, path string, verdict string"),
    )
    got = {r.page_id: (r.rule, r.verdict) for r in found.collect()}
    for k, (host, path) in enumerate(urls):
        fits = [
            (len(h + p), len(h), h + p)
            for h, p, _ in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        assert got[k][0] == (best and best[2])
        want = min(v for h, p, v in rules if h + p == best[2]) if best else "allow"
        assert got[k][1] == want


def test_the_filter_of_a_long_list_passes_little_else(spark):
    listed = spark.range(1_000_000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("entry"))
    blocks = 1_000_000 * url_filter.BITS_PER_ENTRY // 64
    words = url_filter.bloom_filter(listed, blocks)
    assert 200_000 < words.count() <= blocks
    assert url_filter.possible(listed.where("entry < 'h2'"), words, blocks).count() == listed.where("entry < 'h2'").count()
    others = spark.range(100_000).select(F.concat(F.lit("g"), "id", F.lit(".org/")).alias("entry"))
    assert url_filter.possible(others, words, blocks).count() < 2_000


def test_addresses_under_very_many_rules(spark):
    rules = spark.range(300_000).selectExpr("concat('h', id, '.org') AS host", "'/a/' AS path", "'block' AS verdict")
    pages = spark.range(2_000).selectExpr("id AS page_id", "concat('https://x.h', id * 300, '.org/a/', id) AS url")
    found = url_filter.judge_urls(pages, rules)
    got = {r.page_id: r.rule for r in found.collect()}
    assert got == {k: f"h{k * 300}.org/a/" if k * 300 < 300_000 else None for k in range(2_000)}


# --- pipeline ---


def test_pipeline_keeps_clean_documents_and_catches_the_rest(spark, tmp_path, tokenizer):
    marked = toxic_rows(600, 3)
    item = prose(77, 25)
    texts = {k: t for k, t, _ in marked}
    leak = next(k for k, _, y in marked if not y)
    texts[leak] = f"{prose(78, 40)} {item} {prose(79, 40)}"
    base = words(80, 120)
    texts |= {1000 + k: edited(base, 0.005, k) for k in range(20)}
    texts |= {1100 + k: f"{prose(900 + k, 70)}\nsubscribe to our letter" for k in range(30)}
    rows = [(k, t, "en", f"s{k % 25}", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, y) for k, _, y in marked]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in found}
    toxic = {k for k, _, y in marked if y}
    assert len(left & toxic) <= 0.03 * len(toxic)
    clean = set(texts) - toxic - set(range(1001, 1020))
    assert len(clean - left) <= 0.01 * len(clean)
    copies = jaccard_components({k: texts[k] for k in range(1000, 1020)})
    assert left & set(range(1000, 1020)) == set(copies.values())

    ids = {}
    for k in left:
        kept = texts[k].replace("\nsubscribe to our letter", "").replace(item, "")
        ids[k] = [*tokenizer.encode(kept, add_special_tokens=False).ids, 1]
    check_packing(found, ids, 2048)
