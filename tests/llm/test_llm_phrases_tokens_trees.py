"""Phrases, tokens and hash trees against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, collocations, merkle
from tidemark.llm.queries import MANIFEST_COLUMNS, QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}

# --- phrases ---


def best_phrases(rows, top, least):
    """By counting every run of words."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[k : k + size])] += 1
    out = []
    for lang, own in counts.items():
        long = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in long.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    part = p[k : k + size]
                    if 100 * a >= 80 * own[part]:
                        gone.add(part)
        found = []
        for p, a in long.items():
            score, _, l, r = min(
                (2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))
            )
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def some_texts(seed: int, number: int) -> list[tuple[str | None, str]]:
    """Frequent and rare words, set phrases, breaks and capitals."""
    rng = random.Random(seed)
    names = [f"{c}{k}" for c in "abé" for k in range(12)]
    phrases = [" ".join(rng.choices(names, k=rng.randint(2, 6))) for _ in range(25)]
    out = []
    for _ in range(number):
        parts = []
        for _ in range(rng.randint(1, 14)):
            parts.append(rng.choice(phrases) if rng.random() < 0.5 else rng.choice(names[: rng.randint(1, 36)]))
            parts.append(rng.choice([" ", " ", " ", "\t", ", ", "\n", "! ", "  "]))
        text = "".join(parts)
        out.append((rng.choice(["en", "en", "de", None, "und"]), text.upper() if rng.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("seed, top, least", [(1, 3, 2), (2, 8, 3), (3, 40, 2), (4, 1000, 2)])
def test_phrases_equal_the_count_of_everything(spark, monkeypatch, seed, top, least):
    monkeypatch.setattr(collocations, "_HELD", 64)
    rows = some_texts(seed, 150)
    table = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = collocations.collocations(table, top=top, least=least).collect()
    assert sorted(tuple(r) for r in found) == best_phrases(rows, top, least)


def test_floors_are_lowered_until_enough_phrases_survive(spark, monkeypatch):
    """Nearly all good pairs are covered by longer phrases, so the first floor leaves too few."""
    rng, rows, passes = random.Random(5), [], []
    for k in range(30):
        rows += [("en", f"x{k} y{k} z{k} v{k}")] * 5
    rows += [("en", f"p{k % 20} " + " ".join(f"q{rng.randint(0, 30)}" for _ in range(3))) for k in range(800)]
    counted = collocations._counted
    monkeypatch.setattr(collocations, "_counted", lambda *a, **k: passes.append(a[1]) or counted(*a, **k))
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=35, least=3)
    assert sorted(tuple(r) for r in found.collect()) == best_phrases(rows, 35, 3)
    assert passes[:3] == [2, 3, 4] and len(passes) > 3


def test_a_very_frequent_phrase_is_one_row_a_batch_of_a_task():
    tally = collocations.Tally(2)
    for _ in range(5):
        tally.add(np.array([7, 9, 7] * 1000, np.uint64), np.array([[1, 2], [3, 4], [1, 2]] * 1000))
    rows = tally.rows().to_pylist()
    assert rows == [{"w1": 1, "w2": 2, "code": 7, "a": 10_000}, {"w1": 3, "w2": 4, "code": 9, "a": 5000}]


def test_a_phrase_of_a_third_of_all_words(spark):
    rows = [("en", "a b " * 3000)] * 8 + [("en", f"w{k} a b c{k % 3}") for k in range(300)]
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=30).collect()
    assert sorted(tuple(r) for r in found) == best_phrases(rows, 2000, 30)


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**15, 9 * 10**15 + 1, 9 * 10**15 + 2)], "a long, l long, r long")
    found = row.select(collocations._score("a", "l", "r").alias("s")).first().s
    assert found == 2_000_000 * 9 * 10**15 // (18 * 10**15 + 3)


# --- tokens ---


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(None)


def plain(codec, text):
    """What the library gives for the whole text at once."""
    return codec.encoding.encode_ordinary(text)


pieces = st.sampled_from(
    ["a", "Z", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "2026", "#", "##", "é", "ß", "中", "文字", "،", "😀",
     " ", " ", "\x1f", "\x85", "²", "½", "xyz" * 5, "#" * 9, " " * 7, "<|endoftext|>", "\U000323b7"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=60).map("".join), st.integers(1, 9), st.integers(1, 6))
def test_tokens_equal_those_of_the_whole_text(codec, text, leaf, window):
    before = bpe.LEAF, bpe.WINDOW
    bpe.LEAF, bpe.WINDOW = leaf, window
    try:
        ids = codec.encode(text)
        assert ids == plain(codec, text)
        assert codec.decode(ids) == text.encode()
    finally:
        bpe.LEAF, bpe.WINDOW = before


@pytest.mark.parametrize("run", ["abcdefg", "x", "01234", "#", "=-", " ", "ab1", "ÀÉ", "中国人民", "it's"])
def test_long_runs_equal_those_of_the_whole_text(codec, run):
    rng = random.Random(1)
    for text in (run * 900, "".join(rng.choice(run) for _ in range(5000)), f"see {run * 700}'s end {run * 400} of it"):
        assert codec.encode(text) == plain(codec, text)


def test_joins_inside_a_run_encode_only_what_is_around_the_border(codec, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    sizes = []
    direct = codec.direct
    monkeypatch.setattr(codec, "direct", lambda t: sizes.append(len(t)) or direct(t))
    assert codec.encode(text) == plain(codec, text)
    assert max(sizes) <= bpe.LEAF


def test_chunks_of_long_texts_are_joined_level_by_level(spark, codec, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "GROUP", 2)
    texts = [prose(k, 20 * k) for k in range(20)] + ["é" * 500, "it's " * 60 + "中文" * 90, "", None, "x" * 41, prose(1, 200)] * 2
    rows = [(k if k % 7 else None, t, "en", "s", 0) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted((str(k), plain(codec, t or "")) for k, t, *_ in rows)
    found = bpe.encode(table)
    assert sorted((str(r.doc_id), r.ids) for r in found.collect()) == want
    back = bpe.decode(bpe.encode(table, packed=True)).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows)


def test_tokens_of_the_documents(spark, codec):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op12_bpe"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = plain(codec, r.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        own = found[r.doc_id]
        assert (own.n_tokens, own.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert own.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# --- hash trees ---


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_hash(values) -> str:
    texts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return h("".join(texts))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def climbed(levels, at, value):
    """The hash folded up from position ``at``, and the siblings on the way."""
    proof = []
    for level in levels[:-1]:
        first = at - at % 3
        left, right = level[first:at], level[at + 1 : first + 3]
        proof += left + right
        value, at = h("".join([*left, value, *right])), at // 3
    return value, proof


def proved(rows, claims):
    """(key, leaf, subroot, root, proof, folded, verified) of each row."""
    groups = defaultdict(list)
    for row, claim in zip(rows, claims):
        groups[row[3]].append((row[0] is not None, row[0] or 0, row_hash(row), row_hash(claim), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: levels_of([leaf for _, _, leaf, _, _ in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels_of([own[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (_, _, leaf, claim, key) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            value, proof = climbed(own[g], at, claim)
            value, more = climbed(top, place, value)
            root = top[-1][0]
            out.append((str(key), leaf, own[g][-1][0], root, h("".join(proof + more)), value, value == root))
    return sorted(out)


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_proofs_equal_a_tree_by_hand(spark, stride):
    """One group with most of the rows, groups of one, a null group, null and repeated keys, repeated rows."""
    rng = random.Random(stride)
    names = ["hot"] * 60 + ["a", "é", "Z", "", None, "=", "^", "x1", "x2", "x10"]
    rows = []
    for k in range(120):
        key = rng.choice([None, k, k, k, k // 2])
        rows.append((key, rng.choice([None, "", "a\nb", f"t{k}\n", "ü"]), rng.choice(["en", None]), rng.choice(names), k))
    rows += rows[:5]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    found = merkle.verify(table, columns, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, stride=stride)
    got = sorted((str(r.doc_id), *r[1:]) for r in found.collect())
    claims = [(r[0], r[1] and r[1].replace("\n", ""), *r[2:]) for r in rows]
    assert got == proved(rows, claims)
    assert {r[-1] for r in got} == {True, False}


def test_a_group_over_many_chunks_and_blocks(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="24")
    rows = [(k, f"t{k}", "en", "hot" if k % 10 else f"s{k % 70}", k) for k in range(2500)]
    found = merkle.verify(spark.createDataFrame(rows, SCHEMA), MANIFEST_COLUMNS, {}, stride=3).collect()
    assert len(found) == 2500 and all(r.verified for r in found)
    assert len({r.proof_sha256 for r in found}) == 2500 and len({r.root for r in found}) == 1


def test_stored_nodes_lead_to_the_root(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 4}", k) for k in range(300)]
    built = merkle.build(spark.createDataFrame(rows, SCHEMA), MANIFEST_COLUMNS, "doc_id", "source", stride=2)
    nodes = {(r.tree, r.round, r.at): r for r in built.nodes.collect()}
    for leaf in built.leaves.collect():
        steps, at = 0, (leaf.up_tree, leaf.up_round, leaf.up_at)
        while at[0] is not None:
            at, steps = (nodes[at].up_tree, nodes[at].up_round, nodes[at].up_at), steps + 1
        assert steps == 2
    assert built.subroots.count() == 4 and built.root.count() == 1
