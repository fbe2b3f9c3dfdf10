"""Small made tables for the operators, with the awkward rows that each of them must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use inside.
CLASHES = (
    "key", "row", "score", "kept", "node", "n", "at", "drop", "whole", "lines", "label", "rank", "value", "spans",
    "digest", "size", "host", "path", "entry", "order", "page", "payload", "capture", "ids", "open",
    "tree", "place", "leaf", "claim", "folded", "proof", "word", "w1", "code", "a", "l", "doc", "near", "floor",
)


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    base = prose(1, 80)
    long = prose(2, 40_000)
    return [
        (1, base, "en", "s1", 1),
        (2, base, "en", "s2", 1),
        (2, base, "en", "s2", 1),
        (3, None, "en", "s1", None),
        (4, "", None, "s1", 0),
        (5, " \t\n ", "de", None, 4),
        (6, long, "en", "s3", len(long)),
        (7, "word", "en", "s3", 4),
        (8, "a b c d", "en", "s3", 7),
        (None, base, "en", "s4", 1),
        (None, None, None, None, None),
        (9, prose(1, 80).replace(" ", "\n", 3), "en", "s4", 1),
        (10, "Ünï cödé £ ½ ² 中文 " + prose(3, 60), "fr", "s4", 1),
        (11, "#" * 300 + "\n\n" + "x " * 500, "fr", "s4", 1),
    ]


def docs(spark, texts, **columns):
    rows = [(k, t, columns.get("lang", "en"), f"s{k % 7}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))
