"""Phrases whose words belong together, grown best-first within bounds.

A phrase of two to four words scores by its own count against the counts of the two parts it can be cut into;
the worst cut counts. A language's best phrases are found without counting all runs of words:

* No extension of a phrase occurs more often than the phrase, and neither does what is left after its first
  word. So ``bound(first word, phrase)`` is at least the score of whatever begins with the phrase, and the same with the
  last word of whatever ends with it. A phrase's own score is below both of its bounds.
* Words and pairs that occur ``least`` times are counted first. In a wave, each language has a floor, the score
  that a number of its pairs reach. Phrases with a bound above the floor are the frontier and grow by a word, to the right if
  the bound of beginnings allows it and to the left if that of endings does: one pass over the texts for
  three words and one for four.
* After that, every phrase with a score above the floor is known with its exact counts and with all its
  extensions, which decide whether it is covered. If enough survive, the language is settled, ties included.
  Otherwise its floor is lowered and the frontier between the two floors grows.

Passes tell whether a run of words may be wanted by bitmaps of a fixed size. A bit that two runs share lets a run be
counted in vain and changes no result. Counts are combined in the tasks before they are
shuffled, so a very frequent phrase is one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.session import materialize

LONGEST = 4
#: Occurrences that a phrase needs.
LEAST = 30
TOP = 2000
#: A phrase is covered by a longer one with so many percent of its occurrences.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"

_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~(_BREAK | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8)))
#: 2 ** 25 bits are 4 MB.
_BITMAP_BITS = 25
#: Rows that a task holds before it combines them, and words before it hands them on.
_HELD = 1 << 20
#: Floors are multiples of this.
_STEP = 1000
_SALTS = 64


def _word_ids(batch: pa.RecordBatch) -> Iterator[tuple[X.Words, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of each piece of the columns language and text: its words, their ids, whether a word follows another one without a
    break, the language of each, and the names of the languages. Equal words of two languages have two ids."""
    langs, texts = batch.columns
    coded = langs.fill_null(UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices)
    seeds = np.array(
        [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64
    )
    for piece in X.pieces(texts):
        words = piece.words(_WORD)
        row = words.row()
        lang = codes[piece.first + row]
        ids = X.mix(words.hashes(X.LOWER) + seeds[lang])
        passed = np.cumsum(_BREAK[piece.data])[words.starts] if len(row) else row
        follows = np.zeros(len(ids), bool)
        follows[1:] = (row[1:] == row[:-1]) & (passed[1:] == passed[:-1])
        yield words, ids, follows, lang, names


def _count_words(batches):
    """(lang, word, id, n), and for each language a row without a word that has the number of all."""
    slots: dict[int, int] = {}
    rows: list[list] = []
    totals: dict[str, int] = {}
    size = 0

    def flush():
        columns = list(zip(*rows)) or [[]] * 4
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "word", "id", "n"])

    for batch in batches:
        for words, ids, _, lang, names in _word_ids(batch):
            for name, n in zip(names, np.bincount(lang, minlength=len(names)).tolist()):
                totals[name] = totals.get(name, 0) + n
            found, first, number = np.unique(ids, return_index=True, return_counts=True)
            raw = X.LOWER[words.piece.data].tobytes()
            starts, ends = words.starts[first].tolist(), words.ends[first].tolist()
            for code, n, at, start, end in zip(found.tolist(), number.tolist(), first.tolist(), starts, ends):
                slot = slots.get(code)
                if slot is not None:
                    rows[slot][3] += n
                    continue
                slots[code] = len(rows)
                signed = code - (1 << 64) if code >> 63 else code
                rows.append([names[lang[at]], raw[start:end].decode(), signed, n])
                size += end - start + 64
            if size > 64 * _HELD:
                yield flush()
                slots, rows, size = {}, [], 0
    rows += [[name, None, 0, n] for name, n in totals.items() if n]
    yield flush()


class Tally:
    """Counts of runs of words, combined whenever ``_HELD`` rows have come."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray, runs: np.ndarray) -> None:
        self.parts.append((codes, runs, np.ones(len(codes), np.int64)))
        self.held += len(codes)

    def combine(self) -> None:
        codes, runs, number = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(codes)
        ranked = codes[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else order
        sums = np.add.reduceat(number[order], new) if len(new) else number
        self.parts = [(ranked[new], runs[order[new]], sums)]
        self.held = len(new)

    def rows(self) -> pa.RecordBatch:
        if not self.parts:
            self.add(np.empty(0, np.uint64), np.empty((0, self.width), np.int64))
        self.combine()
        codes, runs, number = self.parts[0]
        self.clear()
        columns = [pa.array(np.ascontiguousarray(runs[:, k])) for k in range(self.width)]
        names = [f"w{k + 1}" for k in range(self.width)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(codes.view(np.int64)), pa.array(number)], [*names, "code", "a"])


def _runs(ids: np.ndarray, size: int) -> np.ndarray:
    """The code of the run of ``size`` words that begins at each word."""
    return ids if size == 1 else X.grams(ids, size)


def _bitmap(rows: DataFrame, code: str = "code") -> np.ndarray:
    """A bit for each code, by its first ``_BITMAP_BITS`` bits. At most 2 ** 19 words of it reach the driver."""
    place = F.shiftrightunsigned(code, 64 - _BITMAP_BITS)
    bit = place.bitwiseAND(F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = rows.groupBy(F.shiftright(place, 6).alias("place")).agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(1 << (_BITMAP_BITS - 6), np.uint64)
    out[words["place"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _has(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    place = codes >> np.uint64(64 - _BITMAP_BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _counted(
    texts: DataFrame, size: int, least: int, part: np.ndarray, head: np.ndarray | None = None, tail: np.ndarray | None = None
) -> DataFrame:
    """Counts of the runs of ``size`` words that occur ``least`` times, as w1, w2, ..., code and a.

    Counted are runs of which all words (for ``size`` 2) or pairs are in the bitmap ``part``, and, if these are given, all but
    the last word in ``head`` or all but the first in ``tail``.
    """
    sent = texts.sparkSession.sparkContext.broadcast((part, head, tail))

    def run(batches):
        parts, heads, tails = sent.value
        tally, short = Tally(size), min(2, size - 1)
        for batch in batches:
            for _, ids, follows, _, _ in _word_ids(batch):
                number = len(ids) - size + 1
                if number <= 0:
                    continue
                good = np.ones(number, bool)
                for k in range(1, size):
                    good &= follows[k : k + number]
                at, codes = np.flatnonzero(good), _runs(ids, short)
                for k in range(size - short + 1):
                    at = at[_has(parts, codes[at + k])]
                if heads is not None:
                    codes = _runs(ids, size - 1)
                    at = at[_has(heads, codes[at]) | _has(tails, codes[at + 1])]
                if len(at):
                    signed = ids.view(np.int64)
                    tally.add(_runs(ids, size)[at], np.stack([signed[at + k] for k in range(size)], axis=1))
            if tally.held > 2 * _HELD:
                tally.combine()
                if tally.held > _HELD:
                    yield tally.rows()
        yield tally.rows()

    words = [f"w{k + 1}" for k in range(size)]
    X.small_batches(texts.sparkSession)
    found = texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*words, "code", "a"]))
    # Tasks have combined their rows, so they are shuffled as they are and summed up once.
    sums = found.repartition("code").groupBy(*words, "code").agg(F.sum("a").alias("a"))
    return sums.where(F.col("a") >= least)


def _score(a: str, first: str, rest: str) -> Column:
    """``SCALE * a / (first + rest)``, rounded down, exactly."""
    return F.expr(
        f"(CAST({a} AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(7, 0))) "
        f"DIV (CAST({first} AS DECIMAL(20, 0)) + CAST({rest} AS DECIMAL(20, 0)))"
    )


def _scored(found: DataFrame, size: int, counts: dict[int, DataFrame], name: str) -> DataFrame:
    """Phrases with lang, score, l and r of the worst cut, and the bounds of what begins and ends with them.

    Phrases with a part that has not been counted are left out: their bounds say that they score below the floor.
    """
    last = f"w{size}"
    for part in range(1, size):
        known = counts[part]
        for side, offset in (("l", 0), ("r", size - part)):
            names = {f"w{k + 1}": f"w{k + 1 + offset}" for k in range(part)}
            cut = part if side == "l" else size - part
            picked = [F.col(own).alias(f"_{own}") for own in names]
            lang = ["lang"] if part == 1 and side == "l" else []
            other = known.select(*picked, F.col("a").alias(f"{side}{cut}"), *lang)
            same = [F.col(f"_{own}") == F.col(theirs) for own, theirs in names.items()]
            found = found.join(other, same).drop(*[f"_{own}" for own in names])
    cuts = [
        F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        for k in range(1, size)
    ]
    found = found.withColumn("worst", F.array_min(F.array(*cuts)))
    words = [f"w{k + 1}" for k in range(size)]
    return materialize(
        found.select(
            "lang",
            *words,
            "code",
            "a",
            F.col("worst.l").alias("l"),
            F.col("worst.r").alias("r"),
            F.col("worst.score").alias("score"),
            _score("a", "l1", "a").alias("begins"),
            _score("a", "a", f"r{size - 1}").alias("ends"),
        ),
        name,
    )


def _floors(pairs: DataFrame, number: int) -> DataFrame:
    """Per language the largest floor that ``number`` pairs reach, or 0."""
    steps = pairs.groupBy("lang", F.floor(F.col("score") / _STEP).alias("step")).agg(F.count("*").alias("n"))
    # At most SCALE / 2 / _STEP + 1 rows a language.
    above = Window.partitionBy("lang").orderBy(F.desc("step"))
    reached = steps.withColumn("above", F.sum("n").over(above))
    floor = F.max(F.when(F.col("above") >= number, F.col("step") * _STEP))
    return reached.groupBy("lang").agg(F.coalesce(floor, F.lit(0)).alias("floor"))


def _frontier(phrases: DataFrame, open_langs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the phrases that may begin and that may end something between floor and ceiling."""
    rows = phrases.join(open_langs, "lang")
    return tuple(
        _bitmap(rows.where((F.col(bound) >= F.col("floor")) & (F.col(bound) < F.col("ceiling"))))
        for bound in ("begins", "ends")
    )


def _uncovered(phrases: DataFrame, size: int, longer: DataFrame, floors: DataFrame) -> DataFrame:
    """Phrases at or above their floor that no phrase of one more word covers.

    A longer phrase that covers a phrase implies one of a single word more that does.
    """
    words = [f"w{k + 1}" for k in range(size)]
    heads = longer.select(*words, F.col("a").alias("more"))
    tails = longer.select(*[F.col(f"w{k + 2}").alias(f"w{k + 1}") for k in range(size)], F.col("a").alias("more"))
    most = heads.union(tails).groupBy(*words).agg(F.max("more").alias("more"))
    good = phrases.join(floors, "lang").where(F.col("score") >= F.col("floor"))
    covered = F.coalesce(100 * F.col("more") >= COVERED * F.col("a"), F.lit(False))
    return good.join(most, words, "left").where(~covered)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    top: int = TOP,
    least: int = LEAST,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, its count ``a``, the counts ``l`` and ``r`` of the
    parts of its worst cut, ``n``, all words of the language, and ``score``.

    Words are compared by 64-bit hashes after A-Z are lower-cased. A phrase does not go beyond ``.,;:!?`` or a line break. Phrases
    rank by score, count and the bytes of their text. Null and empty texts have no words; a null language is
    ``und``; repeated rows count each time. A language without a phrase has no rows, and so has an empty table. Other
    columns are not read.
    """
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    X.small_batches(docs.sparkSession)
    found = texts.mapInArrow(_count_words, "lang string, word string, id long, n long")
    found = found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))
    found = materialize(found.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = found.where("word IS NULL").select("lang", "n")
    words = found.where("word IS NOT NULL").select("lang", "word", F.col("id").alias("w1"), F.col("n").alias("a"))

    counts = {1: words}
    pairs = _scored(_counted(texts, 2, least, _bitmap(words, "w1")), 2, counts, "pairs")
    counts[2] = pairs
    frequent = _bitmap(pairs)
    raw: dict[int, DataFrame] = {}
    state, number = None, 2 * top
    while True:
        wanted = _floors(pairs, number)
        if state is None:
            state = wanted.select("lang", "floor", F.lit(SCALE).cast("long").alias("ceiling"), F.lit(True).alias("open"))
        else:
            state = state.join(wanted.withColumnRenamed("floor", "wanted"), "lang")
            lower = F.greatest(F.least("wanted", F.col("floor") - _STEP), F.lit(0))
            state = state.select(
                "lang",
                F.when(F.col("open"), lower).otherwise(F.col("floor")).alias("floor"),
                F.col("floor").alias("ceiling"),
                "open",
            )
        state = materialize(state, "floors")
        growing = state.where("open").select("lang", "floor", "ceiling")
        for size in range(3, LONGEST + 1):
            shorter = counts[size - 1]
            more = _counted(texts, size, least, frequent, *_frontier(shorter, growing))
            if size in raw:
                # A run that has been counted before has the same count.
                more = raw[size].union(more).dropDuplicates([f"w{k + 1}" for k in range(size)])
            raw[size] = materialize(more, "longer")
            counts[size] = _scored(raw[size], size, counts, "scored")

        floors, survivors = state.select("lang", "floor"), None
        for size in range(2, LONGEST + 1):
            if size < LONGEST:
                good = _uncovered(counts[size], size, raw[size + 1], floors)
            else:
                good = counts[size].join(floors, "lang").where(F.col("score") >= F.col("floor"))
            padded = [F.col(f"w{k + 1}") if k < size else F.lit(None).cast("long").alias(f"w{k + 1}") for k in range(LONGEST)]
            good = good.select("lang", *padded, "a", "l", "r", "score")
            survivors = good if survivors is None else survivors.union(good)
        survivors = materialize(survivors, "survivors")
        enough = survivors.groupBy("lang").agg(F.count("*").alias("n"))
        state = state.drop("open").join(enough, "lang", "left").select(
            "lang", "floor", "ceiling", ((F.col("floor") > 0) & (F.coalesce("n", F.lit(0)) < top)).alias("open")
        )
        state = materialize(state, "floors")
        if state.where("open").isEmpty():
            break
        number *= 2

    names = words.select(F.col("w1").alias("id"), "word")
    for k in range(1, LONGEST + 1):
        own = names.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"))
        survivors = survivors.join(own, f"w{k}", "left")
    phrase = F.concat_ws(" ", *[f"word{k}" for k in range(1, LONGEST + 1)])
    survivors = survivors.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    # In two steps, so that no task ranks more than a part of a language's ties and then _SALTS * top rows.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = survivors.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    salted = salted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
