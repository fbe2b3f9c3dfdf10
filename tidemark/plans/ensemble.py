"""Cascade and blend of class probabilities, and the sweeps that tune them.

Scores travel as columns next to the user key: ``s1`` churn, ``s2`` involuntary given churn, ``m0 m1
m2`` the three-class model.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import decode
from tidemark.functions.nulls import clip
from tidemark.functions.numeric import first_argmax, normalised
from tidemark.plans.metrics import weighted_f1
from tidemark.schemas import CLASSES, KEY, LABEL

# The grids of the three sweeps and the defaults they start from.
THRESHOLDS = [0.20 + i * 0.02 for i in range(23)]
ALPHAS = [i * 0.05 for i in range(21)]
SCALES = [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5]
DEFAULT_THRESHOLD = 0.5
DEFAULT_ALPHA = 0.8
NO_SCALE = 1.0
UNDECIDED = 0.5

MULTICLASS = ("m0", "m1", "m2")


# Marks a candidate that holds out no fold.
NONE = -1


class Tuning(NamedTuple):
    """The values chosen by the sweeps, and the weighted F1 that each sweep has reached with its choice."""

    threshold: float
    alpha: float
    scale: float
    threshold_f1: float | None = None
    alpha_f1: float | None = None
    scale_f1: float | None = None


class Candidate(NamedTuple):
    """One point of a sweep; ``scale`` None leaves the blend unscaled."""

    holdout: int
    step: int
    threshold: float
    alpha: float
    scale: float | None


def cascade(churn: Column, invol: Column) -> list[Column]:
    """Class probabilities of the two stages: stay, leave by choice, leave by payment failure."""
    return [1.0 - churn, churn * (1.0 - invol), churn * invol]


def soften(score: Column, threshold: Column) -> Column:
    """Rescale so that ``threshold`` becomes one half, clipped to 0..1."""
    return clip(score / (threshold * 2.0), 0.0, 1.0)


def blend(threshold: Column, alpha: Column) -> list[Column]:
    """Mix of the cascade at ``threshold`` and the three-class model."""
    two_stage = cascade(soften(F.col("s1"), threshold), F.col("s2"))
    return [alpha * c + (1.0 - alpha) * F.col(m) for c, m in zip(two_stage, MULTICLASS)]


def scaled(scores: Sequence[Column], scale: Column) -> list[Column]:
    """Weigh the voluntary class and normalise again."""
    stay, leave, fail = scores
    return normalised([stay, leave * scale, fail])


def with_second_stage(rows: DataFrame, second: DataFrame, key: str = KEY) -> DataFrame:
    """Attach stage-2 scores; users without one get an undecided 0.5."""
    return rows.join(second.select(key, "s2"), key, "left").withColumn(
        "s2", F.coalesce("s2", F.lit(UNDECIDED))
    )


def sweep(scores: DataFrame, candidates: Sequence[Candidate], fold: str | None = None) -> DataFrame:
    """Weighted F1 of every candidate: holdout, step, threshold, alpha, scale, f1.

    Each row meets the whole grid inside its task and the aggregate folds the outcomes into a few
    counts per candidate before the shuffle. With ``fold``, a candidate skips the rows of the fold it
    holds out.
    """
    rows = scores.select("*", F.inline(_literal(candidates)))
    if fold is not None:
        rows = rows.where(F.col(fold) != F.col("holdout"))
    return weighted_f1(rows.withColumn("pred", _predict()), by=list(Candidate._fields))


def _literal(candidates: Sequence[Candidate]) -> Column:
    def struct(c: Candidate) -> str:
        scale = "CAST(NULL AS DOUBLE)" if c.scale is None else f"{c.scale!r}D"
        return (
            f"named_struct('holdout', {c.holdout}, 'step', {c.step}, 'threshold', {c.threshold!r}D,"
            f" 'alpha', {c.alpha!r}D, 'scale', {scale})"
        )

    return F.expr(f"array({', '.join(struct(c) for c in candidates)})")


def _predict() -> Column:
    """Class called by the candidate in the row; no scale leaves the blend as it is."""
    mixed = blend(F.col("threshold"), F.col("alpha"))
    weighed = first_argmax(scaled(mixed, F.col("scale")))
    return F.when(F.col("scale").isNull(), first_argmax(mixed)).otherwise(weighed)


def threshold_grid(holdout: int = NONE, alpha: float = DEFAULT_ALPHA) -> list[Candidate]:
    return [Candidate(holdout, i, t, alpha, None) for i, t in enumerate(THRESHOLDS)]


def alpha_grid(threshold: float, holdout: int = NONE) -> list[Candidate]:
    return [Candidate(holdout, i, threshold, a, None) for i, a in enumerate(ALPHAS)]


def scale_grid(threshold: float, alpha: float, holdout: int = NONE) -> list[Candidate]:
    """Step 0 is the unscaled blend, which a scale has to beat."""
    return [
        Candidate(holdout, i, threshold, alpha, s) for i, s in enumerate([None, *SCALES])
    ]


def _winners(
    scores: DataFrame, grids: Sequence[Sequence[Candidate]], fold: str | None
) -> dict[int, tuple[float, Candidate]]:
    """Best F1 and candidate per holdout, the first on a tie; at most one row per candidate is collected."""
    found: dict[int, tuple[float, Candidate]] = {}
    outcome = sweep(scores, [c for grid in grids for c in grid], fold)
    for row in sorted(outcome.where(F.col("f1") > 0).collect(), key=lambda r: r["step"]):
        candidate = Candidate(*[row[f] for f in Candidate._fields])
        if row["f1"] > found.get(candidate.holdout, (0.0, None))[0]:
            found[candidate.holdout] = (row["f1"], candidate)
    return found


def _tune_each(scores: DataFrame, holdouts: Sequence[int], fold: str | None) -> dict[int, Tuning]:
    """Threshold, then alpha, then scale; each sweep serves all holdouts in one job."""
    best = {h: Candidate(h, 0, DEFAULT_THRESHOLD, DEFAULT_ALPHA, None) for h in holdouts}
    reached: dict[int, list[float | None]] = {h: [] for h in holdouts}
    for grid in (
        lambda h: threshold_grid(h),
        lambda h: alpha_grid(best[h].threshold, h),
        lambda h: scale_grid(best[h].threshold, best[h].alpha, h),
    ):
        found = _winners(scores, [grid(h) for h in holdouts], fold)
        for h in holdouts:
            f1, best[h] = found.get(h, (None, best[h]))
            reached[h].append(f1)
    return {h: Tuning(c.threshold, c.alpha, c.scale or NO_SCALE, *reached[h]) for h, c in best.items()}


def tune(scores: DataFrame) -> Tuning:
    """The three sweeps in turn over all rows."""
    return _tune_each(scores, [NONE], None)[NONE]


def nested_f1(scores: DataFrame, fold: str = "fold", folds: int = 5) -> DataFrame:
    """Weighted F1 with every fold called by the tuning of the other folds."""
    tuned = _tune_each(scores, range(folds), fold)
    candidates = [
        Candidate(h, 0, t.threshold, t.alpha, None if t.scale == NO_SCALE else t.scale)
        for h, t in tuned.items()
    ]
    rows = scores.select("*", F.inline(_literal(candidates))).where(F.col(fold) == F.col("holdout"))
    return weighted_f1(rows.withColumn("pred", _predict()))


def probabilities(scores: DataFrame, tuning: Tuning) -> DataFrame:
    """Final class probabilities ``p0 p1 p2`` and the predicted class ``pred``."""
    mixed = blend(F.lit(tuning.threshold), F.lit(tuning.alpha))
    if tuning.scale != NO_SCALE:
        mixed = scaled(mixed, F.lit(tuning.scale))
    out = scores.withColumns({f"p{i}": p for i, p in enumerate(mixed)})
    return out.withColumn("pred", first_argmax([F.col("p0"), F.col("p1"), F.col("p2")]))


def submission(scored: DataFrame, key: str = KEY) -> DataFrame:
    return scored.select(key, decode(F.col("pred")).alias(LABEL))


def probability_table(scored: DataFrame, key: str = KEY) -> DataFrame:
    named = [F.col(f"p{i}").alias(f"prob_{name}") for i, name in enumerate(CLASSES)]
    return scored.select(*named, key, decode(F.col("pred")).alias(LABEL))
