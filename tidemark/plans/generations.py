"""Generation behaviour: one row per user from the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import nulls
from tidemark.functions.nulls import is_true, per, sum_or_zero, when_any
from tidemark.functions.text import starts_with
from tidemark.functions.time import hours_between, parse, whole_days
from tidemark.operators import arc, counts
from tidemark.schemas import (
    ARC_BUCKETS,
    ARC_DAYS,
    GENERATION_FEATURES,
    KEY,
    LAST_DAYS_FROM,
    LATE_FROM_DAY,
    names,
)

# Statuses counted per user and the output each feeds.
STATUSES = {
    "completed": "gen_completed",
    "failed": "gen_failed",
    "nsfw": "gen_nsfw",
    "canceled": "gen_canceled",
}
RATES = {
    "gen_completion_rate": "gen_completed",
    "gen_fail_rate": "gen_failed",
    "gen_nsfw_rate": "gen_nsfw",
    "gen_cancel_rate": "gen_canceled",
}
# Features that need the counts per calendar date or per type; all others come from one aggregate.
BY_VALUE = ("gen_days_active", "gen_max_in_day", "gen_types_unique", "gen_per_active_day")


def on_arc(
    generations: DataFrame, properties: DataFrame, key: str = KEY, window: str = "clip"
) -> DataFrame:
    """Attach the subscription start and the arc day to every event.

    ``clip`` moves events outside the arc to its first or last day; ``filter`` keeps only events inside.
    The lookup side is only the key and the start, so that it stays small enough to broadcast for as
    long as possible. The join carries no hint: beyond the threshold AQE splits the partitions of
    hot users, after which the aggregate above runs partial-first.
    """
    starts = properties.select(key, parse(F.col("subscription_start_date")).alias("sub_start"))
    events = generations.join(starts, key, "left")
    day = whole_days(F.col("sub_start"), F.col("created_at"))
    if window == "filter":
        events = events.where(day.between(0, ARC_DAYS - 1))
    elif window != "clip":
        raise ValueError(f"window must be 'clip' or 'filter', not {window!r}")
    return events.withColumn("day", nulls.clip(day, lo=0, hi=ARC_DAYS - 1))


DAYS = [f"day_{d}" for d in range(ARC_DAYS)]


def daily_counts(events: DataFrame, key: str = KEY) -> DataFrame:
    """Events per user and arc day, one column per day."""
    return events.groupBy(key).agg(*_daily())


def _daily() -> list[Column]:
    return [F.count_if(F.col("day") == d).alias(name) for d, name in enumerate(DAYS)]


def _rollup(events: DataFrame, key: str) -> DataFrame:
    """The one wide aggregate: plain, conditional and daily measures side by side."""
    status, kind = F.col("status"), F.col("generation_type")
    credit, duration, day = F.col("credit_cost"), F.col("duration"), F.col("day")
    done = is_true(status == "completed")
    video = starts_with(kind, "video")

    measures = [F.count(F.lit(1)).alias("gen_total")]
    measures += [F.count_if(status == s).alias(out) for s, out in STATUSES.items()]
    measures += [
        sum_or_zero(credit).alias("gen_credit_total"),
        F.avg(credit).alias("gen_credit_mean"),
        F.max(credit).alias("gen_credit_max"),
        F.stddev_samp(credit).alias("gen_credit_std"),
        F.avg(duration).alias("gen_duration_mean"),
        F.max(duration).alias("gen_duration_max"),
        sum_or_zero(duration).alias("gen_duration_sum"),
        F.stddev_samp(duration).alias("gen_duration_std"),
        F.count_if(video).alias("gen_video_count"),
        F.count_if(starts_with(kind, "image")).alias("gen_image_count"),
        sum_or_zero(F.when(video, credit)).alias("video_credits"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.min("sub_start").alias("sub_start"),
    ]
    for bucket, (lo, hi) in ARC_BUCKETS.items():
        inside = day.between(lo, hi)
        measures += [
            sum_or_zero(F.when(inside, credit)).alias(f"{bucket}_credits"),
            F.count_if(inside & done).alias(f"{bucket}_done"),
        ]
    return events.groupBy(key).agg(*measures, *_daily())


def _days(lo: int, hi: int = ARC_DAYS - 1) -> Column:
    return arc.total(DAYS[lo : hi + 1])


def _with_arc_counts(rollup: DataFrame) -> DataFrame:
    """Row counts per bucket and half, and the sums behind the trend, as columns."""
    parts = {f"n_{bucket}": _days(lo, hi) for bucket, (lo, hi) in ARC_BUCKETS.items()}
    parts["n_early"], parts["n_late"] = _days(0, LATE_FROM_DAY - 1), _days(LATE_FROM_DAY)
    parts["n_last"] = _days(LAST_DAYS_FROM)
    for half, wanted in (("early", lambda hi: hi < LATE_FROM_DAY), ("late", lambda hi: hi >= LATE_FROM_DAY)):
        buckets = [b for b, (_, hi) in ARC_BUCKETS.items() if wanted(hi)]
        for measure in ("credits", "done"):
            parts[f"{half}_{measure}"] = arc.total([f"{b}_{measure}" for b in buckets])
    return rollup.withColumns({**parts, **arc.moments(DAYS)})


# Measures that are added up when states meet; the others are in the two lists below and the moments.
_ADDED = (
    "gen_total", *STATUSES.values(), "gen_credit_total", "gen_duration_sum", "gen_video_count", "gen_image_count",
    "video_credits", *[f"{b}_{m}" for b in ARC_BUCKETS for m in ("credits", "done")], *DAYS,
)
_LARGEST = ("gen_credit_max", "gen_duration_max", "last_at")
_SMALLEST = ("first_at", "sub_start")
_MOMENTS = {"credit": ("gen_credit_total", "gen_credit_mean", "gen_credit_std"), "duration": ("gen_duration_sum", "gen_duration_mean", "gen_duration_std")}


def rollup_states(events: DataFrame, key: str = KEY) -> DataFrame:
    """The wide aggregate of some of the events in a form that can be merged with that of others.

    In place of mean and deviation there are the number of values, their sum, and ``m2``, the sum of squared distances from
    the mean of these events.
    """
    base = _rollup(events, key)
    moments = []
    for name in _MOMENTS:
        column = F.col({"credit": "credit_cost", "duration": "duration"}[name])
        moments += [F.count(column).alias(f"n_{name}"), (F.var_pop(column) * F.count(column)).alias(f"m2_{name}")]
    spread = events.groupBy(key).agg(*moments)
    drop = [c for _, mean, std in _MOMENTS.values() for c in (mean, std)]
    return base.drop(*drop).join(spread, key)


def merge_rollups(states: DataFrame, key: str = KEY) -> DataFrame:
    """The wide aggregate of all events from the states of their parts, by one aggregate.

    Squared distances of the parts add up to that of the whole once the distance between their means is added.
    """
    measures = [F.sum(c).alias(c) for c in _ADDED]
    measures += [F.max(c).alias(c) for c in _LARGEST] + [F.min(c).alias(c) for c in _SMALLEST]
    for name, (total, _, _) in _MOMENTS.items():
        n, sum_ = F.col(f"n_{name}"), F.col(total)
        measures += [
            F.sum(n).alias(f"n_{name}"),
            F.sum(f"m2_{name}").alias(f"m2_{name}"),
            F.sum(F.when(n > 0, sum_ * sum_ / n)).alias(f"between_{name}"),
        ]
    merged = states.groupBy(key).agg(*measures)
    for name, (total, mean, std) in _MOMENTS.items():
        n = F.col(f"n_{name}")
        squares = F.col(f"m2_{name}") + F.col(f"between_{name}") - F.col(total) * F.col(total) / n
        merged = merged.withColumn(mean, F.when(n > 0, F.col(total) / n))
        merged = merged.withColumn(std, F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1))))
        merged = merged.drop(f"n_{name}", f"m2_{name}", f"between_{name}")
    return merged


def value_states(generations: DataFrame, key: str = KEY, bucketed: bool = False) -> DataFrame:
    """Rows per user and date or type; states of several parts are added up."""
    columns = {"date": F.to_date("created_at"), "type": F.col("generation_type")}
    return counts.value_counts(generations, key, columns, bucketed)


def from_states(rollups: DataFrame, values: DataFrame, key: str = KEY) -> DataFrame:
    """All 50 generation features from the states of all parts."""
    merged = values.groupBy(key, "date", "type").agg(F.sum("n").alias("n"))
    joined = _features(merge_rollups(rollups, key), key).join(_by_value(merged, key), key, "left")
    return _with_pace(joined, key)


def from_rollup(events: DataFrame, key: str = KEY) -> DataFrame:
    """Every generation feature that needs no count per date or type."""
    return _features(_rollup(events, key), key)


def _features(rollup: DataFrame, key: str) -> DataFrame:
    r = _with_arc_counts(rollup)
    c = F.col
    total, n_early, n_late, n_last = c("gen_total"), c("n_early"), c("n_late"), c("n_last")
    both = (n_early > 0) & (n_late > 0)

    out = {name: per(c(count), total) for name, count in RATES.items()}
    out["gen_span_hours"] = hours_between(c("first_at"), c("last_at"))
    out["gen_video_ratio"] = per(c("gen_video_count"), total)
    for bucket in ARC_BUCKETS:
        n = c(f"n_{bucket}")
        out[f"gen_{bucket}_count"] = when_any(n, n)
        out[f"gen_{bucket}_credits"] = when_any(n, c(f"{bucket}_credits"))
        out[f"gen_{bucket}_compl"] = when_any(n, per(c(f"{bucket}_done"), n))
    out["gen_credit_early"] = when_any(n_early, c("early_credits"))
    out["gen_credit_late"] = when_any(n_late, c("late_credits"))
    out["gen_credit_vel_ratio"] = F.when(
        both, c("early_credits") / nulls.clip(c("late_credits"), lo=0.1)
    )
    out["gen_early_count"] = when_any(n_early, n_early)
    out["gen_late_count"] = when_any(n_late, n_late)
    out["gen_activity_slope"] = arc.slope()
    out["gen_peak_day"] = arc.peak_day(DAYS)
    out["gen_activity_cliff"] = arc.steepest_drop()
    out["gen_last3_count"] = when_any(n_last, n_last)
    out["gen_last3_frac"] = when_any(n_last, per(n_last, total))
    out["gen_first_latency_h"] = hours_between(c("sub_start"), c("first_at"))
    out["gen_compl_trend"] = F.when(
        both, per(c("late_done"), n_late) - per(c("early_done"), n_early)
    )
    out["gen_video_credit_ratio"] = when_any(
        c("gen_video_count"), c("video_credits") / nulls.clip(c("gen_credit_total"), lo=0.1)
    )
    wanted = [n for n in names(GENERATION_FEATURES) if n not in BY_VALUE]
    return r.select(key, *[out[n].alias(n) if n in out else c(n) for n in wanted])


def from_value_counts(generations: DataFrame, key: str = KEY, bucketed: bool = False) -> DataFrame:
    """Active days, busiest day and distinct types of every user with events."""
    return _by_value(value_states(generations, key, bucketed), key)


def _by_value(counted: DataFrame, key: str) -> DataFrame:
    return counted.groupBy(key).agg(
        counts.distinct_values("date").alias("gen_days_active"),
        counts.busiest("date").alias("gen_max_in_day"),
        counts.distinct_values("type").alias("gen_types_unique"),
    )


def generation_features(
    generations: DataFrame, properties: DataFrame, key: str = KEY, window: str = "clip", bucketed: bool = False
) -> DataFrame:
    """All 50 generation features, one row per user with events. ``bucketed`` is for tables stored in buckets of the key.

    Both sides are grouped by the key, so joining them needs no further exchange.
    """
    events = on_arc(generations, properties, key, window)
    counted = events if window == "filter" else generations
    joined = from_rollup(events, key).join(from_value_counts(counted, key, bucketed), key, "left")
    return _with_pace(joined, key)


def _with_pace(joined: DataFrame, key: str) -> DataFrame:
    pace = per(F.col("gen_total"), F.col("gen_days_active"))
    return joined.withColumn("gen_per_active_day", pace).select(key, *names(GENERATION_FEATURES))
