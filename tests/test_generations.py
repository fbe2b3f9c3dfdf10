"""Generation features against plain pandas per user."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import by_key, ts

from tidemark.plans.generations import from_rollup, generation_features, on_arc
from tidemark.schemas import GENERATION_FEATURES, names

EVENT = "user_id string, created_at timestamp_ntz, status string, generation_type string, credit_cost double, duration double"
PROPERTY = "user_id string, subscription_start_date timestamp_ntz"
START = dt.datetime(2024, 3, 1, 15, 30)


def random_events(seed, users=25):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        for _ in range(rng.choice([1, 2, 3, 8, 40])):
            at = START + dt.timedelta(seconds=rng.randint(-3 * 86400, 18 * 86400))
            rows.append(
                (
                    f"u{u}",
                    None if rng.random() < 0.1 else at,
                    rng.choice(["completed", "completed", "failed", "nsfw", "canceled", "odd", None]),
                    rng.choice(["video_a", "video_b", "image", "text", None]),
                    None if rng.random() < 0.2 else rng.randint(0, 200) / 4,
                    None if rng.random() < 0.2 else rng.randint(0, 90) / 2,
                )
            )
    starts = [(f"u{u}", None if u % 7 == 3 else START) for u in range(users) if u % 9 != 4]
    return rows, starts


def expected(rows, starts, window):
    """Straightforward per-user computation."""
    start = dict(starts)
    columns = ["user_id", "at", "status", "kind", "credit", "duration"]
    events = pd.DataFrame(rows, columns=columns)
    events["at"] = pd.to_datetime(events["at"])
    out = {}
    for user, g in events.groupby("user_id"):
        begin = start.get(user)
        raw = [
            None if begin is None or pd.isna(a) else math.floor((a - begin).total_seconds() / 86400)
            for a in g["at"]
        ]
        g = g.assign(day=[None if d is None else min(max(d, 0), 13) for d in raw])
        if window == "filter":
            g = g[[d is not None and 0 <= d <= 13 for d in raw]]
            if g.empty:
                continue
        n = len(g)
        f = {"gen_total": n}
        done = g["status"] == "completed"
        f["gen_completed"], f["gen_failed"] = done.sum(), (g["status"] == "failed").sum()
        f["gen_nsfw"], f["gen_canceled"] = (g["status"] == "nsfw").sum(), (g["status"] == "canceled").sum()
        for rate, count in (("completion", "completed"), ("fail", "failed"), ("nsfw", "nsfw"), ("cancel", "canceled")):
            f[f"gen_{rate}_rate"] = f[f"gen_{count}"] / n
        for source, name in (("credit", "credit"), ("duration", "duration")):
            x = g[source].dropna()
            f[f"gen_{name}_{'total' if name == 'credit' else 'sum'}"] = x.sum()
            f[f"gen_{name}_mean"] = x.mean() if len(x) else None
            f[f"gen_{name}_max"] = x.max() if len(x) else None
            f[f"gen_{name}_std"] = x.std() if len(x) > 1 else None
        dates = g["at"].dropna().dt.date
        f["gen_days_active"] = dates.nunique()
        f["gen_max_in_day"] = dates.value_counts().max() if len(dates) else None
        f["gen_types_unique"] = g["kind"].dropna().nunique()
        f["gen_per_active_day"] = n / max(f["gen_days_active"], 1)
        hours = lambda a, b: (b - a).total_seconds() / 3600
        first, last = g["at"].min(), g["at"].max()
        f["gen_span_hours"] = None if pd.isna(first) else hours(first, last)
        f["gen_first_latency_h"] = None if pd.isna(first) or begin is None else hours(begin, first)
        video = g["kind"].str.startswith("video", na=False).astype(bool)
        f["gen_video_count"] = video.sum()
        f["gen_image_count"] = g["kind"].str.startswith("image", na=False).sum()
        f["gen_video_ratio"] = f["gen_video_count"] / n
        f["gen_video_credit_ratio"] = (
            g["credit"][video].sum() / max(f["gen_credit_total"], 0.1) if video.any() else None
        )
        pick = lambda lo, hi: g["day"].apply(lambda d: d is not None and lo <= d <= hi).astype(bool)
        some = lambda m, v: v if m.any() else None
        for q, (lo, hi) in {"q1": (0, 3), "q2": (4, 6), "q3": (7, 10), "q4": (11, 13)}.items():
            m = pick(lo, hi)
            f[f"gen_{q}_count"] = some(m, m.sum())
            f[f"gen_{q}_credits"] = some(m, g["credit"][m].sum())
            f[f"gen_{q}_compl"] = some(m, done[m].mean())
        early, late, tail = pick(0, 6), pick(7, 13), pick(11, 13)
        f["gen_early_count"], f["gen_late_count"] = some(early, early.sum()), some(late, late.sum())
        f["gen_credit_early"] = some(early, g["credit"][early].sum())
        f["gen_credit_late"] = some(late, g["credit"][late].sum())
        f["gen_last3_count"] = some(tail, tail.sum())
        f["gen_last3_frac"] = some(tail, tail.sum() / n)
        both = early.any() and late.any()
        f["gen_credit_vel_ratio"] = f["gen_credit_early"] / max(f["gen_credit_late"], 0.1) if both else None
        f["gen_compl_trend"] = done[late].mean() - done[early].mean() if both else None
        daily = g["day"].dropna().astype(int).value_counts().sort_index()
        f["gen_activity_slope"] = f["gen_activity_cliff"] = f["gen_peak_day"] = None
        if len(daily):
            f["gen_peak_day"] = daily.index[np.argmax(daily.values)]
            many = len(daily) > 1
            f["gen_activity_slope"] = np.polyfit(daily.index, daily.values, 1)[0] if many else 0.0
            f["gen_activity_cliff"] = np.diff(daily.values).min() if many else 0.0
        out[user] = f
    return out


def same(got, want):
    if want is None or (isinstance(want, float) and math.isnan(want)):
        return got is None
    return got is not None and got == pytest.approx(float(want), abs=1e-9, rel=1e-9)


@pytest.mark.parametrize("window", ["clip", "filter"])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_features_match_brute_force(spark, seed, window):
    rows, starts = random_events(seed)
    gen, props = spark.createDataFrame(rows, EVENT), spark.createDataFrame(starts, PROPERTY)
    df = generation_features(gen, props, window=window)
    assert df.columns == ["user_id", *names(GENERATION_FEATURES)]
    got, want = by_key(df), expected(rows, starts, window)
    assert got.keys() == want.keys()
    for user in want:
        assert want[user].keys() == set(names(GENERATION_FEATURES))
        wrong = {f: (got[user][f], v) for f, v in want[user].items() if not same(got[user][f], v)}
        assert not wrong, (user, wrong)


def one_user(spark, rows, start="2024-01-01"):
    gen = spark.createDataFrame([("a", ts(t), s, k, c, d) for t, s, k, c, d in rows], EVENT)
    props = spark.createDataFrame([("a", ts(start))], PROPERTY)
    return generation_features(gen, props).first()


def test_single_active_day(spark):
    r = one_user(spark, [("2024-01-03 10:00", "completed", "video_x", 2.0, 1.0)] * 3)
    assert (r["gen_activity_slope"], r["gen_activity_cliff"], r["gen_peak_day"]) == (0.0, 0.0, 2)
    assert r["gen_credit_vel_ratio"] is None and r["gen_late_count"] is None
    assert r["gen_credit_std"] == 0.0


def test_no_time_at_all(spark):
    r = one_user(spark, [(None, None, None, None, None)])
    assert r["gen_total"] == 1 and r["gen_days_active"] == 0 and r["gen_types_unique"] == 0
    assert r["gen_max_in_day"] is None and r["gen_activity_slope"] is None and r["gen_peak_day"] is None
    assert r["gen_per_active_day"] == 1.0 and r["gen_credit_total"] == 0.0


def test_peak_takes_the_earliest_of_equal_days(spark):
    days = ["2024-01-09", "2024-01-09", "2024-01-02", "2024-01-02", "2024-01-05"]
    r = one_user(spark, [(d, "completed", "text", 1.0, 1.0) for d in days])
    assert r["gen_peak_day"] == 1


def test_drop_may_be_a_rise(spark):
    days = ["2024-01-01"] + ["2024-01-04"] * 3
    r = one_user(spark, [(d, "completed", "text", 1.0, 1.0) for d in days])
    assert r["gen_activity_cliff"] == 2.0


def test_unknown_window_is_refused(spark):
    gen, props = spark.createDataFrame([], EVENT), spark.createDataFrame([], PROPERTY)
    with pytest.raises(ValueError):
        on_arc(gen, props, window="drop")


def test_row_order_and_partitioning_do_not_matter(spark):
    rows, starts = random_events(5)
    props = spark.createDataFrame(starts, PROPERTY)
    plain = by_key(generation_features(spark.createDataFrame(rows, EVENT), props))
    random.Random(0).shuffle(rows)
    other = by_key(generation_features(spark.createDataFrame(rows, EVENT).repartition(13), props))
    assert plain.keys() == other.keys()
    for user, f in plain.items():
        assert all(same(other[user][c], f[c]) for c in names(GENERATION_FEATURES))


def test_shuffle_join_gives_the_same_result(spark, no_broadcast):
    rows, starts = random_events(1)
    gen, props = spark.createDataFrame(rows, EVENT), spark.createDataFrame(starts, PROPERTY)
    got, want = by_key(from_rollup(on_arc(gen, props))), expected(rows, starts, "clip")
    assert all(same(f["gen_credit_early"], want[u]["gen_credit_early"]) for u, f in got.items())
