"""Expected results in DuckDB SQL over the provided tables.

Written per user and per row in the most direct form, independent of how Spark computes the results.
Each query is a SELECT over named pieces; the pieces it needs are put in front of it as a WITH list.
"""

from __future__ import annotations

import re

from catalogue import fixtures

# Column names, stated here so that the engine cannot vouch for itself.
_FEATURES = """
    prop_plan prop_country prop_tier prop_dow prop_month prop_day gen_total gen_completed gen_failed
    gen_nsfw gen_canceled gen_credit_total gen_credit_mean gen_credit_max gen_credit_std
    gen_days_active gen_types_unique gen_max_in_day gen_span_hours gen_completion_rate gen_fail_rate
    gen_nsfw_rate gen_cancel_rate gen_video_count gen_image_count gen_video_ratio gen_per_active_day
    gen_duration_mean gen_duration_max gen_duration_sum gen_duration_std gen_q1_count gen_q1_credits
    gen_q1_compl gen_q2_count gen_q2_credits gen_q2_compl gen_q3_count gen_q3_credits gen_q3_compl
    gen_q4_count gen_q4_credits gen_q4_compl gen_credit_early gen_credit_late gen_credit_vel_ratio
    gen_early_count gen_late_count gen_activity_slope gen_peak_day gen_activity_cliff
    gen_last3_count gen_last3_frac gen_first_latency_h gen_compl_trend gen_video_credit_ratio
    purch_count purch_total purch_mean purch_types purch_credit_packs q_source q_flow_type
    q_team_size q_experience q_usage_plan q_frustration q_first_feature q_role qf_cost qf_incon
    qf_limited qf_prompt qf_other ta_total ta_failed_count ta_success_count ta_fail_rate
    ta_card_declined ta_cvc_fail ta_expired ta_auth_req ta_is_prepaid ta_is_virtual ta_is_business
    ta_is_3ds ta_3ds_auth ta_amount_total ta_amount_mean ta_amount_max ta_last_failed
    ta_ctry_mismatch ta_max_consec_fail ta_max_retries ta_cvc_pass ta_card_funding ta_card_brand
    ta_payment_method ta_bank_country ta_card_country has_gen has_tx has_purch invol_risk vol_risk
    engagement plan_x_engagement gen_front_ratio gen_back_ratio
""".split()
_ZERO_FILLED = """
    gen_total gen_completed gen_failed gen_nsfw gen_canceled gen_credit_total gen_days_active
    gen_max_in_day gen_completion_rate gen_fail_rate gen_nsfw_rate gen_cancel_rate gen_video_count
    gen_image_count gen_video_ratio gen_per_active_day gen_q1_count gen_q1_credits gen_q1_compl
    gen_q2_count gen_q2_credits gen_q2_compl gen_q3_count gen_q3_credits gen_q3_compl gen_q4_count
    gen_q4_credits gen_q4_compl gen_credit_early gen_credit_late gen_early_count gen_late_count
    gen_last3_count gen_last3_frac purch_count purch_total purch_credit_packs qf_cost qf_incon
    qf_limited qf_prompt qf_other ta_total ta_failed_count ta_success_count ta_fail_rate
    ta_card_declined ta_cvc_fail ta_expired ta_is_prepaid ta_is_virtual ta_ctry_mismatch
    ta_max_consec_fail ta_max_retries
""".split()
_CATEGORICAL = """
    prop_plan prop_country q_source q_flow_type q_team_size q_experience q_usage_plan q_frustration
    q_first_feature q_role ta_card_funding ta_card_brand ta_payment_method ta_bank_country
    ta_card_country
""".split()
_TARGETS = """
    is_churned is_vol is_invol
""".split()
_TARGET_ENCODED = """
    prop_country prop_plan q_source q_frustration q_role q_usage_plan q_first_feature
""".split()

PIECES: dict[str, str] = {f"fx_{view}": fixtures.duckdb_sql(view) for view in fixtures.VIEWS}

PIECES["gen"] = """
SELECT *, CASE WHEN raw_day < 0 THEN 0 WHEN raw_day > 13 THEN 13 ELSE raw_day END AS day,
  CAST(created_at AS DATE) AS gen_date,
  COALESCE(status = 'completed', FALSE) AS done,
  COALESCE(starts_with(generation_type, 'video'), FALSE) AS is_video,
  COALESCE(starts_with(generation_type, 'image'), FALSE) AS is_image
FROM (
  SELECT g.*, CAST(p.subscription_start_date AS TIMESTAMP) AS sub_start,
    CAST(FLOOR(date_diff('microsecond', CAST(p.subscription_start_date AS TIMESTAMP), g.created_at) / 86400000000.0) AS INTEGER) AS raw_day
  FROM fx_generations g LEFT JOIN fx_properties p ON g.user_id = p.user_id
) e"""

PIECES["gen_day"] = """
SELECT user_id, day, COUNT(*) AS cnt FROM gen WHERE day IS NOT NULL GROUP BY user_id, day"""

PIECES["gen_trend"] = """
SELECT user_id,
  CASE WHEN COUNT(*) = 1 THEN 0.0 ELSE regr_slope(cnt, day) END AS gen_activity_slope
FROM gen_day GROUP BY user_id"""

PIECES["gen_peak"] = """
SELECT user_id, day AS gen_peak_day FROM gen_day
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY cnt DESC, day) = 1"""

PIECES["gen_drop"] = """
SELECT user_id, COALESCE(MIN(change), 0.0) AS gen_activity_cliff FROM (
  SELECT user_id, CAST(cnt - LAG(cnt) OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS change FROM gen_day
) c GROUP BY user_id"""

PIECES["gen_busy"] = """
SELECT user_id, MAX(n) AS gen_max_in_day FROM (
  SELECT user_id, gen_date, COUNT(*) AS n FROM gen WHERE gen_date IS NOT NULL GROUP BY user_id, gen_date
) d GROUP BY user_id"""


def _bucket(name: str, lo: int, hi: int) -> str:
    inside = f"FILTER (WHERE day BETWEEN {lo} AND {hi})"
    n = f"COUNT(*) {inside}"
    return f"""
  NULLIF({n}, 0) AS gen_{name}_count,
  CASE WHEN {n} > 0 THEN COALESCE(SUM(credit_cost) {inside}, 0) END AS gen_{name}_credits,
  AVG(CAST(done AS DOUBLE)) {inside} AS gen_{name}_compl,"""


PIECES["gen_user"] = f"""
SELECT user_id, COUNT(*) AS gen_total,
  COUNT(*) FILTER (WHERE status = 'completed') AS gen_completed,
  COUNT(*) FILTER (WHERE status = 'failed') AS gen_failed,
  COUNT(*) FILTER (WHERE status = 'nsfw') AS gen_nsfw,
  COUNT(*) FILTER (WHERE status = 'canceled') AS gen_canceled,
  COALESCE(SUM(credit_cost), 0) AS gen_credit_total, AVG(credit_cost) AS gen_credit_mean,
  MAX(credit_cost) AS gen_credit_max, STDDEV_SAMP(credit_cost) AS gen_credit_std,
  COUNT(DISTINCT gen_date) AS gen_days_active, COUNT(DISTINCT generation_type) AS gen_types_unique,
  date_diff('microsecond', MIN(created_at), MAX(created_at)) / 3600000000.0 AS gen_span_hours,
  gen_completed / gen_total AS gen_completion_rate, gen_failed / gen_total AS gen_fail_rate,
  gen_nsfw / gen_total AS gen_nsfw_rate, gen_canceled / gen_total AS gen_cancel_rate,
  COUNT(*) FILTER (WHERE is_video) AS gen_video_count, COUNT(*) FILTER (WHERE is_image) AS gen_image_count,
  gen_video_count / gen_total AS gen_video_ratio,
  gen_total / GREATEST(gen_days_active, 1) AS gen_per_active_day,
  AVG(duration) AS gen_duration_mean, MAX(duration) AS gen_duration_max,
  COALESCE(SUM(duration), 0) AS gen_duration_sum, STDDEV_SAMP(duration) AS gen_duration_std,
  {_bucket("q1", 0, 3)}{_bucket("q2", 4, 6)}{_bucket("q3", 7, 10)}{_bucket("q4", 11, 13)}
  CASE WHEN COUNT(*) FILTER (WHERE day <= 6) > 0 THEN COALESCE(SUM(credit_cost) FILTER (WHERE day <= 6), 0) END AS gen_credit_early,
  CASE WHEN COUNT(*) FILTER (WHERE day >= 7) > 0 THEN COALESCE(SUM(credit_cost) FILTER (WHERE day >= 7), 0) END AS gen_credit_late,
  gen_credit_early / CASE WHEN gen_credit_late < 0.1 THEN 0.1 ELSE gen_credit_late END AS gen_credit_vel_ratio,
  NULLIF(COUNT(*) FILTER (WHERE day <= 6), 0) AS gen_early_count,
  NULLIF(COUNT(*) FILTER (WHERE day >= 7), 0) AS gen_late_count,
  NULLIF(COUNT(*) FILTER (WHERE day >= 11), 0) AS gen_last3_count,
  gen_last3_count / gen_total AS gen_last3_frac,
  date_diff('microsecond', MIN(sub_start), MIN(created_at)) / 3600000000.0 AS gen_first_latency_h,
  AVG(CAST(done AS DOUBLE)) FILTER (WHERE day >= 7) - AVG(CAST(done AS DOUBLE)) FILTER (WHERE day <= 6) AS gen_compl_trend,
  CASE WHEN gen_video_count > 0 THEN COALESCE(SUM(credit_cost) FILTER (WHERE is_video), 0) / GREATEST(gen_credit_total, 0.1) END AS gen_video_credit_ratio
FROM gen GROUP BY user_id"""

PIECES["gen_features"] = """
SELECT u.*, t.gen_activity_slope, k.gen_peak_day, d.gen_activity_cliff, b.gen_max_in_day
FROM gen_user u LEFT JOIN gen_trend t USING (user_id) LEFT JOIN gen_peak k USING (user_id)
  LEFT JOIN gen_drop d USING (user_id) LEFT JOIN gen_busy b USING (user_id)"""

PIECES["tx_order"] = """
SELECT *, failure_code IS NOT NULL AS failed,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY transaction_time NULLS LAST, attempt_id) AS rn,
  COUNT(*) OVER (PARTITION BY user_id) AS n_all
FROM fx_transactions"""

PIECES["tx_last"] = """
SELECT user_id, CAST(failed AS DOUBLE) AS ta_last_failed FROM tx_order WHERE rn = n_all"""

PIECES["tx_run"] = """
SELECT user_id, MAX(len) AS ta_max_consec_fail FROM (
  SELECT user_id, island, COUNT(*) FILTER (WHERE failed) AS len FROM (
    SELECT user_id, failed, SUM(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS island FROM tx_order
  ) r GROUP BY user_id, island
) i GROUP BY user_id"""

PIECES["tx_retry"] = """
SELECT user_id, MAX(n) AS ta_max_retries FROM (
  SELECT user_id, round_even(amount_in_usd * 100, 0) / 100 AS amt, COUNT(*) AS n
  FROM fx_transactions WHERE amount_in_usd IS NOT NULL GROUP BY 1, 2
) r GROUP BY user_id"""


def _mode(column: str, out: str) -> str:
    return f"""
SELECT user_id, {column} AS {out} FROM (
  SELECT user_id, {column}, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, {column}) AS r
  FROM fx_transactions WHERE {column} IS NOT NULL GROUP BY user_id, {column}
) m WHERE r = 1"""


MODES = {
    "ta_card_funding": "card_funding",
    "ta_card_brand": "card_brand",
    "ta_payment_method": "payment_method_type",
    "ta_bank_country": "bank_country",
    "ta_card_country": "card_country",
}
for _out, _column in MODES.items():
    PIECES[f"mode_{_column}"] = _mode(_column, _out)

PIECES["tx_modal"] = (
    "\nSELECT u.user_id, "
    + ", ".join(f"COALESCE({out}, 'unknown') AS {out}" for out in MODES)
    + " FROM (SELECT DISTINCT user_id FROM fx_transactions) u "
    + " ".join(f"LEFT JOIN mode_{c} USING (user_id)" for c in MODES.values())
)

PIECES["tx_user"] = """
SELECT user_id, COUNT(*) AS ta_total,
  COUNT(failure_code) AS ta_failed_count, COUNT(*) - COUNT(failure_code) AS ta_success_count,
  COUNT(failure_code) / COUNT(*) AS ta_fail_rate,
  COUNT(*) FILTER (WHERE failure_code = 'card_declined') AS ta_card_declined,
  COUNT(*) FILTER (WHERE failure_code IN ('incorrect_cvc', 'invalid_cvc')) AS ta_cvc_fail,
  COUNT(*) FILTER (WHERE failure_code = 'expired_card') AS ta_expired,
  COUNT(*) FILTER (WHERE failure_code = 'authentication_required') AS ta_auth_req,
  MAX(CAST(COALESCE(is_prepaid, FALSE) AS INT)) AS ta_is_prepaid,
  MAX(CAST(COALESCE(is_virtual, FALSE) AS INT)) AS ta_is_virtual,
  MAX(CAST(COALESCE(is_business, FALSE) AS INT)) AS ta_is_business,
  MAX(CAST(is_3d_secure AS INT)) AS ta_is_3ds, MAX(CAST(is_3d_secure_authenticated AS INT)) AS ta_3ds_auth,
  COALESCE(SUM(amount_in_usd), 0) AS ta_amount_total, AVG(amount_in_usd) AS ta_amount_mean, MAX(amount_in_usd) AS ta_amount_max,
  MAX(CASE WHEN COALESCE(card_country, '') <> COALESCE(billing_address_country, '') THEN 1 ELSE 0 END) AS ta_ctry_mismatch,
  MAX(CASE WHEN cvc_check = 'pass' THEN 1 ELSE 0 END) AS ta_cvc_pass
FROM fx_transactions GROUP BY user_id"""

PIECES["tx_features"] = """
SELECT * FROM tx_user LEFT JOIN tx_last USING (user_id) LEFT JOIN tx_run USING (user_id)
  LEFT JOIN tx_retry USING (user_id) LEFT JOIN tx_modal USING (user_id)"""

PIECES["purchase_user"] = """
SELECT user_id, COUNT(*) AS purch_count, COALESCE(SUM(purchase_amount_dollars), 0) AS purch_total,
  AVG(purchase_amount_dollars) AS purch_mean, COUNT(DISTINCT purchase_type) AS purch_types,
  COUNT(*) FILTER (WHERE purchase_type ILIKE '%credit%') AS purch_credit_packs
FROM fx_purchases GROUP BY user_id"""

PIECES["quiz_user"] = """
SELECT user_id, source AS q_source, flow_type AS q_flow_type, team_size AS q_team_size,
  experience AS q_experience, usage_plan AS q_usage_plan, frustration AS q_frustration,
  first_feature AS q_first_feature, role AS q_role,
  CASE WHEN frustration IN ('High cost of top models', 'high-cost') THEN 1 ELSE 0 END AS qf_cost,
  CASE WHEN frustration IN ('inconsistent', 'Inconsistent results') THEN 1 ELSE 0 END AS qf_incon,
  CASE WHEN frustration IN ('limited', 'Limited generations') THEN 1 ELSE 0 END AS qf_limited,
  CASE WHEN frustration IN ('hard-prompt', 'Hard to prompt') THEN 1 ELSE 0 END AS qf_prompt,
  CASE WHEN frustration IN ('other', 'Other') THEN 1 ELSE 0 END AS qf_other
FROM fx_quizzes QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seq) = 1"""

PIECES["property_user"] = """
SELECT user_id, subscription_plan AS prop_plan, country_code AS prop_country,
  CASE subscription_plan WHEN 'Basic' THEN 1 WHEN 'Creator' THEN 2 WHEN 'Pro' THEN 3 WHEN 'Ultimate' THEN 4 ELSE 0 END AS prop_tier,
  isodow(subscription_start_date) - 1 AS prop_dow, month(subscription_start_date) AS prop_month, day(subscription_start_date) AS prop_day
FROM fx_properties"""

PIECES["joined"] = """
SELECT u.user_id, u.churn_status, u.split, p.* EXCLUDE (user_id), g.* EXCLUDE (user_id), b.* EXCLUDE (user_id),
  q.* EXCLUDE (user_id), t.* EXCLUDE (user_id),
  CASE WHEN g.user_id IS NULL THEN 0 ELSE 1 END AS has_gen,
  CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS has_tx,
  CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS has_purch
FROM fx_users u LEFT JOIN property_user p ON u.user_id = p.user_id
  LEFT JOIN gen_features g ON u.user_id = g.user_id LEFT JOIN purchase_user b ON u.user_id = b.user_id
  LEFT JOIN quiz_user q ON u.user_id = q.user_id LEFT JOIN tx_features t ON u.user_id = t.user_id"""

PIECES["filled"] = (
    "\nSELECT * REPLACE ("
    + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in _ZERO_FILLED)
    + ") FROM joined"
)

PIECES["features"] = """
SELECT *,
  ta_is_prepaid * 3 + ta_fail_rate * 4 + ta_card_declined * 1.5
    + CASE WHEN ta_card_funding = 'prepaid' THEN 3 ELSE 0 END + COALESCE(ta_last_failed, 0) * 2
    + ta_max_consec_fail + ta_ctry_mismatch * 1.5 AS invol_risk,
  1 - gen_completion_rate + CASE WHEN gen_total < 3 THEN 3 ELSE 0 END + qf_cost * 2 + qf_incon * 2 + qf_limited * 1.5
    + CASE WHEN gen_activity_slope < -1 THEN 2 ELSE 0 END + CASE WHEN gen_peak_day < 3 THEN 1.5 ELSE 0 END AS vol_risk,
  ln(1 + gen_total) * 2 + gen_days_active + ln(1 + gen_credit_total) + purch_count * 0.5 AS engagement,
  prop_tier * engagement AS plan_x_engagement,
  (gen_q1_count + gen_q2_count) / GREATEST(gen_total, 1) AS gen_front_ratio,
  (gen_q3_count + gen_q4_count) / GREATEST(gen_total, 1) AS gen_back_ratio
FROM filled"""

PIECES["labelled"] = """
SELECT user_id, churn_status, split,
  CASE churn_status WHEN 'not_churned' THEN 0 WHEN 'vol_churn' THEN 1 WHEN 'invol_churn' THEN 2 END AS y,
  CASE WHEN churn_status <> 'not_churned' THEN 1 ELSE 0 END AS is_churned,
  CASE WHEN churn_status = 'vol_churn' THEN 1 ELSE 0 END AS is_vol,
  CASE WHEN churn_status = 'invol_churn' THEN 1 ELSE 0 END AS is_invol
FROM fx_users"""


def _fold(label: str, seed: int, out: str) -> str:
    key = f"md5(concat('{seed}:', CAST(user_id AS VARCHAR))), user_id"
    return f"(ROW_NUMBER() OVER (PARTITION BY split, {label} ORDER BY {key}) - 1) % 5 AS {out}"


PIECES["folds"] = f"""
SELECT *, {_fold("y", 0, "fold_te")}, {_fold("is_churned", 42, "fold_s1")}, {_fold("y", 42, "fold_mc")}
FROM labelled"""

PIECES["train_rows"] = "\nSELECT l.*, " + ", ".join(_TARGET_ENCODED) + """
FROM folds l LEFT JOIN property_user p ON l.user_id = p.user_id LEFT JOIN quiz_user q ON l.user_id = q.user_id
WHERE split = 'train'"""
PIECES["test_rows"] = "\nSELECT l.user_id, " + ", ".join(_TARGET_ENCODED) + """
FROM folds l LEFT JOIN property_user p ON l.user_id = p.user_id LEFT JOIN quiz_user q ON l.user_id = q.user_id
WHERE split = 'test'"""
PIECES["overall"] = (
    "\nSELECT " + ", ".join(f"AVG({t}) AS all_{t}" for t in _TARGETS) + " FROM train_rows"
)
for _c in _TARGET_ENCODED:
    _avg = ", ".join(f"AVG(t.{t}) AS te_{_c}_{t}" for t in _TARGETS)
    PIECES[f"oof_{_c}"] = f"""
SELECT r.user_id, {_avg} FROM train_rows r LEFT JOIN train_rows t ON t.{_c} = r.{_c} AND t.fold_te <> r.fold_te GROUP BY r.user_id"""
    PIECES[f"full_{_c}"] = f"""
SELECT r.user_id, {_avg} FROM test_rows r LEFT JOIN train_rows t ON t.{_c} = r.{_c} GROUP BY r.user_id"""

_TE = [(f"te_{c}_{t}", t) for c in _TARGET_ENCODED for t in _TARGETS]
_TE_FILLED = ", ".join(f"COALESCE({name}, all_{t}) AS {name}" for name, t in _TE)
PIECES["te_train"] = f"""
SELECT r.user_id, r.fold_te AS fold, {_TE_FILLED} FROM train_rows r {" ".join(f"JOIN oof_{c} USING (user_id)" for c in _TARGET_ENCODED)}, overall"""
PIECES["te_test"] = f"""
SELECT r.user_id, {_TE_FILLED} FROM test_rows r {" ".join(f"JOIN full_{c} USING (user_id)" for c in _TARGET_ENCODED)}, overall"""

for _c in _CATEGORICAL:
    PIECES[f"code_{_c}"] = f"""
SELECT user_id, DENSE_RANK() OVER (ORDER BY COALESCE({_c}, 'unknown')) - 1 AS {_c} FROM joined"""
PIECES["codes"] = (
    "\nSELECT * FROM (SELECT user_id FROM fx_users) u "
    + " ".join(f"JOIN code_{c} USING (user_id)" for c in _CATEGORICAL)
)

# Scores derived from the user key, in place of model output.
PIECES["hashed"] = """
SELECT f.user_id, f.split, f.y, f.is_churned, f.fold_mc AS fold,
  CAST((user_id * 7919 + 104729) % 1000 AS DOUBLE) / 1000 AS s1,
  CAST((user_id * 6007 + 15485) % 1000 AS DOUBLE) / 1000 AS s2_raw,
  CAST((user_id * 4801 + 17) % 1000 + 1 AS DOUBLE) AS a,
  CAST((user_id * 3571 + 331) % 1000 + 1 AS DOUBLE) AS b,
  CAST((user_id * 2909 + 727) % 1000 + 1 AS DOUBLE) AS c
FROM folds f"""
PIECES["scores"] = """
SELECT user_id, split, y, is_churned, fold, s1,
  CASE WHEN split = 'train' AND is_churned = 0 THEN 0.5::DOUBLE ELSE s2_raw END AS s2,
  a / (a + b + c) AS m0, b / (a + b + c) AS m1, c / (a + b + c) AS m2
FROM hashed"""

_ONE = "1.0::DOUBLE"


def _mixed(rows: str, columns: str, threshold: str, alpha: str, scale: str | None = None) -> str:
    """SELECT with the blended probabilities b0 b1 b2 of the given rows, scaled where asked."""
    pc = f"LEAST(GREATEST(s1 / ({threshold} * 2.0::DOUBLE), 0.0::DOUBLE), {_ONE})"
    blended = f"""
SELECT {columns}, {alpha} * ({_ONE} - pc) + ({_ONE} - {alpha}) * m0 AS b0,
  {alpha} * (pc * ({_ONE} - s2)) + ({_ONE} - {alpha}) * m1 AS b1,
  {alpha} * (pc * s2) + ({_ONE} - {alpha}) * m2 AS b2
FROM (SELECT *, {pc} AS pc FROM {rows}) z"""
    if scale is None:
        return blended
    weighed = f"SELECT * REPLACE (b1 * {scale} AS b1) FROM ({blended}) w"
    whole = "(b0 + b1 + b2)"
    return f"""
SELECT * REPLACE (b0 / {whole} AS b0, b1 / {whole} AS b1, b2 / {whole} AS b2) FROM ({weighed}) v"""


_PRED = "CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END AS pred"


def _f1(called: str, by: str = "") -> str:
    """Weighted F1 of (y, pred) rows, per ``by`` columns, from the textbook definition."""
    group = f"{by}, " if by else ""
    on = f"USING ({by}, k)" if by else "USING (k)"
    return f"""
SELECT {group}SUM(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ns) / (tp / np + tp / ns) END * ns) / SUM(ns) AS f1 FROM (
  SELECT {group}k, COALESCE(ns, 0) AS ns, COALESCE(np, 0) AS np, COALESCE(tp, 0) AS tp FROM
    (SELECT {group}y AS k, COUNT(*) AS ns, COUNT(*) FILTER (WHERE y = pred) AS tp FROM ({called}) c1 GROUP BY ALL) s
    FULL JOIN (SELECT {group}pred AS k, COUNT(*) AS np FROM ({called}) c2 GROUP BY ALL) p {on}
) f {f"GROUP BY {by}" if by else ""}"""


def _sweep(rows: str, grid: str, threshold: str, alpha: str, scale: str | None = None) -> str:
    """step, value, f1 over a grid relation with those two columns."""
    wide = f"(SELECT * FROM {rows}, {grid})"
    mixed = _mixed(wide, "step, value, y", threshold, alpha, scale)
    called = f"SELECT step, value, y, {_PRED} FROM ({mixed}) x"
    return f"SELECT step, value, f1 FROM ({_f1(called, 'step')}) s JOIN {grid} USING (step)"


_BEST = "WHERE f1 > 0 ORDER BY ROUND(f1, 12) DESC, step LIMIT 1"
PIECES["grid_thr"] = "\nSELECT CAST(i AS INT) AS step, 0.2::DOUBLE + i * 0.02::DOUBLE AS value FROM range(23) r(i)"
PIECES["grid_alpha"] = "\nSELECT CAST(i AS INT) AS step, i * 0.05::DOUBLE AS value FROM range(21) r(i)"
PIECES["grid_scale"] = """
SELECT CAST(i AS INT) AS step, CAST([1.0, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5][i + 1] AS DOUBLE) AS value FROM range(10) r(i)"""
PIECES["oof"] = "\nSELECT * FROM scores WHERE split = 'train'"
PIECES["unseen"] = "\nSELECT * FROM scores WHERE split = 'test'"

PIECES["sweep_thr"] = _sweep("oof", "grid_thr", "value", "0.8::DOUBLE")
PIECES["sweep_alpha"] = _sweep("oof", "grid_alpha", "0.44::DOUBLE", "value")


def _scale_sweep(rows: str, threshold: str, alpha: str) -> str:
    plain = "(SELECT * FROM grid_scale WHERE step = 0)"
    rest = "(SELECT * FROM grid_scale WHERE step > 0)"
    return (
        _sweep(rows, plain, threshold, alpha)
        + " UNION ALL "
        + _sweep(rows, rest, threshold, alpha, "value")
    )


PIECES["sweep_scale"] = _scale_sweep("oof", "0.44::DOUBLE", "0.6::DOUBLE")
PIECES["called"] = (
    f"\nSELECT user_id, y, {_PRED} FROM ("
    + _mixed("oof", "user_id, y", "0.44::DOUBLE", "0.6::DOUBLE", "1.1::DOUBLE")
    + ") f"
)

# The three sweeps in turn on all training scores, then the test scores under the winners.
PIECES["best_thr"] = f"\nSELECT value AS thr FROM sweep_thr {_BEST}"
PIECES["oof_thr"] = "\nSELECT * FROM oof, best_thr"
PIECES["best_alpha"] = (
    f"\nSELECT value AS alpha FROM ({_sweep('oof_thr', 'grid_alpha', 'thr', 'value')}) s {_BEST}"
)
PIECES["oof_alpha"] = "\nSELECT * FROM oof_thr, best_alpha"
PIECES["best_scale"] = (
    f"\nSELECT value AS scale, step AS scale_step FROM ({_scale_sweep('oof_alpha', 'thr', 'alpha')}) s {_BEST}"
)
PIECES["unseen_tuned"] = "\nSELECT * FROM unseen, best_thr, best_alpha, best_scale"
PIECES["final"] = f"""
SELECT user_id, b0, b1, b2, {_PRED} FROM (
  {_mixed("(SELECT * FROM unseen_tuned WHERE scale = 1)", "user_id, scale", "thr", "alpha")}
  UNION ALL
  {_mixed("(SELECT * FROM unseen_tuned WHERE scale <> 1)", "user_id, scale", "thr", "alpha", "scale")}
) t"""

# The same three sweeps without one fold, and that fold called under their winners.
for _k in range(5):
    PIECES[f"rest_{_k}"] = f"\nSELECT * FROM oof WHERE fold <> {_k}"
    PIECES[f"thr_{_k}"] = (
        f"\nSELECT value AS thr FROM ({_sweep(f'rest_{_k}', 'grid_thr', 'value', '0.8::DOUBLE')}) s {_BEST}"
    )
    PIECES[f"rest_thr_{_k}"] = f"\nSELECT * FROM rest_{_k}, thr_{_k}"
    PIECES[f"alpha_{_k}"] = (
        f"\nSELECT value AS alpha FROM ({_sweep(f'rest_thr_{_k}', 'grid_alpha', 'thr', 'value')}) s {_BEST}"
    )
    PIECES[f"rest_alpha_{_k}"] = f"\nSELECT * FROM rest_thr_{_k}, alpha_{_k}"
    PIECES[f"scale_{_k}"] = (
        f"\nSELECT value AS scale FROM ({_scale_sweep(f'rest_alpha_{_k}', 'thr', 'alpha')}) s {_BEST}"
    )
    PIECES[f"held_{_k}"] = f"\nSELECT * FROM (SELECT * FROM oof WHERE fold = {_k}) h, thr_{_k}, alpha_{_k}, scale_{_k}"
PIECES["held_called"] = " UNION ALL ".join(
    f"SELECT y, {_PRED} FROM ({_mixed(f'(SELECT * FROM held_{k} WHERE scale = 1)', 'y, scale', 'thr', 'alpha')}) p{k}"
    f" UNION ALL SELECT y, {_PRED} FROM ({_mixed(f'(SELECT * FROM held_{k} WHERE scale <> 1)', 'y, scale', 'thr', 'alpha', 'scale')}) q{k}"
    for k in range(5)
)

# --- final SELECTs -------------------------------------------------------------------------------

# Result columns by type; everything else is text.
_INTEGER = set(
    """
    user_id gen_total gen_completed gen_failed gen_nsfw gen_canceled gen_days_active gen_types_unique
    gen_max_in_day gen_video_count gen_image_count gen_q1_count gen_q2_count gen_q3_count gen_q4_count
    gen_early_count gen_late_count gen_peak_day gen_last3_count purch_count purch_types purch_credit_packs
    qf_cost qf_incon qf_limited qf_prompt qf_other ta_total ta_failed_count ta_success_count
    ta_card_declined ta_cvc_fail ta_expired ta_auth_req ta_is_prepaid ta_is_virtual ta_is_business ta_is_3ds
    ta_3ds_auth ta_ctry_mismatch ta_max_consec_fail ta_max_retries ta_cvc_pass prop_tier prop_dow prop_month
    prop_day has_gen has_tx has_purch fold fold_te fold_s1 fold_mc fold_s2 y pred step n support users events day
    n_rows key_sum text_count class_id n_reasons renewal_warning day7_intervention quick_start
    pred_not pred_vol pred_invol
    """.split()
)
_TEXT = set(_CATEGORICAL) | set(
    "churn_status split label name actual scheme prop_country reasons action predicted table_name feature".split()
)


def _real(expression: str) -> str:
    """Round to seven places, without negative zero."""
    rounded = f"ROUND(CAST({expression} AS DOUBLE) * 1e7 + 0.01) / 1e7"
    return f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END"


def _shape(column: str, integer: bool | None = None) -> str:
    if column in _TEXT and not integer:
        return column
    if integer or column in _INTEGER:
        return f"CAST({column} AS BIGINT) AS {column}"
    return f"{_real(column)} AS {column}"


def _shaped(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(_shape(c) for c in columns)} FROM {source}"


def _with(sql: str) -> str:
    """Put the pieces a query mentions, and those they mention, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in PIECES and word not in needed and word not in active:
                active.append(word)
                visit(PIECES[word])
                active.remove(word)
                needed.append(word)

    active: list[str] = []
    visit(sql)
    ctes = ",\n".join(f"{name} AS ({PIECES[name]})" for name in needed)
    return f"WITH {ctes}\n{sql}" if needed else sql  # an sql that begins with a comma adds pieces of its own


ORACLES: dict[str, str] = {}


def _oracle(name: str, sql: str) -> None:
    ORACLES[name] = _with(sql)


def _slice(name: str, source: str, columns: str | list[str]) -> None:
    columns = columns.split() if isinstance(columns, str) else columns
    _oracle(name, _shaped(["user_id", *columns], source))


def _probe(split: str, table: str, measure: str, text: str) -> str:
    return f"""
SELECT '{split}' AS split, '{table}' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(user_id) AS BIGINT) AS key_sum,
  CAST(SUM(CAST(ROUND(CAST({measure} AS DOUBLE) * 1000) AS BIGINT)) AS BIGINT) AS measure_sum, CAST(COUNT({text}) AS BIGINT) AS text_count
FROM fx_{table} WHERE user_id IN (SELECT user_id FROM fx_users WHERE split = '{split}')"""


_PROBES = [
    ("users", "0.0", "user_id"),
    ("generations", "credit_cost", "status"),
    ("properties", "day(subscription_start_date)", "country_code"),
    ("purchases", "purchase_amount_dollars", "purchase_type"),
    ("quizzes", "seq", "frustration"),
    ("transactions", "amount_in_usd", "failure_code"),
]
_oracle(
    "src_csv_roundtrip",
    " UNION ALL ".join(_probe(s, t, m, x) for s in ("train", "test") for t, m, x in _PROBES),
)
_slice("feature_cache_roundtrip", "features", ["churn_status", *_FEATURES])
_slice("prop_features", "property_user", "prop_plan prop_country prop_tier prop_dow prop_month prop_day")
_slice(
    "gen_core",
    "gen_features",
    "gen_total gen_completed gen_failed gen_nsfw gen_canceled gen_credit_total gen_credit_mean gen_credit_max "
    "gen_credit_std gen_days_active gen_types_unique gen_max_in_day gen_span_hours gen_per_active_day",
)
_slice("gen_ratios", "gen_features", "gen_completion_rate gen_fail_rate gen_nsfw_rate gen_cancel_rate")
_slice("gen_media_mix", "gen_features", "gen_video_count gen_image_count gen_video_ratio")
_slice("gen_duration", "gen_features", "gen_duration_mean gen_duration_max gen_duration_sum gen_duration_std")
_slice(
    "gen_arc_buckets",
    "gen_features",
    [f"gen_q{i}_{m}" for i in (1, 2, 3, 4) for m in ("count", "credits", "compl")],
)
_slice(
    "gen_credit_velocity",
    "gen_features",
    "gen_credit_early gen_credit_late gen_credit_vel_ratio gen_early_count gen_late_count",
)
_slice("gen_last3", "gen_features", "gen_last3_count gen_last3_frac")
_slice("gen_daily_slope", "gen_features", "gen_activity_slope")
_slice("gen_peak_day", "gen_features", "gen_peak_day")
_slice("gen_cliff", "gen_features", "gen_activity_cliff")
_slice("gen_first_latency", "gen_features", "gen_first_latency_h")
_slice("gen_completion_trend", "gen_features", "gen_compl_trend")
_slice("gen_video_credit_ratio", "gen_features", "gen_video_credit_ratio")
_oracle(
    "gen_window_filter",
    """
SELECT user_id, CAST(SUM(cnt) AS BIGINT) AS gen_total,
  CAST((SELECT COUNT(DISTINCT gen_date) FROM gen g WHERE g.user_id = d.user_id AND raw_day BETWEEN 0 AND 13) AS BIGINT) AS gen_days_active,
  CAST(SUM(cnt) FILTER (WHERE raw_day <= 3) AS BIGINT) AS gen_q1_count,
  CAST(SUM(cnt) FILTER (WHERE raw_day >= 11) AS BIGINT) AS gen_q4_count,
  CAST(arg_min(raw_day, -cnt * 100 + raw_day) AS BIGINT) AS gen_peak_day
FROM (SELECT user_id, raw_day, COUNT(*) AS cnt FROM gen WHERE raw_day BETWEEN 0 AND 13 GROUP BY ALL) d GROUP BY user_id""",
)
_slice(
    "tx_core",
    "tx_user",
    "ta_total ta_failed_count ta_success_count ta_fail_rate ta_amount_total ta_amount_mean ta_amount_max",
)
_slice("tx_failure_codes", "tx_user", "ta_card_declined ta_cvc_fail ta_expired ta_auth_req")
_slice("tx_flags", "tx_user", "ta_is_prepaid ta_is_virtual ta_is_business ta_is_3ds ta_3ds_auth ta_cvc_pass")
_slice("tx_country_mismatch", "tx_user", "ta_ctry_mismatch")
_slice("tx_last_failed", "tx_last", "ta_last_failed")
_slice("tx_longest_fail_run", "tx_run", "ta_max_consec_fail")
_slice("tx_max_retries", "tx_retry", "ta_max_retries")
_slice("tx_modes", "tx_modal", list(MODES))
_slice("purch_features", "purchase_user", "purch_count purch_total purch_mean purch_types purch_credit_packs")
_slice(
    "quiz_features",
    "quiz_user",
    "q_source q_flow_type q_team_size q_experience q_usage_plan q_frustration q_first_feature q_role "
    "qf_cost qf_incon qf_limited qf_prompt qf_other",
)
_COMPOSITE = "invol_risk vol_risk engagement plan_x_engagement gen_front_ratio gen_back_ratio".split()
_slice(
    "assemble_features",
    "joined",
    ["churn_status", *[f for f in _FEATURES if f not in _COMPOSITE]],
)
_slice("zero_fill", "filled", _ZERO_FILLED)
_slice("risk_composites", "features", ["has_gen", "has_tx", "has_purch", *_COMPOSITE])
PIECES["folds_s2"] = f"""
SELECT user_id, {_fold("is_invol", 42, "fold_s2")} FROM labelled WHERE is_churned = 1"""
_oracle(
    "stratified_folds",
    _shaped(
        "user_id fold_te fold_s1 fold_mc fold_s2".split(),
        "folds LEFT JOIN folds_s2 USING (user_id) WHERE split = 'train'",
    ),
)
_slice("target_encode_oof", "te_train", ["fold", *[n for n, _ in _TE]])
_slice("target_encode_test", "te_test", [n for n, _ in _TE])
_oracle(
    "ordinal_encode",
    "SELECT CAST(user_id AS BIGINT) AS user_id, "
    + ", ".join(_shape(c, integer=True) for c in _CATEGORICAL)
    + " FROM codes",
)


def _cell(column: str) -> str:
    """A matrix entry: seven places, then single precision, missing as -1."""
    single = f"COALESCE(CAST({_real(column)} AS FLOAT), -1)"
    return f"ROUND(CAST({single} AS DOUBLE) * 1e7 + 0.01) / 1e7 AS {column}"


_MATRIX = [*_FEATURES] + [n for n, _ in _TE]
PIECES["te_all"] = "\nSELECT * EXCLUDE (fold) FROM te_train UNION ALL BY NAME SELECT * FROM te_test"
PIECES["matrix"] = f"""
SELECT f.* EXCLUDE ({", ".join(_CATEGORICAL)}), c.* EXCLUDE (user_id), t.* EXCLUDE (user_id)
FROM features f JOIN codes c ON f.user_id = c.user_id JOIN te_all t ON f.user_id = t.user_id"""
_oracle(
    "feature_matrix",
    f"SELECT CAST(user_id AS BIGINT) AS user_id, {', '.join(_cell(c) for c in _MATRIX)} FROM matrix",
)
_oracle(
    "class_weights",
    f"""
SELECT 'unbalanced' AS scheme, CAST(is_churned AS BIGINT) AS class_id, CAST(COUNT(*) AS BIGINT) AS n,
  {_real("CASE WHEN COUNT(*) < (SELECT COUNT(*) FROM labelled l WHERE split = 'train' AND l.is_churned <> o.is_churned) "
         "THEN (SELECT COUNT(*) FROM labelled l WHERE split = 'train' AND l.is_churned <> o.is_churned) / COUNT(*) ELSE 1 END")} AS weight
FROM labelled o WHERE split = 'train' GROUP BY is_churned
UNION ALL
SELECT 'balanced', CAST(y AS BIGINT), CAST(COUNT(*) AS BIGINT),
  {_real("(SELECT COUNT(*) FROM labelled WHERE split = 'train') / (3.0 * COUNT(*))")}
FROM labelled WHERE split = 'train' GROUP BY y""",
)
_oracle(
    "label_distribution",
    """
SELECT churn_status AS label, CAST(y AS BIGINT) AS y, CAST(COUNT(*) AS BIGINT) AS n
FROM labelled WHERE split = 'train' GROUP BY ALL""",
)
_oracle("weighted_f1", f"SELECT {_real('f1')} AS f1 FROM ({_f1('SELECT y, pred FROM called')}) r")
_oracle(
    "fold_f1",
    f"""
SELECT CAST(fold AS BIGINT) AS fold, {_real("CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ns) / (tp / np + tp / ns) END")} AS f1 FROM (
  SELECT fold, COUNT(*) FILTER (WHERE s1 > 0.5) AS np, SUM(is_churned) AS ns,
    COUNT(*) FILTER (WHERE s1 > 0.5 AND is_churned = 1) AS tp FROM oof GROUP BY fold
) c""",
)
PIECES["per_class"] = """
SELECT k, CASE k WHEN 0 THEN 'not_churned' WHEN 1 THEN 'vol_churn' ELSE 'invol_churn' END AS name,
  COALESCE(tp / NULLIF(np, 0), 0) AS precision, COALESCE(tp / NULLIF(ns, 0), 0) AS recall,
  COALESCE(2 * tp / NULLIF(np + ns, 0), 0) AS f1, ns AS support
FROM (
  SELECT k, COUNT(*) FILTER (WHERE y = k) AS ns, COUNT(*) FILTER (WHERE pred = k) AS np,
    COUNT(*) FILTER (WHERE y = k AND pred = k) AS tp
  FROM called, (SELECT UNNEST([0, 1, 2]) AS k) ks GROUP BY k
) c"""
_oracle(
    "classification_report",
    _shaped(
        "name precision recall f1 support".split(),
        """(
  SELECT name, precision, recall, f1, support FROM per_class
  UNION ALL SELECT 'accuracy', NULL, NULL, AVG(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), COUNT(*) FROM called
  UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM per_class
  UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
    SUM(f1 * support) / SUM(support), SUM(support) FROM per_class
) r""",
    ),
)
_oracle(
    "confusion_matrix",
    """
SELECT CASE y WHEN 0 THEN 'not_churned' WHEN 1 THEN 'vol_churn' ELSE 'invol_churn' END AS actual,
  CAST(COUNT(*) FILTER (WHERE pred = 0) AS BIGINT) AS pred_not, CAST(COUNT(*) FILTER (WHERE pred = 1) AS BIGINT) AS pred_vol,
  CAST(COUNT(*) FILTER (WHERE pred = 2) AS BIGINT) AS pred_invol
FROM called GROUP BY y""",
)
_oracle(
    "cascade_proba",
    f"""
SELECT CAST(user_id AS BIGINT) AS user_id, {_real("b0")} AS p0, {_real("b1")} AS p1, {_real("b2")} AS p2, CAST(pred AS BIGINT) AS pred FROM (
  SELECT *, {_PRED} FROM (
    SELECT user_id, 1 - pc AS b0, pc * (1 - s2) AS b1, pc * s2 AS b2
    FROM (SELECT *, LEAST(GREATEST(s1 / (0.44::DOUBLE * 2), 0), 1) AS pc FROM oof) z
  ) x
) w""",
)
_oracle("threshold_sweep", _shaped(["step", "value", "f1"], "sweep_thr"))
_oracle("alpha_sweep", _shaped(["step", "value", "f1"], "sweep_alpha"))
_oracle("vol_scale_sweep", _shaped(["step", "value", "f1"], "sweep_scale"))
_oracle("nested_f1", f"SELECT {_real('f1')} AS f1 FROM ({_f1('SELECT y, pred FROM held_called')}) r")
_CLASS = "CASE pred WHEN 0 THEN 'not_churned' WHEN 1 THEN 'vol_churn' ELSE 'invol_churn' END AS churn_status"
_oracle("submission", f"SELECT CAST(user_id AS BIGINT) AS user_id, {_CLASS} FROM final")
_oracle(
    "predictions_proba",
    f"""
SELECT {_real("b0")} AS prob_not_churned, {_real("b1")} AS prob_vol_churn, {_real("b2")} AS prob_invol_churn,
  CAST(user_id AS BIGINT) AS user_id, {_CLASS} FROM final""",
)
_oracle(
    "class_profile",
    _shaped(
        "churn_status users active_days completion_rate prepaid_share last_failed_share declined_mean".split(),
        """(
  SELECT churn_status, COUNT(*) AS users, AVG(gen_days_active) AS active_days, AVG(gen_completion_rate) AS completion_rate,
    AVG(ta_is_prepaid) AS prepaid_share, AVG(COALESCE(ta_last_failed, 0)) AS last_failed_share, AVG(ta_card_declined) AS declined_mean
  FROM features GROUP BY churn_status
) r""",
    ),
)
_oracle(
    "daily_activity_by_class",
    f"""
SELECT churn_status, CAST(users AS BIGINT) AS users, CAST(day AS BIGINT) AS day, CAST(events AS BIGINT) AS events,
  {_real("events / users")} AS events_per_user
FROM (
  SELECT l.churn_status, COUNT(DISTINCT l.user_id) AS users, k.day,
    COUNT(g.user_id) FILTER (WHERE g.day = k.day) AS events
  FROM fx_users l LEFT JOIN gen g ON l.user_id = g.user_id, (SELECT UNNEST(range(14)) AS day) k
  GROUP BY l.churn_status, k.day
) r""",
)
_oracle(
    "risk_lift",
    f"""
SELECT {_real("si")} AS prepaid_share_invol, {_real("sn")} AS prepaid_share_not, {_real("rp")} AS invol_rate_prepaid,
  {_real("ro")} AS invol_rate_other, {_real("si / sn")} AS share_lift, {_real("rp / ro")} AS rate_lift
FROM (
  SELECT AVG(ta_is_prepaid) FILTER (WHERE churn_status = 'invol_churn') AS si,
    AVG(ta_is_prepaid) FILTER (WHERE churn_status = 'not_churned') AS sn,
    AVG(CAST(churn_status = 'invol_churn' AS INT)) FILTER (WHERE ta_is_prepaid = 1) AS rp,
    AVG(CAST(churn_status = 'invol_churn' AS INT)) FILTER (WHERE ta_is_prepaid = 0) AS ro
  FROM features
) r""",
)
PIECES["risky"] = """
SELECT prop_country, COUNT(*) AS users, AVG(CAST(churn_status = 'invol_churn' AS INT)) AS invol_rate
FROM features WHERE prop_country IS NOT NULL GROUP BY prop_country HAVING COUNT(*) >= 20
ORDER BY invol_rate DESC, prop_country LIMIT 10"""
_oracle("top_risk_countries", _shaped(["prop_country", "users", "invol_rate"], "risky"))
_PAYMENT = {
    "prepaid card": "ta_is_prepaid = 1",
    "last payment failed": "ta_last_failed = 1",
    "high-risk country": "prop_country IN (SELECT prop_country FROM risky)",
    "card and billing country differ": "ta_ctry_mismatch = 1",
}
_BEHAVIOUR = {
    "few active days": "gen_days_active <= 2",
    "falling activity": "gen_activity_slope < -1",
    "late first generation": "gen_first_latency_h >= 12",
    "frustration: cost": "qf_cost = 1",
    "frustration: inconsistent results": "qf_incon = 1",
    "frustration: limits": "qf_limited = 1",
}


def _listed(rules: dict[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in rules.items()) + ")"


_ANSWERS = {
    "show how to save credits and offer the basic plan": "qf_cost = 1",
    "prompting guide and templates": "qf_incon = 1",
    "show progress and remind of credit packs": "qf_limited = 1",
}
_oracle(
    "churn_reasons",
    f"""
SELECT CAST(user_id AS BIGINT) AS user_id, predicted, {_real("certain")} AS probability,
  CAST(CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, '; ')) END AS BIGINT) AS n_reasons, reasons,
  CASE predicted WHEN 'not_churned' THEN 'none' WHEN 'vol_churn' THEN concat_ws('; ', 'day-7 intervention', NULLIF(answers, ''))
    ELSE 'renewal warning and new payment method' END AS action
FROM (
  SELECT user_id, predicted, certain, {_listed(_ANSWERS)} AS answers,
    CASE predicted WHEN 'invol_churn' THEN {_listed(_PAYMENT)} WHEN 'vol_churn' THEN {_listed(_BEHAVIOUR)} ELSE '' END AS reasons
  FROM (SELECT f.*, GREATEST(b0, b1, b2) AS certain,
    CASE pred WHEN 0 THEN 'not_churned' WHEN 1 THEN 'vol_churn' ELSE 'invol_churn' END AS predicted
    FROM features f JOIN final USING (user_id)) c
) r""",
)
PIECES["week"] = """
SELECT user_id, COUNT(*) AS week_days, CASE WHEN COUNT(*) = 1 THEN 0.0 ELSE regr_slope(cnt, day) END AS week_slope
FROM gen_day WHERE day < 7 GROUP BY user_id"""
_oracle(
    "intervention_triggers",
    """
SELECT CAST(f.user_id AS BIGINT) AS user_id,
  CAST(COALESCE(ta_is_prepaid = 1 AND ta_failed_count > 0, FALSE) AS BIGINT) AS renewal_warning,
  CAST(COALESCE(week_slope < 0 AND week_days <= 3, FALSE) AS BIGINT) AS day7_intervention,
  CAST(COALESCE(gen_first_latency_h <= 0.5, FALSE) AS BIGINT) AS quick_start
FROM features f LEFT JOIN week w ON f.user_id = w.user_id""",
)

# --- rows read back from CSV, and the features built from them
_ROWS = {
    "users": "CAST(f.user_id AS VARCHAR) AS user_id, CASE WHEN u.split = 'train' THEN f.churn_status END AS churn_status",
    "generations": "CAST(f.user_id AS VARCHAR) AS user_id, CAST(created_at AS TIMESTAMP) AS created_at, status, "
    "generation_type, {credit_cost}, {duration}",
    "properties": "CAST(f.user_id AS VARCHAR) AS user_id, CAST(subscription_start_date AS TIMESTAMP) AS "
    "subscription_start_date, subscription_plan, country_code",
    "purchases": "CAST(f.user_id AS VARCHAR) AS user_id, {purchase_amount_dollars}, purchase_type",
    "quizzes": "CAST(f.user_id AS VARCHAR) AS user_id, source, flow_type, team_size, experience, usage_plan, frustration, "
    "first_feature, role, CAST(seq AS BIGINT) AS seq",
    "transactions": "CAST(f.user_id AS VARCHAR) AS user_id, CAST(transaction_time AS TIMESTAMP) AS transaction_time, "
    "failure_code, CAST(is_prepaid AS VARCHAR) AS is_prepaid, CAST(is_virtual AS VARCHAR) AS is_virtual, "
    "CAST(is_business AS VARCHAR) AS is_business, CAST(is_3d_secure AS BIGINT) AS is_3d_secure, "
    "CAST(is_3d_secure_authenticated AS BIGINT) AS is_3d_secure_authenticated, card_country, billing_address_country, "
    "bank_country, {amount_in_usd}, cvc_check, card_funding, card_brand, payment_method_type, "
    "CAST(attempt_id AS BIGINT) AS attempt_id",
}
for _t, _columns in _ROWS.items():
    _doubles = ("credit_cost", "duration", "purchase_amount_dollars", "amount_in_usd")
    _columns = _columns.format(**{c: f"{_real(c)} AS {c}" for c in _doubles})
    _oracle(
        f"src_{_t}",
        f"SELECT {_columns}, u.split AS split FROM fx_{_t} f JOIN fx_users u ON f.user_id = u.user_id",
    )
_slice("csv_features", "features", _FEATURES)

# --- models of one split
PIECES["fold_ids"] = "\nSELECT UNNEST(range(5)) AS k"


def _weights(label: str, scheme: str | None) -> str:
    """Weight of each class in the rows outside fold k, from ``seen`` (k, label, ...)."""
    value = {
        "unbalanced": "MAX(n) OVER (PARTITION BY k) / n",
        "balanced": "SUM(n) OVER (PARTITION BY k) / (COUNT(*) OVER (PARTITION BY k) * n)",
        None: "1.0",
    }[scheme]
    return f"SELECT k, {label}, n, {value} AS w FROM (SELECT k, {label}, COUNT(*) AS n FROM seen GROUP BY ALL) c"


def _split_model(name: str, feature: str, label: str, fold: str, scheme: str | None, rows: str, leaf: str, outputs: dict) -> None:
    """Scores of a single split on ``feature``: ``leaf`` gives the sums per side, ``outputs`` the scores.

    A side with fewer than 15 rows is no split, and then both sides have the sums of all rows.
    """
    sums = [part.split(" AS ")[1] for part in leaf.split(", ")]
    pooled = ", ".join(f"CASE WHEN apart THEN {s} ELSE SUM({s}) OVER (PARTITION BY k) END AS {s}" for s in sums)
    means = ", ".join(f"{_real(f'AVG({c})')} AS {c}" for c in outputs)
    own = ", ".join(f"{_real(c)} AS {c}" for c in outputs)
    scores = ", ".join(f"{e} AS {c}" for c, e in outputs.items())
    _oracle(
        name,
        f"""
, t AS (SELECT l.user_id, l.{label}, l.{fold} AS fold, f.{feature} AS x FROM {rows} l JOIN features f ON l.user_id = f.user_id),
seen AS (SELECT * FROM t, fold_ids WHERE fold <> k),
weights AS ({_weights(label, scheme)}),
sides AS (SELECT k, x, COUNT(*) AS n, {leaf} FROM seen JOIN weights USING (k, {label}) GROUP BY k, x),
leaves AS (SELECT k, x, {pooled} FROM (SELECT *, MIN(n) OVER (PARTITION BY k) >= 15 AS apart FROM sides) a),
merged AS (SELECT * FROM leaves),
scored AS (SELECT k, x, {scores} FROM merged)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(fold AS BIGINT) AS fold, {own}, 'oof' AS part
FROM t JOIN scored s ON t.fold = s.k AND t.x = s.x
UNION ALL
SELECT CAST(u.user_id AS BIGINT), NULL, {means}, 'test'
FROM features u JOIN scored s ON u.{feature} = s.x WHERE u.split = 'test' GROUP BY u.user_id""".lstrip(),
    )


def _margin(a: str, b: str) -> str:
    """Probability after one boosting round: the leaf's weighted mean of labels -1 and 1."""
    return f"1 / (1 + exp(-2 * {a} / {b}))"


PIECES["train_folds"] = "\nSELECT * FROM folds LEFT JOIN folds_s2 USING (user_id) WHERE split = 'train'"
PIECES["churned_folds"] = "\nSELECT * FROM train_folds WHERE is_churned = 1"
_split_model(
    "stage1_model", "qf_cost", "is_churned", "fold_s1", "unbalanced", "train_folds",
    "SUM(w * (2 * is_churned - 1)) AS a, SUM(w) AS b", {"s1": _margin("a", "b")},
)
_split_model(
    "stage2_model", "has_purch", "is_invol", "fold_s2", None, "churned_folds",
    "SUM(w * (2 * is_invol - 1)) AS a, SUM(w) AS b", {"s2": _margin("a", "b")},
)
_RESTS = [_margin(f"a{c}", "b") for c in range(3)]
_split_model(
    "multiclass_model", "qf_cost", "y", "fold_mc", "balanced", "train_folds",
    ", ".join(f"SUM(CASE WHEN y = {c} THEN w ELSE -w END) AS a{c}" for c in range(3)) + ", SUM(w) AS b",
    {f"m{c}": f"({_RESTS[c]}) / ({' + '.join(f'({r})' for r in _RESTS)})" for c in range(3)},
)
_split_model(
    "multiclass_forest_model", "has_purch", "y", "fold_mc", "balanced", "train_folds",
    ", ".join(f"SUM(CASE WHEN y = {c} THEN w ELSE 0 END) AS a{c}" for c in range(3)) + ", SUM(w) AS b",
    {f"m{c}": f"a{c} / b" for c in range(3)},
)
# A forest makes one leaf of two sides with the same majority class.
_MAJOR = "CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END"
_ONE_LEAF = ", ".join(
    f"CASE WHEN MIN({_MAJOR}) OVER (PARTITION BY k) = MAX({_MAJOR}) OVER (PARTITION BY k) "
    f"THEN SUM({c}) OVER (PARTITION BY k) ELSE {c} END AS {c}"
    for c in ("a0", "a1", "a2", "b")
)
ORACLES["multiclass_forest_model"] = ORACLES["multiclass_forest_model"].replace(
    "merged AS (SELECT * FROM leaves)", f"merged AS (SELECT k, x, {_ONE_LEAF} FROM leaves)"
)


def _structure(name: str, fold: str, rows: str) -> None:
    counted = "CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) AS BIGINT) AS users, 1::BIGINT AS in_range, 1::BIGINT AS sums_to_one"
    _oracle(
        name,
        f"""
SELECT 'oof' AS part, CAST({fold} AS BIGINT) AS fold, {counted} FROM {rows} GROUP BY {fold}
UNION ALL SELECT 'test', NULL, {counted} FROM fx_users WHERE split = 'test'""",
    )


_structure("stage1_structure", "fold_s1", "train_folds")
_structure("stage2_structure", "fold_s2", "churned_folds")
_structure("multiclass_structure", "fold_mc", "train_folds")
_NAMED = ", ".join(f"('{c}')" for c in _MATRIX)
_oracle(
    "feature_importance",
    f"SELECT feature, 1::BIGINT AS not_negative, 1::BIGINT AS sums_to_one FROM (VALUES {_NAMED}) v(feature)",
)
_shares = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, AVG(CASE WHEN {c} <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS importance FROM features"
    for c in _ZERO_FILLED
)
_oracle(
    "top_importances",
    f"SELECT feature, {_real('importance')} AS importance FROM ({_shares}) s ORDER BY s.importance DESC, feature LIMIT 20",
)
_FOLD_WEIGHTS = {"unbalanced": ("is_churned", "fold_s1"), "balanced": ("y", "fold_mc")}
_oracle(
    "class_weights_by_fold",
    " UNION ALL ".join(
        f"""
SELECT '{scheme}' AS scheme, CAST(k AS BIGINT) AS fold, CAST({label} AS BIGINT) AS class_id, CAST(n AS BIGINT) AS n, {_real("w")} AS weight
FROM ({_weights(label, scheme).replace("seen", f"(SELECT * FROM train_folds, fold_ids WHERE {fold} <> k) s")}) {scheme}"""
        for scheme, (label, fold) in _FOLD_WEIGHTS.items()
    ),
)


def _binary(label: str, score: str, rows: str) -> str:
    return f"""
SELECT fold, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ns) / (tp / np + tp / ns) END AS f1 FROM (
  SELECT fold, COUNT(*) FILTER (WHERE {score} > 0.5) AS np, SUM({label}) AS ns,
    COUNT(*) FILTER (WHERE {score} > 0.5 AND {label} = 1) AS tp FROM {rows} GROUP BY fold) c"""


_M_CALLED = "SELECT fold, y, CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS pred FROM oof"
_CHURNED_OOF = "(SELECT *, CASE WHEN y = 2 THEN 1 ELSE 0 END AS is_invol FROM oof WHERE is_churned = 1) d"
_oracle(
    "fold_report",
    " UNION ALL ".join(
        f"SELECT '{model}' AS model, CAST(fold AS BIGINT) AS fold, {_real('f1')} AS f1 FROM ({sql}) {model}"
        for model, sql in {
            "stage1": _binary("is_churned", "s1", "oof"),
            "stage2": _binary("is_invol", "s2", _CHURNED_OOF),
            "multiclass": _f1(_M_CALLED, "fold"),
        }.items()
    ),
)
_oracle(
    "predicted_distribution",
    f"SELECT churn_status, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT {_CLASS} FROM final) c GROUP BY churn_status",
)

_slice("assemble_bucketed", "joined", ["churn_status", *[f for f in _FEATURES if f not in _COMPOSITE]])
_slice("gen_incremental", "gen_features", [f for f in _FEATURES if f.startswith("gen_") and f not in _COMPOSITE])

# Means outside both folds of a row, and those of all rows outside both.
_OUTSIDE = "t.fold_te <> r.fold_te AND t.fold_mc <> r.fold_mc"
PIECES["outside"] = (
    "\nSELECT r.fold_te, r.fold_mc, "
    + ", ".join(f"AVG(t.{t}) AS out_{t}" for t in _TARGETS)
    + f" FROM (SELECT DISTINCT fold_te, fold_mc FROM train_rows) r LEFT JOIN train_rows t ON {_OUTSIDE} GROUP BY ALL"
)
for _c in _TARGET_ENCODED:
    _avg = ", ".join(f"AVG(t.{t}) AS te_{_c}_{t}" for t in _TARGETS)
    PIECES[f"nested_{_c}"] = f"""
SELECT r.user_id, {_avg} FROM train_rows r LEFT JOIN train_rows t ON t.{_c} = r.{_c} AND {_OUTSIDE} GROUP BY r.user_id"""
PIECES["te_nested"] = f"""
SELECT r.user_id, r.fold_te, r.fold_mc, {", ".join(f"COALESCE({name}, out_{t}) AS {name}" for name, t in _TE)}
FROM train_rows r {" ".join(f"JOIN nested_{c} USING (user_id)" for c in _TARGET_ENCODED)}
  JOIN outside o ON o.fold_te = r.fold_te AND o.fold_mc = r.fold_mc"""
_slice("target_encode_nested", "te_nested", ["fold_te", "fold_mc", *[n for n, _ in _TE]])

_oracle(
    "importance_splits",
    f"""
, t AS (SELECT l.user_id, l.is_churned, l.fold_s1 AS fold, f.qf_cost AS x FROM train_folds l JOIN features f ON l.user_id = f.user_id),
seen AS (SELECT * FROM t, fold_ids WHERE fold <> k),
weights AS ({_weights("is_churned", "unbalanced")}),
sides AS (SELECT k, x, COUNT(*) AS n, SUM(w * (2 * is_churned - 1)) AS a, SUM(w) AS b FROM seen JOIN weights USING (k, is_churned) GROUP BY k, x),
roots AS (SELECT k, SUM(n) AS n, COUNT(*) = 2 AND MIN(n) >= 15 AS apart, SUM(a * a / b) / SUM(b) - (SUM(a) / SUM(b)) ** 2 AS gain FROM sides GROUP BY k)
SELECT 'qf_cost' AS feature, {_real("COUNT(*) FILTER (WHERE apart) / 5")} AS importance, CAST(COUNT(*) FILTER (WHERE apart) AS BIGINT) AS splits,
  CAST(COALESCE(SUM(n) FILTER (WHERE apart), 0) AS BIGINT) AS rows, {_real("COALESCE(SUM(gain * n) FILTER (WHERE apart), 0)")} AS gain FROM roots""".lstrip(),
)
_oracle(
    "best_rounds",
    """
, c AS (SELECT user_id % 5 AS fold, event_id % 40 + 1 AS round, AVG(credit_cost) AS loss FROM fx_generations GROUP BY ALL),
m AS (SELECT *, MIN(loss) OVER (PARTITION BY fold ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM c),
b AS (SELECT fold, round, MAX(CASE WHEN loss < COALESCE(least, 'infinity'::DOUBLE) THEN round END)
  OVER (PARTITION BY fold ORDER BY round) AS best FROM m),
p AS (SELECT UNNEST([1, 3, 8, 100]) AS patience),
s AS (SELECT fold, patience, MIN(round) FILTER (WHERE round - best >= patience) AS stop, MAX(round) AS last FROM b, p GROUP BY fold, patience)
SELECT CAST(s.fold AS BIGINT) AS fold, 0::BIGINT AS member, CAST(best AS BIGINT) AS rounds, CAST(patience AS BIGINT) AS patience
FROM s JOIN b ON s.fold = b.fold AND b.round = COALESCE(stop, last)""".lstrip(),
)
_REJECTED = {
    "broken line": ("NULL", "event_id % 59 = 11", "COUNT(*)"),
    "no key": ("'user_id'", "event_id % 53 = 7", "0"),
    "not converted": ("'created_at'", "event_id % 37 = 5", "COUNT(*)"),
    "not converted ": ("'credit_cost'", "event_id % 41 = 3", "COUNT(*)"),
}
_oracle(
    "src_rejects",
    "SELECT *, CAST(SUM(n) OVER (PARTITION BY reason) AS BIGINT) AS counted, (SELECT COUNT(*) FROM fx_generations) AS n_rows, "
    "(SELECT COUNT(*) FROM fx_generations WHERE event_id % 53 <> 7) AS n_kept FROM ("
    + " UNION ALL ".join(
        f"SELECT '{reason.strip()}' AS reason, {column} AS column_name, COUNT(*) AS n, "
        f"COUNT(*) FILTER (WHERE event_id % 53 <> 7) AS with_key, {texts} AS with_text FROM fx_generations WHERE {rule} HAVING COUNT(*) > 0"
        for reason, (column, rule, texts) in _REJECTED.items()
    )
    + ") r",
)
