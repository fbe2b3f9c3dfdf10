"""The published column names, stated here in full."""

from tidemark import schemas

# The 109 features of a user in order, then what is written where a source has no rows.
FEATURES = """
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
ZERO_FILLED = """
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
CATEGORICAL = """
    prop_plan prop_country q_source q_flow_type q_team_size q_experience q_usage_plan q_frustration
    q_first_feature q_role ta_card_funding ta_card_brand ta_payment_method ta_bank_country
    ta_card_country
""".split()
TARGETS = ("is_churned", "is_vol", "is_invol")
TARGET_ENCODED = """
    prop_country prop_plan q_source q_frustration q_role q_usage_plan q_first_feature
""".split()


def test_names_are_the_published_ones():
    assert schemas.names(schemas.BASE_FEATURES) == FEATURES
    assert schemas.zero_filled() == ZERO_FILLED
    assert schemas.categorical() == CATEGORICAL
    encoded = [f"te_{c}_{t}" for c in TARGET_ENCODED for t in TARGETS]
    assert schemas.MODEL_FEATURES == [*FEATURES, *encoded]
