from helpers import by_key, ts

from tidemark.plans.profile import property_features, purchase_features, quiz_features
from tidemark.schemas import PROPERTY_FEATURES, PURCHASE_FEATURES, QUIZ_FEATURES, names

PURCHASE = "user_id string, purchase_amount_dollars double, purchase_type string"
QUIZ = (
    "user_id string, seq long, source string, flow_type string, team_size string, experience string, "
    "usage_plan string, frustration string, first_feature string, role string"
)


def test_purchases(spark):
    rows = [
        ("a", 1.0, "Credits pack"),
        ("a", 2.5, "credit_topup"),
        ("a", None, "credit_topup"),
        ("a", 4.0, None),
        ("b", None, None),
    ]
    df = purchase_features(spark.createDataFrame(rows, PURCHASE))
    assert df.columns == ["user_id", *names(PURCHASE_FEATURES)]
    got = by_key(df)
    assert list(got["a"].values()) == ["a", 4, 7.5, 2.5, 2, 3]
    assert list(got["b"].values()) == ["b", 1, 0.0, None, 0, 0]


def quiz(user, seq, frustration, source=None):
    return (user, seq, source, "long", None, None, None, frustration, None, "dev")


def test_first_quiz_row_wins_even_if_empty(spark):
    rows = [quiz("a", 5, "limited", "x"), quiz("a", 2, None), quiz("a", 9, "other", "y"), quiz("b", 0, "Other")]
    df = quiz_features(spark.createDataFrame(rows, QUIZ).repartition(4))
    assert df.columns == ["user_id", *names(QUIZ_FEATURES)]
    got = by_key(df)
    assert got["a"]["q_frustration"] is None and got["a"]["q_source"] is None
    assert got["a"]["q_role"] == "dev" and got["a"]["qf_limited"] == 0
    assert got["b"]["qf_other"] == 1


def test_both_spellings_of_each_frustration(spark):
    spellings = {
        "qf_cost": ["High cost of top models", "high-cost"],
        "qf_incon": ["inconsistent", "Inconsistent results"],
        "qf_limited": ["limited", "Limited generations"],
        "qf_prompt": ["hard-prompt", "Hard to prompt"],
        "qf_other": ["other", "Other"],
    }
    rows = [quiz(f"{flag}{i}", 0, s) for flag, ss in spellings.items() for i, s in enumerate(ss)]
    got = by_key(quiz_features(spark.createDataFrame(rows, QUIZ)))
    for user, f in got.items():
        assert {k for k in spellings if f[k]} == {user[:-1]}


def test_properties(spark):
    rows = [
        ("a", "Brand Pro", "DE", ts("2024-02-29 23:59:59")),  # a Thursday
        ("b", "Pro", None, None),
        ("c", None, "NA", ts("2024-03-03")),  # a Sunday
    ]
    schema = "user_id string, subscription_plan string, country_code string, subscription_start_date timestamp_ntz"
    df = property_features(spark.createDataFrame(rows, schema), plan_prefix="Brand ")
    assert df.columns == ["user_id", *names(PROPERTY_FEATURES)]
    got = {u: list(f.values())[1:] for u, f in by_key(df).items()}
    assert got == {
        "a": ["Brand Pro", "DE", 3, 3, 2, 29],
        "b": ["Pro", None, 0, None, None, None],
        "c": [None, "NA", 0, 6, 3, 3],
    }
