"""Input tables derived from the provided test tables, as SQL valid in Spark and DuckDB.

``$name`` stands for a source table: a Parquet path in Spark, a view in DuckDB. Every view reads its tables whole. Suppliers
are users too, with ids of their own: they have no properties, orders, quizzes or events, and so stand for users that a
source does not know.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from string import Template

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "users": """
SELECT c_custkey AS user_id,
  CASE WHEN c_acctbal < 1500 THEN 'invol_churn' WHEN c_acctbal < 4500 THEN 'vol_churn' ELSE 'not_churned' END AS churn_status,
  CASE WHEN c_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM $customer
UNION ALL SELECT s_suppkey + 1000000000,
  CASE WHEN s_acctbal < 1500 THEN 'invol_churn' WHEN s_acctbal < 4500 THEN 'vol_churn' ELSE 'not_churned' END,
  CASE WHEN s_suppkey % 10 < 8 THEN 'train' ELSE 'test' END FROM $supplier""",
    "properties": """
SELECT c_custkey AS user_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Basic' WHEN 'BUILDING' THEN 'Creator' WHEN 'FURNITURE' THEN 'Pro' WHEN 'HOUSEHOLD' THEN 'Ultimate' ELSE 'Legacy' END AS subscription_plan,
  CASE WHEN c_nationkey % 12 = 0 THEN NULL ELSE n_name END AS country_code,
  DATE '2024-01-01' + CAST(c_custkey % 14 AS INT) AS subscription_start_date
  FROM $customer LEFT JOIN $nation ON c_nationkey = n_nationkey""",
    "generations": """
SELECT event_id, user_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'nsfw' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'canceled' ELSE NULL END ELSE 'completed' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'video_a' WHEN 1 THEN 'image_a' WHEN 2 THEN 'image_b' WHEN 3 THEN 'text' ELSE NULL END AS generation_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS credit_cost,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(REPLACE(REPLACE(props, '{"k": ', ''), '}', '') AS DOUBLE) END AS duration
  FROM $events""",
    "transactions": """
SELECT o_orderkey AS attempt_id, o_custkey AS user_id, o_orderdate AS transaction_time,
  CAST(FLOOR(o_totalprice / 20000) * 100 + 0.125 AS DOUBLE) AS amount_in_usd,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 5 WHEN 0 THEN 'card_declined' WHEN 1 THEN 'incorrect_cvc' WHEN 2 THEN 'invalid_cvc' WHEN 3 THEN 'expired_card' ELSE 'authentication_required' END END AS failure_code,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 7 = 0 END AS is_prepaid,
  o_orderkey % 19 = 0 AS is_virtual, o_orderkey % 23 = 0 AS is_business,
  o_orderkey % 3 = 0 AS is_3d_secure, o_orderkey % 6 = 0 AS is_3d_secure_authenticated,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE n_name END AS card_country,
  CASE WHEN o_orderkey % 31 = 0 THEN 'NATION_0' WHEN o_orderkey % 9 = 0 THEN NULL ELSE n_name END AS billing_address_country,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE n_name END AS bank_country,
  CASE o_orderkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE NULL END AS cvc_check,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'prepaid' WHEN '2-HIGH' THEN 'credit' WHEN '3-MEDIUM' THEN 'debit' WHEN '5-LOW' THEN 'credit' ELSE NULL END AS card_funding,
  CASE o_orderkey % 3 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' ELSE 'amex' END AS card_brand,
  CASE WHEN o_orderkey % 2 = 0 THEN 'card' ELSE 'wallet' END AS payment_method_type
  FROM $orders JOIN $customer ON o_custkey = c_custkey JOIN $nation ON c_nationkey = n_nationkey""",
    "purchases": """
SELECT o_custkey AS user_id, l_extendedprice AS purchase_amount_dollars,
  CASE p_type WHEN 'PROMO' THEN 'Credits pack' WHEN 'ECONOMY' THEN 'credit_topup' WHEN 'SMALL' THEN NULL ELSE p_type END AS purchase_type
  FROM $lineitem JOIN $orders ON l_orderkey = o_orderkey JOIN $part ON l_partkey = p_partkey""",
    "quizzes": """
SELECT c_custkey AS user_id, seq,
  CASE WHEN (c_custkey + seq) % 8 = 0 THEN NULL ELSE concat('src', CAST((c_custkey + seq) % 5 AS STRING)) END AS source,
  CASE WHEN c_custkey % 2 = 0 THEN 'short' ELSE 'long' END AS flow_type,
  concat('team', CAST(c_custkey % 4 AS STRING)) AS team_size,
  concat('exp', CAST(c_custkey % 3 AS STRING)) AS experience,
  concat('plan', CAST((c_custkey + seq) % 6 AS STRING)) AS usage_plan,
  CASE (c_custkey + seq) % 11 WHEN 0 THEN 'High cost of top models' WHEN 1 THEN 'high-cost' WHEN 2 THEN 'inconsistent' WHEN 3 THEN 'Inconsistent results' WHEN 4 THEN 'limited' WHEN 5 THEN 'Limited generations' WHEN 6 THEN 'hard-prompt' WHEN 7 THEN 'Hard to prompt' WHEN 8 THEN 'other' WHEN 9 THEN 'Other' ELSE NULL END AS frustration,
  concat('feat', CAST((c_custkey + seq) % 7 AS STRING)) AS first_feature,
  concat('role', CAST(c_custkey % 5 AS STRING)) AS role
  FROM $customer_twice s WHERE seq = 0 OR c_custkey % 3 = 0""",
}

SOURCES = ("customer", "supplier", "nation", "orders", "lineitem", "part", "events")
# Every customer twice, with sequence 0 and 1.
_TWICE = "(SELECT c_custkey, 0 AS seq FROM {c} UNION ALL SELECT c_custkey, 1 AS seq FROM {c})"


def _sql(text: str, sources: dict[str, str]) -> str:
    names = dict(sources, customer_twice=_TWICE.format(c=sources["customer"]))
    return Template(text).substitute(names)


def tables(spark: SparkSession, sf_dir: str, views: Iterable[str] = VIEWS) -> dict[str, DataFrame]:
    """The named views over the Parquet files of a data folder."""
    sources: dict[str, DataFrame] = {}
    out = {}
    for view in views:
        used = [s for s in SOURCES if re.search(rf"\${s}\b", VIEWS[view].replace("_twice", ""))]
        for s in used:
            sources.setdefault(s, spark.read.parquet(f"{sf_dir}/{s}.parquet"))
        # Braces mark the tables handed to spark.sql, so those of the text itself are doubled.
        text = VIEWS[view].replace("{", "{{").replace("}", "}}")
        sql = _sql(text, {s: f"{{{s}}}" for s in SOURCES})
        out[view] = spark.sql(sql, **{s: sources[s] for s in used})
    return out


def table(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return tables(spark, sf_dir, [view])[view]


def duckdb_sql(view: str) -> str:
    return _sql(VIEWS[view], {s: s for s in SOURCES})
