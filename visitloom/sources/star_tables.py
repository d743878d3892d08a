"""Adapter: the star-schema test tables (`events`, `customer`, `nation`) reshaped into nested web-analytics events.

The mapping is the one in FIXTURES.md section 2; ``k`` is the integer inside ``props``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only the columns that are used; given, so that no job is spent on reading file footers.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CUSTOMER = "c_custkey long, c_nationkey int, c_mktsegment string"
NATION = "n_nationkey int, n_name string"
# ``props`` is {"k": n}: stripping everything around the number is far cheaper than parsing JSON for each use of k.
NUMBER = """CAST(btrim(props, '{"k: }') AS INT)"""


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.schema(NATION).parquet(f"{sf_dir}/nation.parquet")
    # No hints: Spark broadcasts either table only while its files are small, and splits skewed users otherwise. Both are
    # joined to the events directly, because the planner knows the size of a file but not of a join.
    flat = (
        events.withColumn("k", F.expr(NUMBER))
        .join(customer, F.col("user_id") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    return flat.selectExpr(*MAPPING)


def _param(key: str, value: str) -> str:
    return f"named_struct('key', '{key}', 'value', named_struct('int_value', CAST({value} AS BIGINT)))"


MAPPING = [
    "date_format(ts, 'yyyyMMdd') AS event_date",
    # From one clock without a zone to another: the session's time zone has no part in it.
    "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS event_timestamp",
    "event_id",
    """CASE event_type
        WHEN 'click' THEN CASE WHEN k < 50 THEN 'page_view' WHEN k < 70 THEN 'scroll'
                               WHEN k < 85 THEN 'view_search_results' ELSE 'view_promotion' END
        WHEN 'view' THEN 'view_item'
        WHEN 'signup' THEN CASE WHEN k < 60 THEN 'add_to_cart' WHEN k < 95 THEN 'session_start' ELSE 'refund' END
        WHEN 'error' THEN CASE WHEN k < 50 THEN 'begin_checkout' WHEN k < 75 THEN 'add_shipping_info'
                               ELSE 'add_payment_info' END
        WHEN 'purchase' THEN CASE WHEN k < 25 THEN 'purchase' ELSE 'page_view' END
    END AS event_name""",
    "CAST(user_id AS STRING) AS user_pseudo_id",
    # A parameter without a value is left out of the array.
    "filter(array({}, {}), p -> p.value.int_value IS NOT NULL) AS event_params".format(
        _param("ga_session_id", "CASE WHEN k <> 99 THEN unix_date(CAST(ts AS DATE)) END"),
        _param("engagement_time_msec", "CASE WHEN k % 2 = 0 THEN k * 100 END")),
    """named_struct(
        'source', CASE WHEN k >= 3 THEN c_mktsegment END,
        'medium', CASE k % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'cpc' WHEN 2 THEN 'referral' END) AS traffic_source""",
    """named_struct(
        'category', CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN 'tablet' END,
        'operating_system', CASE WHEN k % 5 <> 4 THEN concat('OS_', k % 5) END) AS device""",
    "named_struct('country', n_name) AS geo",
    """named_struct(
        'transaction_id', concat('T', event_id % 7),
        'purchase_revenue', CASE WHEN k % 10 <> 0 THEN value END) AS ecommerce""",
]
