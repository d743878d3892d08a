"""The nested event log: its schema, the pruned scan, and the flat view that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions.scalar import int_param
from visitloom.spec import DEFAULT_SPEC, SessionSpec

EVENT_SCHEMA = T.StructType([
    T.StructField("event_date", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_params", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StructType([T.StructField("int_value", T.LongType())])),
    ]))),
    T.StructField("traffic_source", T.StructType([
        T.StructField("source", T.StringType()), T.StructField("medium", T.StringType())])),
    T.StructField("device", T.StructType([
        T.StructField("category", T.StringType()), T.StructField("operating_system", T.StringType())])),
    T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
    T.StructField("ecommerce", T.StructType([
        T.StructField("transaction_id", T.StringType()), T.StructField("purchase_revenue", T.DoubleType())])),
])


def scan_events(spark: SparkSession, root: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Nested events stored under ``root`` by ``event_date=YYYYMMDD``, only the days asked for (both ends included).

    The explicit schema keeps the day a string; the day filter selects folders before any file is opened. In files of a tracker
    that had no ``event_id`` then, it is null.
    """
    events = spark.read.schema(EVENT_SCHEMA).parquet(root)
    if first_day is not None:
        events = events.where(F.col("event_date") >= first_day)
    if last_day is not None:
        events = events.where(F.col("event_date") <= last_day)
    return events


def write_events(events: DataFrame, root: str) -> None:
    """Store nested events by day, a few files for each day; adaptive execution splits large days."""
    events.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(root)


def flatten_events(events: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """One flat row per event that belongs to a session; events without a session id are dropped.

    An event without ``event_id`` gets a stable one from the columns read here, used only to break timestamp ties.
    """
    made = F.xxhash64(
        "event_name", int_param("event_params", spec.engagement_param), F.col("traffic_source.source"),
        F.col("traffic_source.medium"), F.col("device.category"), F.col("device.operating_system"), F.col("geo.country"),
        F.col("ecommerce.transaction_id"), F.col("ecommerce.purchase_revenue"))
    tie = F.coalesce("event_id", made) if "event_id" in events.columns else made
    return events.select(
        "user_pseudo_id",
        int_param("event_params", spec.session_param).alias("ga_session_id"),
        int_param("event_params", spec.engagement_param).alias("engagement_time_msec"),
        "event_date",
        "event_timestamp",
        tie.alias("event_id"),
        "event_name",
        F.col("traffic_source.source").alias("traffic_source"),
        F.col("traffic_source.medium").alias("traffic_medium"),
        F.col("device.category").alias("device_category"),
        F.col("device.operating_system").alias("operating_system"),
        F.col("geo.country").alias("country"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
    ).where(F.col("ga_session_id").isNotNull())
