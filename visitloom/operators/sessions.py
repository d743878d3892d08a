"""Events to sessions, and the totals of a session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.scalar import or_missing, ratio
from visitloom.spec import DEFAULT_SPEC, KPI_NAMES, SessionSpec

SESSION_KEY = ("user_pseudo_id", "ga_session_id")


def named(event: str) -> Column:
    return F.col("event_name") == event


def earliest(column: str) -> Column:
    """Aggregate: (time, event id, value) of the first event in time order on which the column is not null."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct("event_timestamp", "event_id", column))).alias(column)


def session_id() -> Column:
    return F.concat(F.col("user_pseudo_id").cast("string"), F.lit("-"), F.col("ga_session_id").cast("string"))


def calendar(date: str) -> tuple[Column, Column]:
    """Day of week (1 = Sunday) and the 0/1 weekend flag."""
    return (F.dayofweek(date).alias("day_of_week"),
            F.when(F.dayofweek(date).isin(1, 7), 1).otherwise(0).alias("is_weekend"))


def sessionize(flat: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per (user, session id) with the 30 session columns.

    Two levels of aggregation with constant state per group. The first groups by session, event name and purchase
    transaction; the second by session. Counting the first level's groups gives both distinct counts exactly, with no
    set collected and no row expanded, so a session holding a large share of all events is combined on the map side
    and spread over tasks by event and transaction.
    """
    return sessions_of_steps(session_steps(flat, spec), spec)


def session_steps(flat: DataFrame, spec: SessionSpec = DEFAULT_SPEC, by: tuple = ()) -> DataFrame:
    """The first level, also apart by the columns ``by``. Steps of parts of the log can be merged with :func:`merge_steps`."""
    purchase = named(spec.purchase_event)
    transaction = F.when(purchase, F.col("transaction_id")).alias("transaction_id")
    date = [] if "event_date" in by else [F.min("event_date").alias("event_date")]
    return flat.withColumn("transaction_id", transaction).groupBy(*SESSION_KEY, "event_name", "transaction_id", *by).agg(
        F.count(F.lit(1)).alias("events"),
        *date,
        F.min("event_timestamp").alias("start_ts"),
        F.max("event_timestamp").alias("end_ts"),
        *[earliest(a) for a in spec.attributes],
        F.sum(F.when(purchase, F.coalesce("purchase_revenue", F.lit(0.0))).otherwise(0.0)).alias("revenue"),
        F.sum(F.coalesce("engagement_time_msec", F.lit(0))).alias("engagement"),
    )


def merge_steps(steps: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """Steps of several parts as those of all events together."""
    return steps.groupBy(*SESSION_KEY, "event_name", "transaction_id").agg(
        F.sum("events").alias("events"), F.min("event_date").alias("event_date"), F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"), *[F.min(a).alias(a) for a in spec.attributes], F.sum("revenue").alias("revenue"),
        F.sum("engagement").alias("engagement"))


def sessions_of_steps(steps: DataFrame, spec: SessionSpec = DEFAULT_SPEC) -> DataFrame:
    """The second level: one row for each session."""
    purchase = named(spec.purchase_event)
    sessions = steps.groupBy(*SESSION_KEY).agg(
        F.to_date(F.min("event_date"), "yyyyMMdd").alias("session_date"),
        *[F.min(a)[a].alias(a) for a in spec.attributes],
        F.sum("events").alias("total_events"),
        (F.count_if(~purchase) + F.max(F.when(purchase, 1).otherwise(0))).alias("distinct_event_types"),
        *[F.sum(F.when(named(event), F.col("events")).otherwise(0)).alias(c) for c, event in spec.counters],
        *[F.max(F.when(named(event), 1).otherwise(0)).alias(c) for c, event in spec.flags],
        F.count("transaction_id").alias("transaction_count"),
        F.sum("revenue").alias("revenue"),
        ratio(F.max("end_ts") - F.min("start_ts"), F.lit(1_000_000)).alias("session_duration_seconds"),
        ratio(F.sum("engagement"), F.lit(1000)).alias("engagement_time_seconds"),
    )
    return sessions.select(
        session_id().alias("session_id"),
        *SESSION_KEY,
        "session_date",
        *calendar("session_date"),
        *[or_missing(a).alias(a) for a in spec.attributes],
        "total_events",
        "distinct_event_types",
        *[c for c, _ in spec.counters],
        *[c for c, _ in spec.flags],
        "transaction_count",
        "revenue",
        "session_duration_seconds",
        "engagement_time_seconds",
    )


def core_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_distinct("user_pseudo_id").alias("unique_users"),
        F.sum("total_events").alias("total_events"),
        F.sum("converted").alias("converted_sessions"),
        ratio(F.sum("converted"), F.count(F.lit(1))).alias("conversion_rate"),
        F.sum("revenue").alias("total_revenue"),
    )


def kpis(sessions: DataFrame) -> DataFrame:
    """Business indicators as (kpi, value) rows."""
    totals = core_totals(sessions).withColumn("per_session", ratio("total_revenue", "total_sessions"))
    columns = ("total_events", "unique_users", "total_sessions", "converted_sessions", "conversion_rate",
               "total_revenue", "per_session")
    return totals.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, KPI_NAMES)]).unpivot(
        [], list(KPI_NAMES), "kpi", "value")
