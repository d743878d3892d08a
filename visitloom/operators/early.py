"""Behaviour in the first minutes of a session, with a label that lies strictly after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scalar import ratio
from visitloom.operators.sessions import SESSION_KEY, calendar, earliest, named, session_id
from visitloom.sources.event_store import STORE_KEY
from visitloom.spec import DEFAULT_SPEC, SessionSpec

MICROS = 1_000_000
MICROS_PER_HOUR = 3_600_000_000


def _starts(flat: DataFrame, spec: SessionSpec, window_seconds: int) -> DataFrame:
    """Start of every session, and 1 when a purchase lies strictly after the window."""
    horizon = F.min("event_timestamp") + F.lit(window_seconds * MICROS).cast("long")
    late = F.max(F.when(named(spec.purchase_event), F.col("event_timestamp"))) > horizon
    return flat.groupBy(*SESSION_KEY).agg(
        F.min("event_timestamp").alias("start_ts"), F.when(late, 1).otherwise(0).alias("converted"))


def label_after_horizon(flat: DataFrame, spec: SessionSpec = DEFAULT_SPEC,
                        window_seconds: int | None = None) -> DataFrame:
    """Session id and its label; two numbers of state per session, one shuffle."""
    window_seconds = spec.early_window_seconds if window_seconds is None else window_seconds
    return _starts(flat, spec, window_seconds).select(session_id().alias("session_id"), "converted")


def early_features(flat: DataFrame, spec: SessionSpec = DEFAULT_SPEC, window_seconds: int | None = None) -> DataFrame:
    """One row per session with at least one allowed event inside the window (both ends included).

    Events meet the start of their session in an equi-join; the time window is a filter on top. Unlike a window function,
    the join lets adaptive execution split a session that holds very many events. It can do so only where both join
    inputs come straight from a shuffle and no later step relies on the join's partitioning. Hence the join key is the
    two-part session key plus its text, while the groupings before and after it use the two parts alone. The last
    aggregation is two-level with constant state, as in ``sessionize``.
    """
    window_seconds = spec.early_window_seconds if window_seconds is None else window_seconds
    allowed = flat.where(~F.col("event_name").isin(*spec.early_excluded)).withColumn("session_id", session_id())
    starts = _starts(flat, spec, window_seconds).withColumn("session_id", session_id())
    early = allowed.join(starts, [*SESSION_KEY, "session_id"]).where(
        F.col("event_timestamp") <= F.col("start_ts") + F.lit(window_seconds * MICROS).cast("long"))
    return _of_window(early, spec)


def early_features_stored(stored: DataFrame, spec: SessionSpec = DEFAULT_SPEC, window_seconds: int | None = None) -> DataFrame:
    """:func:`early_features` of events that are stored by session. What is shuffled are the starts, one row for each part of a session,
    and the sums of the window, but no event: the events of a part lie together, and each part meets the start of its whole session."""
    window_seconds = spec.early_window_seconds if window_seconds is None else window_seconds
    allowed = stored.where(~F.col("event_name").isin(*spec.early_excluded))
    parts = stored.groupBy(*STORE_KEY).agg(
        F.min("event_timestamp").alias("first"), F.max(F.when(named(spec.purchase_event), F.col("event_timestamp"))).alias("late"))
    whole = Window.partitionBy(*SESSION_KEY)
    length = F.lit(window_seconds * MICROS).cast("long")
    starts = parts.select(*STORE_KEY, F.min("first").over(whole).alias("start_ts"), F.max("late").over(whole).alias("late")).select(
        *STORE_KEY, "start_ts", F.when(F.col("late") > F.col("start_ts") + length, 1).otherwise(0).alias("converted"))
    early = allowed.join(starts, [*STORE_KEY]).where(F.col("event_timestamp") <= F.col("start_ts") + length)
    return _of_window(early, spec)


def _of_window(early: DataFrame, spec: SessionSpec) -> DataFrame:
    """Sessions of the events inside the window, each with the start and label of its session."""
    steps = early.groupBy(*SESSION_KEY, "event_name").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_date").alias("event_date"),
        F.min("start_ts").alias("start_ts"),
        F.max("converted").alias("converted"),
        F.sum(F.coalesce("engagement_time_msec", F.lit(0))).alias("engagement"),
        *[earliest(a) for a in spec.attributes],
    )
    sessions = steps.groupBy(*SESSION_KEY).agg(
        F.to_date(F.min("event_date"), "yyyyMMdd").alias("session_date"),
        F.max("converted").alias("converted"),
        F.sum("events").alias("early_event_count"),
        F.count("event_name").alias("early_distinct_event_types"),
        *[F.sum(F.when(named(event), F.col("events")).otherwise(0)).alias(c) for c, event in spec.early_counters],
        ratio(F.sum("engagement"), F.lit(1000)).alias("early_engagement_seconds"),
        *[F.min(a)[a].alias(a) for a in spec.attributes],
        F.min("start_ts").alias("start_ts"),
    )
    return sessions.select(
        session_id().alias("session_id"),
        *[c for c in sessions.columns if c not in (*SESSION_KEY, "start_ts")],
        *calendar("session_date"),
        F.expr(f"pmod(start_ts div {MICROS_PER_HOUR}, 24)").cast("int").alias("session_hour"),
    )
