"""Events stored by session: the same answers, no shuffle of events, hot sessions spread."""

import re

import pytest
from frames import SECOND, event, flat
from pyspark.sql import functions as F

from visitloom.operators.early import early_features, early_features_stored
from visitloom.operators.sessions import sessionize
from visitloom.sources.event_store import PART, STORE_KEY, open_event_store, write_event_store
from visitloom.spec import ATTRIBUTES

HOT = 90_000


@pytest.fixture(scope="module")
def hot_log(spark, tmp_path_factory):
    """One session with 90,000 events, 180,000 events over 9,000 others; then the same in a store with parts of 5,000 events."""
    folder = str(tmp_path_factory.mktemp("store"))
    spark.range(3 * HOT, numPartitions=8).select(
        F.when(F.col("id") < HOT, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 9_000)).alias("user_pseudo_id"),
        F.lit(1).cast("long").alias("ga_session_id"),
        F.lit(10).cast("long").alias("engagement_time_msec"),
        F.lit("20240101").alias("event_date"),
        (F.col("id") * 100).alias("event_timestamp"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 50 == 0, "purchase").otherwise(F.concat(F.lit("e"), F.col("id") % 30)).alias("event_name"),
        *[F.when(F.col("id") % 5 > 0, F.concat(F.lit(a), F.col("id") % 3)).alias(a) for a in ATTRIBUTES],
        F.concat(F.lit("T"), F.col("id")).alias("transaction_id"),
        F.lit(1.0).alias("purchase_revenue"),
    ).write.parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    write_event_store(log, f"{folder}/store", hot=5_000)
    return log, f"{folder}/store"


@pytest.fixture
def no_broadcast(spark):
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {key: spark.conf.get(key, None) for key in settings}
    for key in settings:
        spark.conf.set(key, "-1")
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def same_rows(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    rows = [sorted(map(repr, df.select(*columns).collect())) for df in (left, right)]
    assert rows[0] == rows[1] and rows[0]


def shuffled(plan: str) -> list[str]:
    """The operator below each shuffle."""
    lines = plan.splitlines()
    return [re.sub(r"^[^A-Za-z]*(\(\d+\) )?", "", lines[i + 1]).split("(")[0].split(" ")[0]
            for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_events_are_not_shuffled(spark, hot_log, no_broadcast):
    stored = open_event_store(spark, hot_log[1]).read(spark)
    plan = early_features_stored(stored, window_seconds=60)._jdf.queryExecution().executedPlan().toString()
    below = shuffled(plan)
    assert "SortMergeJoin" in plan and "Bucketed: true" in early_features_stored(stored)._jdf.queryExecution().toString()
    # Starts of parts (twice: to find the session's start, and back to their buckets), and sums of the window; never a scan or a filter.
    assert all("Aggregate" in name or name in ("Project", "Window") for name in below), plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            rest = next(j for j in range(i + 1, len(lines)) if "Aggregate" in lines[j] or "Window" in lines[j] or "Scan" in lines[j])
            assert "Scan" not in lines[rest], plan


def test_stored_log_gives_the_same_features(spark, hot_log, no_broadcast):
    log, path = hot_log
    stored = open_event_store(spark, path).read(spark)
    for seconds in (3, 30):
        same_rows(early_features_stored(stored, window_seconds=seconds), early_features(log, window_seconds=seconds))
    same_rows(sessionize(stored.drop(PART)), sessionize(log))


def test_hot_session_is_spread(spark, hot_log):
    stored = open_event_store(spark, hot_log[1]).read(spark)
    sizes = {r[0]: r["count"] for r in stored.where("user_pseudo_id = 'hot'").groupBy(PART).count().collect()}
    assert len(sizes) == HOT // 5_000 and sum(sizes.values()) == HOT and max(sizes.values()) < 2 * 5_000
    assert stored.where("user_pseudo_id <> 'hot'").agg(F.max(PART)).first()[0] == 0
    files = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(files) == 8 and max(files) < HOT  # one file for each bucket


def test_odd_events_in_a_store(spark, tmp_path):
    """Null users, repeated events, an empty log."""
    rows = flat(spark, *[event("page_view", at=i * SECOND, user=None, event_id=i) for i in range(40)],
                *[event("page_view", user="copies", event_id=7) for _ in range(30)], event("purchase", at=600 * SECOND, user="copies"))
    write_event_store(rows, str(tmp_path / "odd"), buckets=3, hot=10)
    stored = open_event_store(spark, str(tmp_path / "odd")).read(spark)
    same_rows(stored.drop(PART), rows)
    same_rows(early_features_stored(stored), early_features(rows))
    assert stored.where("user_pseudo_id IS NULL").select(PART).distinct().count() > 1
    empty = write_event_store(rows.limit(0), str(tmp_path / "none"), buckets=2).read(spark)
    assert early_features_stored(empty).collect() == [] and set(STORE_KEY) <= set(empty.columns)
