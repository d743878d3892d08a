"""A third of all rows under one key: results stay exact, and no single task gets the whole key."""

import pytest
from pyspark.sql import functions as F

from visitloom.operators import metrics, naive_bayes
from visitloom.operators.early import early_features
from visitloom.operators.ranking import rank_scores
from visitloom.operators.sessions import sessionize
from visitloom.spec import ATTRIBUTES

HOT = 200_000


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    """One session with 200,000 events and as many transactions; 400,000 events over 40,000 other sessions."""
    path = str(tmp_path_factory.mktemp("hot") / "flat")
    rows = spark.range(3 * HOT, numPartitions=8).select(
        F.when(F.col("id") < HOT, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40_000)).alias("user_pseudo_id"),
        F.lit(1).cast("long").alias("ga_session_id"),
        F.lit(10).cast("long").alias("engagement_time_msec"),
        F.lit("20240101").alias("event_date"),
        (F.col("id") * 100).alias("event_timestamp"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 2 == 0, "purchase").otherwise(F.concat(F.lit("e"), F.col("id") % 30)).alias("event_name"),
        *[F.when(F.col("id") % 5 > 0, F.concat(F.lit(a), F.col("id") % 3)).alias(a) for a in ATTRIBUTES],
        F.concat(F.lit("T"), F.col("id")).alias("transaction_id"),
        F.lit(1.0).alias("purchase_revenue"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def small_thresholds(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_session_is_exact(flat):
    sessions = sessionize(flat)
    row = sessions.where("user_pseudo_id = 'hot'").first()
    assert (row.total_events, row.transaction_count, row.purchase_events) == (HOT, HOT // 2, HOT // 2)
    assert row.distinct_event_types == 16 and row.traffic_source == "traffic_source1"  # fifteen others and purchase
    assert sessions.agg(F.sum("total_events"), F.sum("revenue")).first() == (3 * HOT, 1.5 * HOT)


def test_sessionize_keeps_no_collection_of_a_session(flat):
    plan = sessionize(flat)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "Expand" not in plan and "Window" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_hot_session_is_split_in_the_early_join(flat, small_thresholds):
    early = early_features(flat, window_seconds=30 * 86_400).select("session_id", "early_event_count")
    plan = final_plan(early)
    assert "skew=true" in plan
    assert early.where("session_id = 'hot-1'").first().early_event_count == HOT // 2


def test_hot_feature_value_is_split_when_the_lookup_is_not_broadcast(spark, small_thresholds):
    rows = spark.range(300_000, numPartitions=8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("session_id"), (F.col("id") % 7 == 0).cast("int").alias("converted"),
        F.when(F.col("id") % 3 > 0, "everyone").otherwise(F.concat(F.lit("v"), F.col("id") % 997)).alias("country"))
    model = naive_bayes.fit_naive_bayes(rows, ("country",))
    scored = naive_bayes.score_naive_bayes(model, rows).groupBy("model").agg(
        F.max("session_id"), F.count("predicted_probability").alias("n"))
    assert "skew=true" in final_plan(scored) and scored.first().n == 300_000


def test_hot_score_metrics_match_closed_forms(spark):
    """Scores carry no information, so AUC is one half; a third of the rows share one score."""
    rows = spark.range(60_000, numPartitions=8).selectExpr(
        "'m' AS model", "lpad(cast(id AS string), 9, '0') AS session_id", "cast(id % 2 AS int) AS converted",
        "CASE WHEN id % 6 < 2 THEN 0.5D ELSE (id div 2 % 5000) / 5000D END AS predicted_probability")
    ranked = rank_scores(rows)
    assert metrics.roc_auc(ranked).first().roc_auc == pytest.approx(0.5, abs=1e-12)
    table = metrics.decile_table(ranked).collect()
    assert {r.sessions for r in table} == {6000} and sum(r.purchases for r in table) == 30_000
