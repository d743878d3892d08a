"""Cases that must neither lose rows or values in silence nor change with the size of the data."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from visitloom.operators import features, metrics, monitoring, quality, ranking
from visitloom.sources import events, tables
from visitloom.spec import DEFAULT_SPEC


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, session_id string, converted int, predicted_probability double")


def test_tiny_scores_keep_their_order(spark):
    rng = random.Random(1)
    rows = [("m", f"s{i:04d}", int(i < 100), (2e-10 if i < 100 else 1e-10) + rng.random() * 5e-11) for i in range(1000)]
    row = metrics.model_metrics(scored(spark, rows)).first()
    assert row.roc_auc == 1.0 and row.pr_auc == pytest.approx(1.0)


def test_null_groups_keep_their_rows(spark):
    rng = random.Random(2)
    rows = [("m", f"s{i:02d}", rng.randrange(2), rng.random(), [None, "a", "b"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, session_id string, converted int, predicted_probability double, segment string")
    ranked = ranking.rank_scores(df, ("model", "segment"))
    assert ranked.rows.count() == 60
    table = {r.segment: r for r in monitoring.segment_metrics(df, "segment").collect()}
    assert set(table) == {None, "a", "b"}
    alone = metrics.model_metrics(df.where("segment IS NULL").drop("segment")).first()
    assert all(table[None][m] == pytest.approx(alone[m]) for m in metrics.METRICS)


def test_null_keys_count_as_one_key_in_both_checks(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "session_id string")
    audit = quality.uniqueness_audit(df).first()
    assert (audit.rows, audit.unique_sessions, audit.duplicate_sessions) == (4, 3, 1)
    full = df.withColumns({c: F.lit(None).cast("string") for c in ("converted", *DEFAULT_SPEC.features)}).withColumn(
        "session_date", F.lit("2024-01-01").cast("date"))
    report = {r["check"]: r.result for r in quality.quality_report(full).collect()}
    assert report["Duplicate session IDs"] == "1"
    empty = quality.uniqueness_audit(df.limit(0)).first()
    assert (empty.rows, empty.unique_sessions, empty.duplicate_sessions) == (0, 0, 0)


def test_arms_of_two_models_stay_apart(spark):
    rows = [(m, f"s{i:04d}", i % 7 == 0, random.Random(i).random()) for m in ("a", "b") for i in range(200)]
    arms = monitoring.assign_arms(ranking.rank_scores(scored(spark, [(m, k, int(y), p) for m, k, y, p in rows])))
    assert arms.groupBy("model").count().where("count = 200").count() == 2
    sessions = spark.createDataFrame([(f"s{i:04d}", int(i % 7 == 0), float(i)) for i in range(200)], "session_id string, converted int, revenue double")
    outcomes = monitoring.experiment_outcomes(arms, sessions)
    assert {r["n"] for r in outcomes.groupBy("model").agg(F.sum("eligible_sessions").alias("n")).collect()} == {200}


def csv_line(names, **values):
    usual = {f.name: "a" if f.dataType.typeName() == "string" else "1" for f in tables.SESSION_SCHEMA}
    usual |= {"session_date": "2024-01-02", "revenue": "1.5"} | values
    return ",".join(str(usual[n]) for n in names)


def test_csv_is_read_by_name_and_fails_on_bad_values(spark, tmp_path):
    names = tables.SESSION_SCHEMA.fieldNames()
    turned = list(reversed(names))
    good, bad, short = tmp_path / "good.csv", tmp_path / "bad.csv", tmp_path / "short.csv"
    good.write_text(",".join(turned) + "\n" + csv_line(turned, viewed_product=0, added_to_cart=7) + "\n")
    row = tables.read_session_csv(spark, str(good)).first()
    assert (row.viewed_product, row.added_to_cart, row.revenue, str(row.session_date)) == (0, 7, 1.5, "2024-01-02")
    bad.write_text(",".join(names) + "\n" + csv_line(names, revenue="much") + "\n")
    with pytest.raises(PySparkException, match="revenue"):
        tables.read_session_csv(spark, str(bad)).collect()
    short.write_text(",".join(names[1:]) + "\n" + csv_line(names[1:]) + "\n")
    with pytest.raises(ValueError, match="session_id"):
        tables.read_session_csv(spark, str(short))


def test_partitioned_writes_bound_the_number_of_files(spark, tmp_path):
    days = spark.range(8000).selectExpr(
        "CAST(id AS STRING) AS session_id", "date_add(DATE '2024-01-01', CAST(id % 20 AS INT)) AS session_date").repartition(8)
    tables.write_sessions(days, str(tmp_path / "sessions"))
    assert len(list((tmp_path / "sessions").rglob("*.parquet"))) <= 28
    assert spark.read.parquet(str(tmp_path / "sessions")).count() == 8000


def test_ties_are_broken_without_event_ids(spark, tmp_path):
    flat_schema = events.EVENT_SCHEMA
    stored = spark.createDataFrame([], flat_schema).drop("event_id")
    one = stored.union(spark.range(2).selectExpr(
        "'20240101'", "5L", "'page_view'", "'u'",
        "array(named_struct('key', 'ga_session_id', 'value', named_struct('int_value', 1L)))",
        "named_struct('source', CAST(id AS STRING), 'medium', 'x')", "named_struct('category', 'd', 'operating_system', 'o')",
        "named_struct('country', 'c')", "named_struct('transaction_id', 't', 'purchase_revenue', 1D)"))
    events.write_events(one, str(tmp_path / "events"))
    flat = events.flatten_events(events.scan_events(spark, str(tmp_path / "events")))
    ids = [r.event_id for r in flat.collect()]
    assert len(set(ids)) == 2 and None not in ids


def test_encoding_of_no_rows(spark):
    df = spark.createDataFrame([], "session_id string, " + ", ".join(f"{f} string" for f in DEFAULT_SPEC.features))
    assert features.hash_encode(df).count() == 0
