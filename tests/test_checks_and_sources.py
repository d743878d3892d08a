"""Checks, files, reports and monitoring."""

import datetime as dt

import pytest
from frames import event, flat
from pyspark.sql import functions as F

from visitloom.operators import features, logistic, monitoring, quality
from visitloom.operators.sessions import sessionize
from visitloom.sources import events, tables, workspace
from visitloom.spec import DATE, EARLY_LEAKAGE_WORDS, START_FEATURES, START_LEAKAGE_WORDS


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [event("page_view" if i % 3 else "purchase", i, user=f"u{i % 20}", session=i % 2, event_id=i,
                  day=f"202311{14 + i % 5:02d}", source=f"s{i % 3}", transaction="T", revenue=2.5) for i in range(120)]
    return sessionize(flat(spark, *rows)).cache()


def test_words_and_tokens_agree_on_the_contract(spark, sessions):
    start = features.start_features(sessions)
    assert quality.leakage_audit_regex(start, START_LEAKAGE_WORDS, "converted").count() == 0
    found = {r.column_name for r in quality.leakage_audit_regex(sessions, START_LEAKAGE_WORDS, "converted").collect()}
    assert {"page_views", "revenue", "session_duration_seconds", "total_events"} <= found
    assert "early_page_views" not in quality.columns_matching(["early_page_views", "converted"], EARLY_LEAKAGE_WORDS)
    leaking = list(START_FEATURES) + ["page_views"]
    assert quality.features_with_token(leaking, START_LEAKAGE_WORDS) == ["page_views"]
    rows = {r.control: r.result for r in quality.leakage_audit_tokens(sessions, leaking, START_LEAKAGE_WORDS).collect()}
    assert rows["Feature contract"] == "Failed"


def test_contract_violations_raise(sessions):
    quality.require_contract(sessions)
    with pytest.raises(ValueError, match="country"):
        quality.require_contract(sessions.drop("country"))
    with pytest.raises(ValueError, match="page_views"):
        quality.require_contract(sessions, features=(*START_FEATURES, "page_views"))


def test_quality_report_counts_nulls_and_duplicates(spark, sessions):
    twice = sessions.unionByName(sessions.limit(3))
    report = {r.check: r.result for r in quality.quality_report(twice.drop("country")).collect()}
    assert report["Required columns missing"] == "[country]" and report["Duplicate session IDs"] == "3"
    assert quality.duplicate_keys(twice).count() == 3
    assert quality.uniqueness_audit(twice).first().duplicate_sessions == 3


def test_split_raises_when_a_side_is_empty(sessions):
    train, test = quality.chrono_split(sessions, dt.date(2023, 11, 16))
    assert train.count() + test.count() == sessions.count()
    with pytest.raises(ValueError):
        quality.chrono_split(sessions, dt.date(2030, 1, 1))


def test_reconcile_fails_on_values_and_on_missing_rows(spark):
    actual = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "name string, value double")
    expected = spark.createDataFrame([("a", 1.00005), ("b", 2.5), ("d", 1.0)], "name string, value double")
    got = {r.check: r.passed for r in quality.reconcile(actual, expected, "name", tolerance=1e-4).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}
    assert quality.difference(actual, actual).isEmpty()
    assert quality.difference(actual, actual.where("name <> 'a'")).collect()[0].side == "actual only"


def test_reconcile_takes_a_tolerance_per_check(spark):
    actual = spark.createDataFrame([("lift", 2.01), ("auc", 0.51)], "name string, value double")
    expected = spark.createDataFrame([("lift", 2.0, 0.02), ("auc", 0.5, 1e-4)], "name string, value double, tolerance double")
    assert {r.check: r.passed for r in quality.reconcile(actual, expected, "name").collect()} == {"lift": True, "auc": False}


def test_catalog_table_is_replaced_and_described(spark):
    for rows in (3, 2):
        stored = tables.save_as_table(spark.range(rows).withColumnRenamed("id", "total_events"), "shop", "sessions")
    assert stored.count() == 2
    described = tables.column_catalog(spark, "shop.sessions")
    assert [tuple(r) for r in described.collect()] == [("total_events", "bigint")]


def test_event_store_reads_only_the_days_asked_for(spark, tmp_path):
    nested = spark.createDataFrame([event("page_view", i, event_id=i, day=f"202311{10 + i}") for i in range(9)],
                                   events.EVENT_SCHEMA)
    events.write_events(nested, str(tmp_path / "events"))
    chosen = events.scan_events(spark, str(tmp_path / "events"), "20231112", "20231114")
    assert sorted(r.event_date for r in chosen.collect()) == ["20231112", "20231113", "20231114"]
    plan = events.flatten_events(chosen)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_long_string_parameters_stay_on_disk(spark, tmp_path):
    """The stored parameters carry strings; the flat view must not read them."""
    spark.sql("""SELECT '20231114' AS event_date, 1L AS event_timestamp, 1L AS event_id, 'page_view' AS event_name,
        'u' AS user_pseudo_id, array(named_struct('key', 'ga_session_id', 'value',
        named_struct('string_value', 'x', 'int_value', 5L))) AS event_params,
        named_struct('source', 's', 'medium', 'm', 'name', 'n') AS traffic_source,
        named_struct('category', 'c', 'operating_system', 'o') AS device, named_struct('country', 'c') AS geo,
        named_struct('transaction_id', 't', 'purchase_revenue', 1.0D) AS ecommerce""").write.parquet(str(tmp_path / "e"))
    flat_rows = events.flatten_events(spark.read.parquet(str(tmp_path / "e")))
    plan = flat_rows._jdf.queryExecution().executedPlan().toString()
    assert "int_value" in plan and "string_value" not in plan
    assert flat_rows.first().ga_session_id == 5


def test_tie_breaker_without_event_ids(spark):
    nested = spark.createDataFrame([event("page_view")], events.EVENT_SCHEMA).drop("event_id")
    assert events.flatten_events(nested).first().event_id is not None


def test_session_files_round_trip(spark, sessions, tmp_path):
    tables.write_sessions(sessions, str(tmp_path / "p"))
    stored = tables.read_sessions(spark, str(tmp_path / "p"))
    assert stored.schema.fieldNames() == tables.SESSION_SCHEMA.fieldNames()
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, sessions.collect()))
    assert "PartitionFilters: [isnotnull(session_date" in stored.where(
        f"{DATE} >= '2023-11-16'")._jdf.queryExecution().executedPlan().toString()
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        tables.write_session_csv(sessions, path, compression)
        assert sorted(map(tuple, tables.read_session_csv(spark, path).collect())) == sorted(map(tuple, sessions.collect()))
    assert tables.query_csv(spark, path).first().sessions == sessions.count()


def test_gzip_file_is_spread(spark, sessions, tmp_path):
    import glob
    tables.write_session_csv(sessions.coalesce(1), str(tmp_path / "z"), "gzip")
    file = glob.glob(str(tmp_path / "z" / "*.csv.gz"))[0]
    rows = tables.read_session_csv(spark, file)
    assert rows.count() == sessions.count()
    assert "Exchange hashpartitioning(session_id" in rows._jdf.queryExecution().executedPlan().toString()


def test_small_files_and_catalog(spark, sessions, tmp_path):
    metrics = spark.createDataFrame([("m", "pr_auc", 0.5)], tables.METRIC_SCHEMA)
    tables.write_metrics(metrics, str(tmp_path / "json"))
    assert tables.read_metrics(spark, str(tmp_path / "json")).collect() == metrics.collect()
    (tmp_path / "doc.json").write_text('{\n "a": {"b": 1}\n}')
    assert tables.read_document(spark, str(tmp_path / "doc.json")).first().a.b == 1
    decile = spark.createDataFrame([(2, 0.5), (1, 1.5)], "score_decile int, lift double")
    tables.write_small_csv(decile, "score_decile", str(tmp_path / "lift"))
    assert spark.read.csv(str(tmp_path / "lift"), header=True).first().score_decile == "1"
    assert tables.peek(sessions, "session_id").count() == 5


def test_scores_csv_has_iso_dates(spark, tmp_path):
    scored = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1, 0.25)],
                                   "session_id string, session_date date, converted int, predicted_probability double")
    tables.write_scores(scored, str(tmp_path / "s"))
    assert tuple(spark.read.csv(str(tmp_path / "s"), header=True).first()) == ("a", "2024-01-02", "1", "0.25")


def test_shared_folder_follows_the_setting(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert workspace.shared_folder(spark) == (setting or workspace.shared_folder(spark))


def test_monitoring_of_unseen_and_missing_values(spark):
    schema = "session_id string, converted int, country string"
    train = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B")], schema)
    test = spark.createDataFrame([("c", 0, "A"), ("d", 0, None), ("e", 0, "Z"), ("f", 1, "A")], schema)
    row = monitoring.input_coverage(train, test, ("country",)).first()
    assert (row.sessions, row.missing_rate, row.unseen_rate) == (4, 0.25, 0.5)
    assert monitoring.feature_drift(train, train, ("country",)).first().stability_index == 0.0
    assert monitoring.feature_drift(train, test, ("country",)).first().stability_index > 1.0


def test_label_definition_is_held_against_the_purchases(spark):
    rows = flat(spark, event("page_view", 0, "a"), event("purchase", 0, "b", transaction="T"))
    sessions = sessionize(rows)
    result = lambda df: {r.control: r.result for r in quality.leakage_audit_tokens(
        df, START_FEATURES, START_LEAKAGE_WORDS).collect()}["Label definition"]
    assert result(sessions) == "Any purchase within the session"
    assert result(sessions.withColumn("converted", 1 - F.col("converted"))) == "Violated"
    assert result(sessions.drop("purchase_events")) == "Any purchase within the session"


def test_a_saved_logistic_model_is_whole(spark, tmp_path):
    model = logistic.HashedLogistic(spark, (0.5, -1.0), 0.25, (0.7, 0.6), ("a", "b"), False)
    model.save(str(tmp_path))
    again = logistic.load_hashed_logistic(spark, str(tmp_path), ("a", "b"))
    assert (again.weights, again.intercept, again.history, again.features, again.converged) == (
        model.weights, model.intercept, model.history, model.features, model.converged)
    with pytest.raises(ValueError, match="was fitted on"):
        logistic.load_hashed_logistic(spark, str(tmp_path), ("a",))


def test_documents_are_indented_and_read_back(spark, tmp_path):
    row = spark.sql("SELECT named_struct('n', 1, 't', 'a\"b') AS data, array(0.5D, 0.25D) AS loss, CAST(NULL AS string) AS nothing")
    tables.write_document(row, str(tmp_path / "document"))
    written = next(p for p in (tmp_path / "document").iterdir() if p.name.startswith("part-")).read_text()
    assert written.count("\n") > 4
    got = tables.read_document(spark, str(tmp_path / "document")).first()
    assert (got.data.n, got.data.t, got.loss, got.nothing) == (1, 'a"b', [0.5, 0.25], None)
