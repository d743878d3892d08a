"""Registered queries: each reads the given tables in full and returns one DataFrame.

Doubles are rounded at the end, because sums of doubles depend on the order of addition.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.operators import early, early_models, features, funnel, incremental, logistic, metrics, monitoring, naive_bayes
from visitloom.operators import quality, ranking, reports, resampling, sessions
from visitloom.operators.attributions import added_column
from visitloom.operators.target_encoding import rate_column
from visitloom.sources import event_store, events, tables
from visitloom.sources.star_tables import nested_events
from visitloom.sources.workspace import materialize, new_path
from visitloom.spec import (ATTRIBUTES, DATE, DEFAULT_SPEC, EARLY_LEAKAGE_WORDS, KEY, LABEL, LOGISTIC_L2, NAIVE_BAYES, START_FEATURES,
                            START_LEAKAGE_WORDS)

SPEC = dataclasses.replace(DEFAULT_SPEC, cutoff=dt.date(2024, 1, 22))
SCAN_DAYS = ("20240108", "20240121")
WIDE_WINDOW_SECONDS = 14_400
DIGITS = 6
# Name, then first and last day of two periods; the second pair overlaps.
PERIODS = (("split", (dt.date(2024, 1, 1), dt.date(2024, 1, 21)), (dt.date(2024, 1, 22), dt.date(2024, 1, 31))),
           ("weeks", (dt.date(2024, 1, 1), dt.date(2024, 1, 10)), (dt.date(2024, 1, 8), dt.date(2024, 1, 14))),
           ("days", (dt.date(2024, 1, 29), dt.date(2024, 1, 29)), (dt.date(2024, 1, 2), dt.date(2024, 1, 2))))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    # Adding 0.0 turns a negative zero into zero.
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema])


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.flatten_events(nested_events(spark, sf_dir), SPEC)


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(flat_events(spark, sf_dir), SPEC)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-start features as a written table: training and scoring both read it, the events are read once."""
    table = materialize(features.start_features(session_rows(spark, sf_dir)), "start-features")
    quality.require_contract(table)
    return table


def nb_scored(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    table = feature_rows(spark, sf_dir) if table is None else table
    train, test = quality.chrono_split(table, SPEC.cutoff)
    return naive_bayes.score_naive_bayes(naive_bayes.fit_naive_bayes(train), test)


def hashed_model(spark: SparkSession, sf_dir: str, table: DataFrame | None = None):
    """The fitted hashed logistic model and the encoded test rows."""
    table = feature_rows(spark, sf_dir) if table is None else table
    encoded = materialize(features.hash_encode(table), "encoded")  # looked up once, read by the split, the fit and the scores
    train, test = quality.chrono_split(encoded, SPEC.cutoff)
    return logistic.fit_hashed_logistic(train), test


def logistic_scored(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    return logistic.score_hashed_logistic(*hashed_model(spark, sf_dir, table))


def ranked(scored: DataFrame, groups=("model",), descending: bool = True) -> ranking.Ranked:
    """Ranked by the score in nine digits: another engine adds the terms of a score in another order."""
    return ranking.rank_scores(scored.withColumn("rank_key", F.round("predicted_probability", 9)), groups,
                               descending=descending, rank_by="rank_key")


def nb_ranked(spark: SparkSession, sf_dir: str, descending: bool = True) -> ranking.Ranked:
    return ranked(nb_scored(spark, sf_dir), descending=descending)


def nb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_of(nb_ranked(spark, sf_dir))


def both_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_rows(spark, sf_dir)
    columns = ["model", KEY, DATE, LABEL, "predicted_probability"]
    both = logistic_scored(spark, sf_dir, table).select(*columns).unionByName(
        nb_scored(spark, sf_dir, table).select(*columns))
    return metrics.mark_selected(metrics.metrics_of(ranked(both)))


def two_nb_models(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    """Scores of two Naive Bayes models that differ in their smoothing; SQL can compute them exactly."""
    train, test = quality.chrono_split(feature_rows(spark, sf_dir) if table is None else table, SPEC.cutoff)
    scored = [naive_bayes.score_naive_bayes(naive_bayes.fit_naive_bayes(train, alpha=alpha), test).select(
        F.lit(f"alpha_{alpha:g}").alias("model"), KEY, DATE, LABEL, "predicted_probability") for alpha in (10.0, 1.0)]
    return scored[0].unionByName(scored[1])


def two_nb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mark_selected(metrics.metrics_of(ranked(two_nb_models(spark, sf_dir))))


def early_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early.early_features(flat_events(spark, sf_dir), SPEC, WIDE_WINDOW_SECONDS)


def early_split(spark: SparkSession, sf_dir: str):
    table = materialize(early_table(spark, sf_dir), "early-features")
    if late := quality.columns_matching(table.columns, EARLY_LEAKAGE_WORDS, LABEL):
        raise ValueError(f"columns known only after the early window: {late}")
    return quality.chrono_split(table, SPEC.cutoff)


# --- sources and sinks ------------------------------------------------------------------------------------------------

def scan_event_days(spark, sf_dir):
    """Events stored by day, then only two weeks of folders read back and counted."""
    root = new_path(spark, "events")
    events.write_events(nested_events(spark, sf_dir), root)
    chosen = events.flatten_events(events.scan_events(spark, root, *SCAN_DAYS), SPEC)
    return chosen.groupBy("event_date", "event_name").agg(F.count(F.lit(1)).alias("events"))


def session_table_by_date(spark, sf_dir):
    path = new_path(spark, "sessions")
    tables.write_sessions(session_rows(spark, sf_dir), path)
    stored = tables.read_sessions(spark, path).where(F.col(DATE) >= F.lit(SPEC.cutoff))
    return rounded(stored.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(LABEL).alias("purchases"), F.sum("revenue").alias("revenue")), 4)


def session_csv(spark, sf_dir):
    path = new_path(spark, "sessions-csv")
    tables.write_session_csv(session_rows(spark, sf_dir), path, "gzip")
    return rounded(tables.query_csv(spark, path), 4)


def scores_export(spark, sf_dir):
    path = new_path(spark, "scores-csv")
    tables.write_scores(nb_scored(spark, sf_dir), path)
    return rounded(spark.read.option("header", True).schema(
        "session_id string, session_date string, converted int, predicted_probability double").csv(path))


def metrics_payload(spark, sf_dir):
    path = new_path(spark, "metrics-json")
    table = feature_rows(spark, sf_dir)
    measured = metrics.metrics_of(ranked(nb_scored(spark, sf_dir, table)))
    tables.write_metrics(reports.training_payload(table, measured, SPEC.cutoff), path)
    return rounded(tables.read_metrics(spark, path))


def payload_document(spark, sf_dir):
    """The whole record of a run with two models, written as one JSON document, read back and listed."""
    path, table = new_path(spark, "payload"), feature_rows(spark, sf_dir)
    measured = materialize(metrics.metrics_of(ranked(two_nb_models(spark, sf_dir, table))), "metrics")
    columns = tables.SESSION_SCHEMA.fieldNames()
    tables.write_document(reports.payload_document(columns, table, measured, SPEC.cutoff), path)
    return rounded(reports.document_lines(tables.read_document(spark, path)))


def column_catalog(spark, sf_dir):
    """Columns of the session table with the number of sessions that carry each."""
    rows = session_rows(spark, sf_dir)
    return quality.populated_columns(rows, rows.columns)


def first_sessions(spark, sf_dir):
    return rounded(tables.peek(session_rows(spark, sf_dir), KEY))


# --- sessions, totals, funnel -----------------------------------------------------------------------------------------

def sessionize(spark, sf_dir):
    return rounded(session_rows(spark, sf_dir))


def core_totals(spark, sf_dir):
    return rounded(sessions.core_totals(session_rows(spark, sf_dir)))


def kpis(spark, sf_dir):
    return rounded(sessions.kpis(session_rows(spark, sf_dir)))


def funnel_wide(spark, sf_dir):
    return funnel.funnel_wide(session_rows(spark, sf_dir), SPEC)


def funnel_stages(spark, sf_dir):
    return rounded(funnel.funnel(session_rows(spark, sf_dir), SPEC))


def funnel_transitions(spark, sf_dir):
    return funnel.funnel_transitions(session_rows(spark, sf_dir), SPEC)


# --- checks -----------------------------------------------------------------------------------------------------------

def quality_report(spark, sf_dir):
    return quality.quality_report(session_rows(spark, sf_dir))


def leakage_audit_regex(spark, sf_dir):
    """Session columns that the start-of-session word policy forbids."""
    return quality.leakage_audit_regex(session_rows(spark, sf_dir), START_LEAKAGE_WORDS, LABEL)


def leakage_audit_early(spark, sf_dir):
    """Every column of the early-window table under its word policy, which forbids none of them."""
    return quality.column_policy(early_table(spark, sf_dir), EARLY_LEAKAGE_WORDS)


def leakage_audit_tokens(spark, sf_dir):
    return quality.leakage_audit_tokens(session_rows(spark, sf_dir), START_FEATURES, START_LEAKAGE_WORDS)


def leakage_audit_columns(spark, sf_dir):
    return quality.leakage_audit_columns(session_rows(spark, sf_dir))


def uniqueness_audit(spark, sf_dir):
    return quality.uniqueness_audit(features.start_features(session_rows(spark, sf_dir)))


def split_summary(spark, sf_dir):
    return rounded(quality.split_summary(session_rows(spark, sf_dir), SPEC.cutoff))


def reconcile(spark, sf_dir):
    """Funnel counts of the session table against counts taken straight from the events."""
    flat = flat_events(spark, sf_dir)
    actual = funnel.funnel(sessions.sessionize(flat, SPEC), SPEC).select("stage", F.col("sessions").alias("value"))
    flag_event = dict(SPEC.flags)
    by_event = flat.select(*sessions.SESSION_KEY, "event_name").distinct().groupBy("event_name").agg(
        F.count(F.lit(1)).alias("value"))
    stage_of = [F.when(F.col("event_name") == flag_event[flag], stage) for stage, flag, _ in SPEC.stages if flag]
    expected = by_event.select(F.coalesce(*stage_of).alias("stage"), "value").where("stage IS NOT NULL").unionByName(
        flat.select(*sessions.SESSION_KEY).distinct().agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(SPEC.stages[0][0]).alias("stage"), "value"))
    return quality.reconcile(actual, expected, "stage", relative=0.0)


# --- features and models ----------------------------------------------------------------------------------------------

def start_features(spark, sf_dir):
    return features.start_features(session_rows(spark, sf_dir))


def hash_encode(spark, sf_dir):
    return features.hash_encode(feature_rows(spark, sf_dir)).select(
        KEY, *[features.bucket_column(f) for f in START_FEATURES])


def nb_params(spark, sf_dir):
    train, _ = quality.chrono_split(feature_rows(spark, sf_dir), SPEC.cutoff)
    return rounded(naive_bayes.fit_naive_bayes(train).params(), 9)


def nb_defaults(spark, sf_dir):
    train, _ = quality.chrono_split(feature_rows(spark, sf_dir), SPEC.cutoff)
    return rounded(naive_bayes.fit_naive_bayes(train).defaults(), 9)


def nb_scores(spark, sf_dir):
    return rounded(nb_scored(spark, sf_dir).select(KEY, DATE, LABEL, "predicted_probability"))


def logistic_scores(spark, sf_dir):
    return rounded(logistic_scored(spark, sf_dir).select(KEY, DATE, LABEL, "predicted_probability"), 5)


def logistic_metrics(spark, sf_dir):
    return rounded(metrics.metrics_of(ranked(logistic_scored(spark, sf_dir))), 5)


def logistic_history(spark, sf_dir):
    return hashed_model(spark, sf_dir)[0].training_loss()


def logistic_history_check(spark, sf_dir):
    """Whether the objective never rose while training, and whether its last value is that of the saved model on the raw rows."""
    encoded = materialize(features.hash_encode(feature_rows(spark, sf_dir)), "encoded")
    train, _ = quality.chrono_split(encoded, SPEC.cutoff)
    path = new_path(spark, "logistic")
    logistic.fit_hashed_logistic(train).save(path)
    model = logistic.load_hashed_logistic(spark, path, START_FEATURES)
    loss = metrics.probability_quality(logistic.score_hashed_logistic(model, train)).select("log_loss")
    penalty = LOGISTIC_L2 / 2 * sum(w * w for w in model.weights)
    falls = all(after <= before for before, after in zip(model.history, model.history[1:]))
    return loss.select(F.lit(falls and len(model.history) > 1).alias("falls"), F.lit(model.converged).alias("converged"),
                       (F.abs(F.col("log_loss") + penalty - model.history[-1]) < 1e-6).alias("ends_at_the_objective"))


def compare_models(spark, sf_dir):
    return rounded(both_metrics(spark, sf_dir), 5)


def selected_model(spark, sf_dir):
    return rounded(metrics.best_model(both_metrics(spark, sf_dir)), 5)


# --- evaluation of the Naive Bayes scores -----------------------------------------------------------------------------

def average_precision_nb(spark, sf_dir):
    return rounded(metrics.average_precision(nb_ranked(spark, sf_dir)), 8)


def roc_auc_nb(spark, sf_dir):
    return rounded(metrics.roc_auc(nb_ranked(spark, sf_dir)), 8)


def log_loss_brier_nb(spark, sf_dir):
    return rounded(metrics.probability_quality(nb_scored(spark, sf_dir)), 8)


def topk_nb(spark, sf_dir):
    return rounded(metrics.top_share_metrics(nb_ranked(spark, sf_dir)), 8)


def model_metrics_nb(spark, sf_dir):
    return rounded(nb_metrics(spark, sf_dir))


def decile_lift_nb(spark, sf_dir):
    return rounded(metrics.decile_table(nb_ranked(spark, sf_dir)).drop("model"))


def calibration_nb(spark, sf_dir):
    return rounded(metrics.calibration_table(nb_ranked(spark, sf_dir, descending=False)).drop("model"))


def lift_ntile_nb(spark, sf_dir):
    return rounded(metrics.lift_ntile(nb_ranked(spark, sf_dir)).drop("model"))


def calibration_fixed_width_nb(spark, sf_dir):
    return rounded(metrics.calibration_fixed_width(nb_scored(spark, sf_dir)).drop("model"))


# --- early behaviour --------------------------------------------------------------------------------------------------

def early_features(spark, sf_dir):
    return rounded(early.early_features(flat_events(spark, sf_dir), SPEC), 4)


def early_features_wide(spark, sf_dir):
    return rounded(early.early_features(flat_events(spark, sf_dir), SPEC, WIDE_WINDOW_SECONDS), 4)


def early_features_stored(spark, sf_dir):
    """Early features of a log stored by session, in which sessions of more than 500 events are spread."""
    path = new_path(spark, "event-store")
    event_store.write_event_store(flat_events(spark, sf_dir), path, hot=500)
    stored = event_store.open_event_store(spark, path).read(spark)
    return rounded(early.early_features_stored(stored, SPEC, WIDE_WINDOW_SECONDS), 4)


def label_after_horizon(spark, sf_dir):
    return early.label_after_horizon(flat_events(spark, sf_dir), SPEC)


def early_logistic_eval(spark, sf_dir):
    train, test = early_split(spark, sf_dir)
    return early_models.evaluate(early_models.score_early(early_models.fit_early_logistic(train), test))


def early_model_eval(spark, sf_dir):
    """Both early models evaluated on the later sessions."""
    train, test = early_split(spark, sf_dir)
    scored = [early_models.score_early(fit(train), test)
              for fit in (early_models.fit_early_logistic, early_models.fit_early_trees)]
    return early_models.evaluate(scored[0].unionByName(scored[1]))


def early_gbt_scores(spark, sf_dir):
    train, test = early_split(spark, sf_dir)
    return early_models.score_early(early_models.fit_early_trees(train), test).drop("model")


def early_gbt_lift(spark, sf_dir):
    train, test = early_split(spark, sf_dir)
    scored = early_models.score_early(early_models.fit_early_trees(train), test)
    return metrics.lift_ntile(ranked(scored)).drop("model")


def early_gbt_explain(spark, sf_dir):
    """What moves the scores of the later sessions."""
    train, test = early_split(spark, sf_dir)
    return rounded(early_models.global_explain(early_models.fit_early_trees(train), test))


def early_logistic_explain(spark, sf_dir):
    train, test = early_split(spark, sf_dir)
    return rounded(early_models.global_explain(early_models.fit_early_logistic(train), test))


def early_attribution_check(spark, sf_dir):
    """Per model and later session: whether base and attributions add up to the margin, and the margin to the model's score."""
    train, test = early_split(spark, sf_dir)
    parts = []
    for fit, odds in ((early_models.fit_early_logistic, 1.0), (early_models.fit_early_trees, 2.0)):
        model = fit(train)
        rows, scored = early_models.explain_rows(model, test), early_models.score_early(model, test)
        total = sum((F.col(added_column(c)) for c in model.columns), F.col("base"))
        fits = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds * F.col("margin"))) - F.col("predicted_probability")) < 1e-9
        parts.append(rows.join(scored.select(KEY, "predicted_probability"), KEY).select(
            "model", KEY, (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"), fits.alias("is_the_score")))
    return parts[0].unionByName(parts[1])


def early_target_rates(spark, sf_dir):
    """The rates that training rows get, each without its own fold, and those that later sessions get."""
    train, test = early_split(spark, sf_dir)
    encoding, encoded = early_models.encode_training(train)
    columns = [rate_column(a) for a in ATTRIBUTES]
    return rounded(encoded.select(KEY, F.lit("train").alias("sample"), *columns).unionByName(
        encoding.encode(test).select(KEY, F.lit("test").alias("sample"), *columns)), 9)


# --- dashboard tables -------------------------------------------------------------------------------------------------

def dashboard_kpis(spark, sf_dir):
    return rounded(reports.dashboard_kpis(session_rows(spark, sf_dir)))


def dashboard_funnel(spark, sf_dir):
    return reports.dashboard_funnel(session_rows(spark, sf_dir))


def dashboard_model_kpis(spark, sf_dir):
    return rounded(reports.dashboard_model_kpis(nb_metrics(spark, sf_dir), NAIVE_BAYES))


def dashboard_model_comparison(spark, sf_dir):
    return rounded(reports.dashboard_model_comparison(both_metrics(spark, sf_dir)), 5)


def dashboard_lift_deciles(spark, sf_dir):
    return rounded(reports.dashboard_lift_deciles(nb_ranked(spark, sf_dir)))


def dashboard_calibration_tidy(spark, sf_dir):
    return rounded(reports.dashboard_calibration_tidy(nb_ranked(spark, sf_dir, descending=False)))


def dashboard_model_controls(spark, sf_dir):
    table = feature_rows(spark, sf_dir)
    scored = metrics.metrics_of(ranked(nb_scored(spark, sf_dir, table)))
    return reports.dashboard_model_controls(table, scored, NAIVE_BAYES, SPEC.cutoff)


# --- monitoring and experiments ---------------------------------------------------------------------------------------

def input_coverage(spark, sf_dir):
    return rounded(monitoring.input_coverage(*quality.chrono_split(feature_rows(spark, sf_dir), SPEC.cutoff)))


def feature_drift(spark, sf_dir):
    return rounded(monitoring.feature_drift(*quality.chrono_split(feature_rows(spark, sf_dir), SPEC.cutoff)))


def score_distribution(spark, sf_dir):
    return rounded(monitoring.score_distribution(nb_scored(spark, sf_dir)))


def segment_metrics(spark, sf_dir):
    return rounded(metrics.metrics_of(ranked(nb_scored(spark, sf_dir), ("model", "device_category"))))


def experiment_assignment(spark, sf_dir):
    return monitoring.assign_arms(nb_ranked(spark, sf_dir)).drop("model")


def experiment_outcomes(spark, sf_dir):
    stored = materialize(session_rows(spark, sf_dir).select(KEY, DATE, LABEL, *START_FEATURES, "revenue"), "sessions")
    scored = nb_scored(spark, sf_dir, stored.drop("revenue"))
    return rounded(monitoring.experiment_outcomes(monitoring.assign_arms(ranked(scored)), stored).drop("model"), 5)


def period_drift(spark, sf_dir):
    """Coverage and drift between three pairs of periods, all from one stored profile."""
    table = feature_rows(spark, sf_dir)
    path, days = new_path(spark, "profile"), [r[0] for r in table.select(DATE).distinct().collect()]
    half = len(days) // 2
    for some in (sorted(days)[:half], sorted(days)[half:], sorted(days)[:3]):  # the last ones again, which changes nothing
        monitoring.write_profile(monitoring.daily_profile(table.where(F.col(DATE).isin(*some))), path, some)
    parts = []
    for name, before, after in PERIODS:
        periods = materialize(monitoring.profile_periods(monitoring.read_profile(spark, path), before, after), "periods")
        both = monitoring.coverage_of(periods).join(monitoring.drift_of(periods), "column")
        parts.append(both.select(F.lit(name).alias("periods"), "*"))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def sessions_by_days(spark, sf_dir):
    """The session table built from stored days in four updates, of which the last repeats days that it has."""
    root, store = new_path(spark, "events"), incremental.SessionStore(spark, new_path(spark, "session-store"), SPEC)
    events.write_events(nested_events(spark, sf_dir), root)
    days = sorted(r[0] for r in events.scan_events(spark, root).select("event_date").distinct().collect())
    third = -(-len(days) // 3)
    for some in (days[:third], days[2 * third:], days[third: 2 * third], days[third - 2: third + 2]):
        store.update(events.flatten_events(events.scan_events(spark, root, some[0], some[-1]), SPEC), some)
    return rounded(store.read())


def score_quantiles(spark, sf_dir):
    """Quantiles of the scores in three periods, merged from one sketch for each day, and whether their rank is as exact as stated."""
    scored = materialize(nb_scored(spark, sf_dir).select("model", KEY, DATE, "predicted_probability"), "scored")
    sketches = materialize(monitoring.score_sketches(scored), "sketches")
    parts = []
    for name, (first, last) in (("all", ("2024-01-22", "2024-01-31")), ("days", ("2024-01-23", "2024-01-25")), ("day", ("2024-01-30", "2024-01-30"))):
        period = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
        found = monitoring.score_quantiles(sketches, period)
        inside = scored.where(F.col(DATE).between(*map(F.lit, period)))
        ranks = inside.join(F.broadcast(found), "model").groupBy("model", "sessions", "probability").agg(  # seven rows for a model
            F.avg((F.col("predicted_probability") < F.col("score")).cast("int")).alias("below"),
            F.avg((F.col("predicted_probability") <= F.col("score")).cast("int")).alias("up_to"))
        # One row of the period may lie to either side.
        room = monitoring.RANK_ERROR + 1 / F.col("sessions")
        parts.append(ranks.select("model", F.lit(name).alias("period"), "sessions", "probability", (
            (F.col("below") <= F.col("probability") + room) & (F.col("up_to") >= F.col("probability") - room)).alias("within_bound")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def experiment_by_user(spark, sf_dir):
    """Arms drawn by user within score bands; differences with standard errors that count users and not sessions."""
    stored = materialize(session_rows(spark, sf_dir).select(KEY, "user_pseudo_id", DATE, LABEL, *START_FEATURES, "revenue"), "sessions")
    bands = ranked(nb_scored(spark, sf_dir, stored.drop("revenue", "user_pseudo_id"))).rows.select(
        KEY, ranking.equal_frequency_band().alias("score_band"))
    assigned = monitoring.assign_users(stored.join(bands, KEY))
    return rounded(monitoring.clustered_difference(assigned))


def table_difference(spark, sf_dir):
    """Sessions against a copy in which some labels are turned and some rows are there twice."""
    rows = materialize(session_rows(spark, sf_dir).select(KEY, DATE, LABEL), "sessions")
    sign = F.substring(F.md5(F.col(KEY)), 1, 2)
    other = rows.withColumn(LABEL, F.when(sign == "ff", 1 - F.col(LABEL)).otherwise(F.col(LABEL))).union(rows.where(sign == "00"))
    return quality.difference(rows, materialize(other, "sessions-changed"))


def segment_metrics_nulls(spark, sf_dir):
    """Segments of which one is null."""
    scored = nb_scored(spark, sf_dir).withColumn("segment", F.expr("nullif(device_category, 'mobile')"))
    return rounded(metrics.metrics_of(ranked(scored, ("model", "segment"))))


# --- models that SQL can compute exactly, and models read back --------------------------------------------------------

def nb_comparison(spark, sf_dir):
    return rounded(two_nb_metrics(spark, sf_dir))


def nb_selected(spark, sf_dir):
    return rounded(metrics.best_model(two_nb_metrics(spark, sf_dir)))


def nb_selection_certainty(spark, sf_dir):
    """How certain it is that the selected model has the higher average precision, over 200 paired resamples of sessions."""
    return rounded(resampling.selection_certainty(ranked(two_nb_models(spark, sf_dir))))


def nb_resampled_precision(spark, sf_dir):
    return rounded(resampling.resampled_precision(ranked(two_nb_models(spark, sf_dir))))


def nb_dashboard_comparison(spark, sf_dir):
    return rounded(reports.dashboard_model_comparison(two_nb_metrics(spark, sf_dir)))


def nb_evaluation(spark, sf_dir):
    """Precision, recall, accuracy, F1, log loss and AUC of two models at a threshold near the base rate."""
    scored = two_nb_models(spark, sf_dir).withColumn("predicted_probability", F.round("predicted_probability", 9))
    return rounded(early_models.evaluate(scored, 0.12))


def class_weights(spark, sf_dir):
    train, _ = early_split(spark, sf_dir)
    weighted, _ = early_models.with_class_weights(train)
    return rounded(weighted.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("sessions"), F.max(early_models.WEIGHT).alias("class_weight")))


def nb_reloaded_scores(spark, sf_dir):
    """Scores of a model that was saved and read back."""
    train, test = quality.chrono_split(feature_rows(spark, sf_dir), SPEC.cutoff)
    path = new_path(spark, "naive-bayes")
    naive_bayes.fit_naive_bayes(train).save(path)
    scored = naive_bayes.score_naive_bayes(naive_bayes.load_naive_bayes(spark, path), test)
    return rounded(scored.select(KEY, DATE, LABEL, "predicted_probability"))


def logistic_certificate(spark, sf_dir):
    """Per bucket: how often training sessions fall into it, and whether the saved and reloaded model is at the optimum there
    (the objective's derivative by this weight, taken from the raw rows, is below 1e-6)."""
    encoded = materialize(features.hash_encode(feature_rows(spark, sf_dir)), "encoded")
    train, _ = quality.chrono_split(encoded, SPEC.cutoff)
    path = new_path(spark, "logistic")
    logistic.fit_hashed_logistic(train).save(path)
    model = logistic.load_hashed_logistic(spark, path)
    columns = [features.bucket_column(f) for f in START_FEATURES]
    scored = logistic.score_hashed_logistic(model, train).select(KEY, "predicted_probability").join(train, KEY)
    total = train.count()
    hits = scored.select(F.explode(F.array(*columns)).alias("bucket"),
                         (F.col("predicted_probability") - F.col(LABEL)).alias("error"))
    slope = F.sum("error") / total + LOGISTIC_L2 * F.max("weight")
    return hits.join(model.weight_table(), "bucket").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("hits"), (F.abs(slope) < 1e-6).alias("optimal"))


def lift_csv(spark, sf_dir):
    path = new_path(spark, "lift-csv")
    tables.write_small_csv(rounded(metrics.decile_table(nb_ranked(spark, sf_dir)).drop("model")), "score_decile", path)
    return spark.read.option("header", True).schema(
        "score_decile int, sessions long, purchases long, avg_score double, observed_rate double, lift_vs_average double").csv(path)


def session_catalog(spark, sf_dir):
    """Column names and types of the stored session table, from the catalog."""
    database = "visitloom_sessions"
    table = f"sessions_{spark.sparkContext.applicationId.replace('-', '_').lower()}"
    tables.save_as_table(session_rows(spark, sf_dir), database, table)
    return tables.column_catalog(spark, f"{database}.{table}")


QUERIES = {
    "funnel": funnel_stages,
    **{f.__name__: f for f in (
        sessionize, core_totals, kpis, funnel_wide, funnel_transitions,
        scan_event_days, session_table_by_date, session_csv, scores_export, metrics_payload, column_catalog,
        first_sessions,
        quality_report, leakage_audit_regex, leakage_audit_early, leakage_audit_tokens, leakage_audit_columns,
        uniqueness_audit, split_summary, reconcile,
        start_features, hash_encode, nb_params, nb_defaults, nb_scores, logistic_scores, logistic_metrics,
        logistic_history, logistic_history_check, payload_document, compare_models, selected_model,
        average_precision_nb, roc_auc_nb, log_loss_brier_nb, topk_nb, model_metrics_nb, decile_lift_nb, calibration_nb,
        lift_ntile_nb, calibration_fixed_width_nb,
        early_features, early_features_wide, early_features_stored, label_after_horizon, early_logistic_eval, early_model_eval,
        early_gbt_scores, early_gbt_lift, early_gbt_explain, early_logistic_explain, early_attribution_check,
        early_target_rates,
        dashboard_kpis, dashboard_funnel, dashboard_model_kpis, dashboard_model_comparison, dashboard_lift_deciles,
        dashboard_calibration_tidy, dashboard_model_controls,
        input_coverage, feature_drift, score_distribution, segment_metrics, experiment_assignment, experiment_outcomes,
        segment_metrics_nulls, score_quantiles, experiment_by_user, table_difference, period_drift, sessions_by_days, nb_comparison, nb_selected, nb_selection_certainty,
        nb_resampled_precision, nb_dashboard_comparison, nb_evaluation, class_weights,
        nb_reloaded_scores, logistic_certificate, lift_csv, session_catalog,
    )},
}
