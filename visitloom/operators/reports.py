"""The eight small tables a dashboard shows; formatting and drawing are left to the client."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.scalar import ratio
from visitloom.operators.funnel import funnel, funnel_transitions
from visitloom.operators.metrics import METRICS, calibration_table, decile_table, metrics_long
from visitloom.operators.quality import split_summary
from visitloom.operators.ranking import Ranked
from visitloom.spec import (CAPACITY_CONTROL, GATE_CONTROL, LEAKAGE_CONTROL, METRIC_CONTROL, MODEL_LABELS,
                            PROHIBITED_COLUMNS, SPLIT_CONTROL, START_FEATURES)


def dashboard_kpis(sessions: DataFrame) -> DataFrame:
    count, revenue = F.count(F.lit(1)), F.sum("revenue")
    return sessions.agg(
        count.alias("sessions"), ratio(F.sum("converted"), count).alias("conversion_rate"), revenue.alias("revenue"),
        ratio(revenue, count).alias("revenue_per_session"))


def dashboard_model_kpis(metrics: DataFrame, model: str) -> DataFrame:
    return metrics.where(F.col("model") == model).select(
        "pr_auc", "roc_auc", F.col("lift_top_10pct").alias("top_decile_lift"),
        F.col("recall_at_top_10pct").alias("top_10_recall"))


def dashboard_funnel(sessions: DataFrame) -> DataFrame:
    return funnel(sessions).select("stage", "sessions")


def dashboard_funnel_transitions(sessions: DataFrame) -> DataFrame:
    return funnel_transitions(sessions)


def dashboard_model_comparison(metrics: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("model") == name, text) for name, text in MODEL_LABELS], F.col("model"))
    return metrics.select(
        label.alias("model"), F.col("pr_auc").alias("PR-AUC"), F.col("roc_auc").alias("ROC-AUC"),
    ).unpivot(["model"], ["PR-AUC", "ROC-AUC"], "metric", "value")


def dashboard_lift_deciles(descending: Ranked) -> DataFrame:
    return decile_table(descending).select(
        F.col("score_decile").cast("string").alias("decile"), F.col("lift_vs_average").alias("lift"), "sessions",
        "purchases")


def dashboard_calibration_tidy(ascending: Ranked) -> DataFrame:
    return calibration_table(ascending).select(
        F.col("risk_band").cast("string").alias("risk_band"), F.col("predicted_rate").alias("Predicted"),
        F.col("observed_rate").alias("Observed"),
    ).unpivot(["risk_band"], ["Predicted", "Observed"], "series", "rate")


def dashboard_model_controls(features: DataFrame, metrics: DataFrame, model: str, cutoff: dt.date) -> DataFrame:
    """Controls with their state, in name order. The audit passes if no feature is on the prohibited list, the split if every
    training day lies before the test days."""
    clean = not set(features.columns) & set(PROHIBITED_COLUMNS)
    sides = split_summary(features, cutoff).groupBy().agg(
        F.max(F.when(F.col("sample") == "Train", F.col("end_date"))).alias("train_end"),
        F.max(F.when(F.col("sample") == "Test", F.col("start_date"))).alias("test_start"),
        F.max(F.when(F.col("sample") == "Test", F.col("end_date"))).alias("test_end"),
        F.max(F.when(F.col("sample") == "Test", F.col("sessions"))).alias("test_sessions"),
    )
    measured = metrics.where(F.col("model") == model).select("pr_auc", "recall_at_top_10pct", "lift_top_10pct")
    both = sides.unionByName(measured, allowMissingColumns=True)  # two rows, each with the other's columns null
    facts = both.agg(*[F.max(c).alias(c) for c in both.columns])
    same_month = F.date_format("test_start", "yyyyMM") == F.date_format("test_end", "yyyyMM")
    last = F.when(same_month, F.date_format("test_end", "d")).otherwise(F.date_format("test_end", "MMM d"))

    def row(control, implementation=None, status=None):
        name, implementation_text, status_text = control
        return F.struct(
            F.lit(name).alias("control"),
            (F.lit(implementation_text) if implementation is None else implementation).alias("implementation"),
            (F.lit(status_text) if status is None else status).alias("status"))

    first, future = F.date_format("test_start", "MMM d"), F.format_number("test_sessions", 0)
    return facts.select(F.inline(F.array(
        row(SPLIT_CONTROL, F.format_string(SPLIT_CONTROL[1], F.date_format("train_end", "MMM d"), first, last),
            F.when(F.col("train_end") < F.col("test_start"), SPLIT_CONTROL[2]).otherwise("Failed")),
        row(LEAKAGE_CONTROL, status=F.lit(LEAKAGE_CONTROL[2] if clean else "Failed")),
        row(METRIC_CONTROL, F.format_string(METRIC_CONTROL[1], future), F.format_string(METRIC_CONTROL[2], "pr_auc")),
        row(CAPACITY_CONTROL, status=F.format_string(
            CAPACITY_CONTROL[2], F.col("recall_at_top_10pct") * 100, F.col("lift_top_10pct"))),
        row(GATE_CONTROL),
    ))).orderBy("control")


def payload_document(sessions_columns, features: DataFrame, metrics: DataFrame, cutoff: dt.date, used=START_FEATURES,
                     training_loss=()) -> DataFrame:
    """One row, the whole record of a training run: data, split, feature_contract, models (metrics by name), selected_by_pr_auc and
    training_loss."""
    excluded = sorted(set(sessions_columns) & set(PROHIBITED_COLUMNS))
    status = "passed" if not set(used) & set(PROHIBITED_COLUMNS) else "failed"
    of = {side: F.col("sample") == side.title() for side in ("train", "test")}

    def only(side: str, column: str):
        return F.max(F.when(of[side], F.col(column)))

    def text(value):
        return F.date_format(value, "yyyy-MM-dd")

    sides = split_summary(features, cutoff).agg(
        F.struct(F.sum("sessions").alias("rows"), *[only(s, c).alias(f"{s}_{n}") for c, n in (
            ("sessions", "rows"), ("purchases", "purchases"), ("conversion_rate", "conversion_rate")) for s in of]).alias("data"),
        F.struct(*[text(only(s, c)).alias(f"{s}_{n}") for s in of for c, n in (("start_date", "start"), ("end_date", "end"))]).alias("split"))
    models = metrics.agg(  # one row for each model
        F.map_from_entries(F.collect_list(F.struct("model", F.struct(*METRICS)))).alias("models"),
        F.max_by("model", "pr_auc").alias("selected_by_pr_auc"))
    contract = F.struct(F.lit(list(used)).alias("safe_features"), F.lit(excluded).cast("array<string>").alias(
        "prohibited_columns_present_but_excluded"), F.lit(status).alias("status"))
    both = sides.unionByName(models, allowMissingColumns=True)  # two rows, each with the other's columns null
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns]).select(
        "data", "split", contract.alias("feature_contract"), "models", "selected_by_pr_auc",
        F.lit([float(x) for x in training_loss]).cast("array<double>").alias("training_loss"))


def document_lines(document: DataFrame) -> DataFrame:
    """(section, name, number, text): a payload document, as it is read back, line by line."""
    def line(section, name, number=None, text=None):
        number = F.lit(None) if number is None else number
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), number.cast("double").alias("number"),
                        (F.lit(None) if text is None else text).cast("string").alias("text"))

    kinds = {f.name: f.dataType for f in document.schema}
    lines = [line("data", n, F.col(f"data.{n}")) for n in kinds["data"].fieldNames()]
    lines += [line("split", n, text=F.col(f"split.{n}")) for n in kinds["split"].fieldNames()]
    lines += [line("feature_contract", n, text=F.concat_ws(",", f"feature_contract.{n}")) for n in kinds["feature_contract"].fieldNames()]
    lines += [line(m, n, F.col("models")[m][n]) for m in kinds["models"].fieldNames() for n in kinds["models"][m].dataType.fieldNames()]
    lines += [line("selected_by_pr_auc", "model", text=F.col("selected_by_pr_auc")),
              line("training_loss", "iterations", F.size("training_loss"))]
    return document.select(F.inline(F.array(*lines)))


def training_payload(features: DataFrame, metrics: DataFrame, cutoff: dt.date) -> DataFrame:
    """(model, metric, value): the size of both samples under the name ``data``, then the metrics of each model."""
    sides = split_summary(features, cutoff)
    side = F.lower("sample")

    def row(name, value):
        return F.struct(F.concat(side, F.lit(name)).alias("metric"), F.col(value).cast("double").alias("value"))

    sizes = sides.select(F.inline(F.array(
        row("_rows", "sessions"), row("_purchases", "purchases"), row("_conversion_rate", "conversion_rate"))))
    total = sides.agg(F.lit("rows").alias("metric"), F.sum("sessions").cast("double").alias("value"))
    return sizes.unionByName(total).select(F.lit("data").alias("model"), "metric", "value").unionByName(
        metrics_long(metrics))
