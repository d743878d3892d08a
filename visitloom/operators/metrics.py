"""Rare-event evaluation of scored rows: quality of ranking, of probabilities, and of the top share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions.scalar import log_loss, ratio, squared_error
from visitloom.operators.ranking import Ranked, equal_frequency_band, ntile_band, rank_scores, top_share
from visitloom.spec import BANDS, CAPACITY, LABEL

METRICS = ("pr_auc", "roc_auc", "log_loss", "brier_score", "recall_at_top_10pct", "conversion_rate_top_10pct",
           "lift_top_10pct")


def average_precision(ranked: Ranked) -> DataFrame:
    """Mean precision at each positive. Only positives are shuffled; a group without any has no row."""
    running = Window.partitionBy(*ranked.groups, "part").orderBy("position")
    hits = ranked.rows.where("label = 1").withColumn(
        "found", F.col("positives_before") + F.row_number().over(running))
    return hits.groupBy(*ranked.groups).agg(
        (F.sum(ratio("found", ranked.index + 1)) / F.max("group_positives")).alias("pr_auc"))


def tie_runs(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal scores in ranked rows (group columns, sort_score, label, rank_index), as they lie in their files.

    For each stretch of consecutive places of one group: its first and its last run, which may go on in another stretch, with
    their score, places and positives, and the sum of positives times mean place over all runs between them.
    """
    for b in batches:
        if not b.num_rows:
            continue
        index, label = b.column(groups + 2).to_numpy(), b.column(groups + 1).to_numpy()
        known = b.column(groups).is_valid().to_numpy(zero_copy_only=False)
        score = b.column(groups).fill_null(0.0).to_numpy()
        opens = np.ones(len(index), bool)  # a stretch begins here
        opens[1:] = np.diff(index) != 1
        for i in range(groups):
            opens[1:] |= np.diff(b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy()) != 0
        equal = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
        starts = opens.copy()
        starts[1:] |= ~(equal & (known[1:] == known[:-1]))
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(index)) - 1
        positives = np.add.reduceat(label.astype(np.int64), first)
        edge = opens[first] | np.append(opens, True)[last + 1]
        stretch = np.cumsum(opens)[first] - 1
        inside = np.bincount(stretch, np.where(edge, 0, positives * (index[first] + index[last]) / 2.0))
        begins, edges = np.flatnonzero(opens), np.flatnonzero(edge)
        rows = pa.array(np.concatenate([begins, first[edges]]))
        nothing = pa.nulls(len(begins), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[b.column(i).take(rows) for i in range(groups)],
             b.column(groups).take(rows), pa.concat_arrays([nothing, pa.array(index[first[edges]])]),
             pa.concat_arrays([nothing, pa.array(index[last[edges]])]), pa.concat_arrays([nothing, pa.array(positives[edges])]),
             pa.concat_arrays([pa.array(inside), pa.nulls(len(edges), pa.float64())])],
            [*b.schema.names[:groups], "sort_score", "first", "last", "positives", "inside"])


def _positive_places(ranked: Ranked) -> DataFrame:
    """groups, places: the sum over positives of their mean place among rows of their score. No row is shuffled: what leaves a
    batch is a sum and two runs for each group in it, and only such runs meet by score."""
    keys = list(ranked.groups)
    rows = ranked.rows.select(*keys, F.col("sort_score").cast("double").alias("sort_score"), "label", "rank_index")
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("sort_score", T.DoubleType()),
                           *[T.StructField(c, T.LongType()) for c in ("first", "last", "positives")], T.StructField("inside", T.DoubleType())])
    count = len(keys)
    runs = rows.mapInArrow(lambda batches: tie_runs(batches, count), schema)
    # A run within one batch is an edge only once; a score's edges are parts of one run. Sums have no places.
    met = runs.groupBy(*keys, F.col("first").isNull().alias("is_sum"), F.when(F.col("first").isNotNull(), F.col("sort_score")).alias("score")).agg(
        F.sum("inside").alias("inside"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("positives").alias("positives"))
    place = F.coalesce("inside", F.col("positives") * (F.col("first") + F.col("last")) / F.lit(2.0))
    return met.groupBy(*keys).agg(F.sum(place).alias("places"))


def _area(places, n, n1):
    """AUC from the sum of mean places from the top: a place ``i`` is the ascending rank ``n - i``."""
    n, n1 = n.cast("double"), n1.cast("double")
    return ratio(n1 * n - places - n1 * (n1 + 1) / F.lit(2.0), n1 * (n - n1))


def _sizes(ranked: Ranked) -> list:
    return [F.max("group_rows").alias("n"), F.max("group_positives").alias("n1")]


def roc_auc(ranked: Ranked) -> DataFrame:
    """Rank-sum AUC with average ranks for ties. Needs a descending rank; null when a class is empty."""
    keys = list(ranked.groups)
    both = _positive_places(ranked).unionByName(ranked.rows.groupBy(*keys).agg(*_sizes(ranked)), allowMissingColumns=True)
    return both.groupBy(*keys).agg(_area(F.max("places"), F.max("n"), F.max("n1")).alias("roc_auc"))


def probability_quality(scored: DataFrame, groups=("model",), score: str = "predicted_probability",
                        label: str = LABEL) -> DataFrame:
    """Log loss and Brier score; needs no rank."""
    y, p = F.col(label), F.col(score)
    return scored.groupBy(*groups).agg(
        F.avg(log_loss(y, p)).alias("log_loss"), F.avg(squared_error(y, p)).alias("brier_score"))


def top_share_metrics(ranked: Ranked, capacity: float = CAPACITY) -> DataFrame:
    """Share of positives found, conversion rate and lift in the highest-scored rows."""
    top = top_share(capacity)
    found = F.sum(F.when(top, F.col("label")).otherwise(0))
    rate = ratio(found, F.count_if(top))
    positives, rows = F.max("group_positives"), F.max("group_rows")
    return ranked.rows.groupBy(*ranked.groups).agg(
        ratio(found, positives).alias("recall_at_top_10pct"),
        rate.alias("conversion_rate_top_10pct"),
        ratio(rate, ratio(positives, rows)).alias("lift_top_10pct"))


def model_metrics(scored: DataFrame, groups=("model",), capacity: float = CAPACITY) -> DataFrame:
    """The seven metrics, one row per group."""
    return metrics_of(rank_scores(scored, groups), capacity)


def metrics_of(ranked: Ranked, capacity: float = CAPACITY) -> DataFrame:
    """Three narrow reads of the ranked rows, none of which shuffles them: sums for each group, runs of equal scores, and the
    positives, for average precision.

    They meet in a grouping and not in a join, so a group whose key is null keeps its row.
    """
    keys, top, p, y = list(ranked.groups), top_share(capacity), F.col("score"), F.col("label")
    found, chosen = F.sum(F.when(top, y).otherwise(0)), F.count_if(top)
    n, n1 = F.max("group_rows"), F.max("group_positives")
    summed = ranked.rows.groupBy(*keys).agg(
        *_sizes(ranked), F.avg(log_loss(y, p)).alias("log_loss"), F.avg(squared_error(y, p)).alias("brier_score"),
        ratio(found, n1).alias("recall_at_top_10pct"), ratio(found, chosen).alias("conversion_rate_top_10pct"),
        ratio(ratio(found, chosen), ratio(n1, n)).alias("lift_top_10pct"))
    every = summed.unionByName(_positive_places(ranked), allowMissingColumns=True).unionByName(
        average_precision(ranked), allowMissingColumns=True)
    area = _area(F.max("places"), F.max("n"), F.max("n1"))
    return every.groupBy(*keys).agg(*[(area if m == "roc_auc" else F.max(m)).alias(m) for m in METRICS])


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(model, metric, value) rows."""
    return metrics.select("model", *METRICS).unpivot(["model"], list(METRICS), "metric", "value")


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max_by("model", "pr_auc").alias("selected_by_pr_auc"), F.max("pr_auc").alias("pr_auc"))


def compare_models(*scored: DataFrame) -> DataFrame:
    """Metrics of several models side by side; ``selected`` marks the highest average precision."""
    union = scored[0]
    for other in scored[1:]:
        union = union.unionByName(other)
    return mark_selected(model_metrics(union))


def mark_selected(metrics: DataFrame) -> DataFrame:
    best = F.max("pr_auc").over(Window.partitionBy())  # one row per model
    return metrics.withColumn("selected", F.col("pr_auc") == best)


def decile_table(ranked: Ranked, bands: int = BANDS) -> DataFrame:
    """Equal-frequency bands from the highest score down."""
    return _lift_table(ranked, equal_frequency_band(bands))


def lift_ntile(ranked: Ranked, bands: int = BANDS) -> DataFrame:
    """The same table with NTILE buckets."""
    return _lift_table(ranked, ntile_band(bands))


def _lift_table(ranked: Ranked, band) -> DataFrame:
    base = ratio(F.max("group_positives"), F.max("group_rows"))
    return ranked.rows.groupBy(*ranked.groups, band.alias("score_decile")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("label").alias("purchases"),
        F.avg("score").alias("avg_score"),
        F.avg("label").alias("observed_rate"),
        ratio(F.avg("label"), base).alias("lift_vs_average"))


def calibration_table(ranked: Ranked, bands: int = BANDS) -> DataFrame:
    """Equal-frequency bands from the lowest score up; needs an ascending rank."""
    return ranked.rows.groupBy(*ranked.groups, equal_frequency_band(bands).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg("score").alias("predicted_rate"),
        F.avg("label").alias("observed_rate"))


def calibration_fixed_width(scored: DataFrame, bands: int = BANDS, score: str = "predicted_probability",
                            label: str = LABEL, groups=("model",)) -> DataFrame:
    """Bands of equal width on the probability scale, for each group."""
    band = F.least(F.lit(bands - 1), F.floor(F.col(score) * bands)).cast("int")
    return scored.groupBy(*groups, band.alias("probability_band")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(score).alias("avg_predicted_rate"),
        F.avg(label).alias("observed_rate"))
