"""Watching a model after training, and controlled experiments on its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.functions.scalar import ratio
from visitloom.operators.incremental import replace_folders
from visitloom.operators.lookups import feature_values
from visitloom.operators.metrics import metrics_of
from visitloom.operators.ranking import Ranked, equal_frequency_band, rank_scores
from visitloom.sources.workspace import materialize
from visitloom.spec import DATE, KEY, LABEL, MISSING, START_FEATURES

# Size of a quantile sketch, and by how much the rank of a quantile may then be off (99 % of the time), as a share of all rows.
SKETCH_SIZE, RANK_ERROR = 800, 0.004
# Share given to a value that one of two periods lacks, so that its logarithm exists.
DRIFT_FLOOR = 1e-6


def _value_counts(df: DataFrame, features, name: str) -> DataFrame:
    return feature_values(df, features).groupBy("column", "value").agg(F.count(F.lit(1)).alias(name))


def _periods(train: DataFrame, test: DataFrame, features) -> DataFrame:
    """(column, value, train_n, test_n): both sides are counted before they meet, so no value is hot in the join."""
    joined = _value_counts(train, features, "train_n").join(
        _value_counts(test, features, "test_n"), ["column", "value"], "full")
    return joined.fillna(0, ["train_n", "test_n"])


def daily_profile(df: DataFrame, features=START_FEATURES) -> DataFrame:
    """(session_date, column, value, n): what coverage and drift between any two periods need. Profiles of different days are
    put side by side; those of one day add up."""
    return feature_values(df, features, (DATE,)).groupBy(DATE, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def write_profile(profile: DataFrame, path: str, days: list) -> None:
    """The days' folders of the stored profile get these counts; a day that is written again is replaced."""
    replace_folders(profile, path, DATE, days)


def read_profile(spark, path: str) -> DataFrame:
    return spark.read.schema(f"column string, value string, n long, {DATE} date").parquet(path)


def profile_periods(profile: DataFrame, before: tuple, after: tuple) -> DataFrame:
    """(column, value, train_n, test_n) of two periods (first and last day, which may overlap) from a profile: only their days
    are read, and no session."""
    inside = [F.col(DATE).between(F.lit(first), F.lit(last)) for first, last in (before, after)]
    counts = [F.sum(F.when(period, F.col("n")).otherwise(0)).alias(name) for period, name in zip(inside, ("train_n", "test_n"))]
    return profile.where(inside[0] | inside[1]).groupBy("column", "value").agg(*counts)


def input_coverage(train: DataFrame, test: DataFrame, features=START_FEATURES) -> DataFrame:
    """Per feature: share of test sessions with a missing value, and with a value the training sessions never had."""
    return coverage_of(_periods(train, test, features))


def coverage_of(periods: DataFrame) -> DataFrame:
    """The same from the counts of both periods."""
    rows = F.sum("test_n")
    return periods.groupBy("column").agg(
        rows.alias("sessions"),
        ratio(F.sum(F.when(F.col("value") == MISSING, F.col("test_n")).otherwise(0)), rows).alias("missing_rate"),
        ratio(F.sum(F.when(F.col("train_n") == 0, F.col("test_n")).otherwise(0)), rows).alias("unseen_rate"))


def feature_drift(train: DataFrame, test: DataFrame, features=START_FEATURES) -> DataFrame:
    """Population stability index per feature: sum of (test share - train share) * ln(test share / train share)."""
    return drift_of(_periods(train, test, features))


def drift_of(periods: DataFrame) -> DataFrame:
    """The same from the counts of both periods."""
    totals = periods.groupBy("column").agg(F.sum("train_n").alias("train_total"), F.sum("test_n").alias("test_total"))
    before = F.greatest(ratio("train_n", "train_total"), F.lit(DRIFT_FLOOR))
    after = F.greatest(ratio("test_n", "test_total"), F.lit(DRIFT_FLOOR))
    # One row per feature column on the broadcast side.
    return periods.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.sum((after - before) * F.ln(after / before)).alias("stability_index"),
        F.count(F.lit(1)).alias("distinct_values"))


def score_distribution(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Sessions per equal-width score bin and model."""
    score_bin = F.least(F.lit(bins - 1), F.floor(F.col("predicted_probability") * bins)).cast("int")
    return scored.groupBy("model", score_bin.alias("score_bin")).agg(
        F.count(F.lit(1)).alias("sessions"), F.min("predicted_probability").alias("lowest"),
        F.max("predicted_probability").alias("highest"))


def score_sketches(scored: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(model, session_date, sketch): a quantile sketch of the scores of each model and day, of some KB however many sessions."""
    return scored.groupBy("model", DATE).agg(F.kll_sketch_agg_double("predicted_probability", F.lit(size)).alias("sketch"))


def score_quantiles(sketches: DataFrame, period: tuple, probabilities=(0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """(model, sessions, probability, score) of any period (first and last day), merged from the days' sketches alone."""
    merged = sketches.where(F.col(DATE).between(F.lit(period[0]), F.lit(period[1]))).groupBy("model").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"))
    listed = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double(
        "sketch", F.lit(float(p))).alias("score")) for p in probabilities])
    return merged.select("model", F.kll_sketch_get_n_double("sketch").alias("sessions"), F.inline(listed))


def segment_metrics(scored: DataFrame, segment: str) -> DataFrame:
    """The seven metrics within each value of a segment column."""
    return metrics_of(rank_scores(scored, ("model", segment)))


def assign_arms(ranked: Ranked, arms: int = 2, seed: str = "experiment") -> DataFrame:
    """Score band and random arm per group (model) and session. The arm depends on seed and session id only, so it can be repeated."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(KEY))), 1, 8), 16, 10).cast("long")
    return ranked.rows.select(
        *ranked.groups, KEY, equal_frequency_band().alias("score_band"), (digest % arms).cast("int").alias("arm"))


def experiment_outcomes(assigned: DataFrame, sessions: DataFrame) -> DataFrame:
    """Conversion and revenue per eligible session by group, band and arm, with the difference to arm 0 of the band."""
    groups = [c for c in assigned.columns if c not in {KEY, "score_band", "arm"}]
    band = Window.partitionBy(*groups, "score_band")  # one row for each arm
    outcomes = assigned.join(sessions.select(KEY, "converted", "revenue"), KEY).groupBy(*groups, "score_band", "arm").agg(
        F.count(F.lit(1)).alias("eligible_sessions"),
        F.avg("converted").alias("conversion_rate"),
        F.avg("revenue").alias("revenue_per_session"),
        F.stddev_samp("revenue").alias("revenue_stddev"))
    control = {c: F.max(F.when(F.col("arm") == 0, F.col(c))).over(band) for c in ("conversion_rate", "revenue_per_session")}
    return outcomes.select(
        *groups, "score_band", "arm", "eligible_sessions", "conversion_rate", "revenue_per_session", "revenue_stddev",
        (F.col("conversion_rate") - control["conversion_rate"]).alias("conversion_difference"),
        (F.col("revenue_per_session") - control["revenue_per_session"]).alias("revenue_difference"))


def assign_users(sessions: DataFrame, arms: int = 2, seed: str = "experiment", user: str = "user_pseudo_id") -> DataFrame:
    """``sessions`` with the arm of their user, from seed and user id alone: all sessions of a user are in one arm. Sessions without
    a user are in one arm together."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(user), F.lit("")))), 1, 8), 16, 10).cast("long")
    return sessions.withColumn("arm", (digest % arms).cast("int"))


def clustered_difference(sessions: DataFrame, measures=(LABEL, "revenue"), stratum: str = "score_band", user: str = "user_pseudo_id") -> DataFrame:
    """(metric, sessions, users, difference, standard_error): arm 1 against arm 0, averaged over strata by their sessions.

    Sessions of one user go together, so the variance is that of sums for each user: of its sessions' distances from the mean
    of their stratum and arm, weighted as they enter the difference. Strata that lack an arm are left out. Users are summed
    before they meet the means, of which there is one row for each stratum and arm.
    """
    one = F.col("arm") == 1
    of_user = sessions.where(F.col("arm").isin(0, 1)).select(
        F.coalesce(F.col(user).cast("string"), F.lit("")).alias("user"), stratum, "arm", *measures,
    ).unpivot(["user", stratum, "arm"], list(measures), "metric", "y").where("y IS NOT NULL").groupBy("user", stratum, "arm", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    of_user = materialize(of_user, "user-sums")
    cells = of_user.groupBy("metric", stratum).agg(
        *[F.sum(F.when(F.col("arm") == a, F.col(c)).otherwise(0)).alias(f"{c}_{a}") for a in (0, 1) for c in ("n", "total")]).where(
        "n_0 > 0 AND n_1 > 0")
    share = (F.col("n_0") + F.col("n_1")) / F.sum(F.col("n_0") + F.col("n_1")).over(Window.partitionBy("metric"))  # a row for each stratum
    means = cells.select("metric", stratum, "n_0", "n_1", (F.col("total_0") / F.col("n_0")).alias("mean_0"),
                         (F.col("total_1") / F.col("n_1")).alias("mean_1"), share.alias("share"))
    mean, size = F.when(one, F.col("mean_1")).otherwise(F.col("mean_0")), F.when(one, F.col("n_1")).otherwise(F.col("n_0"))
    part = F.when(one, 1.0).otherwise(-1.0) * F.col("share") * (F.col("total") - F.col("n") * mean) / size
    users = of_user.join(means, ["metric", stratum]).groupBy("metric", "user").agg(F.sum(part).alias("u"), F.sum("n").alias("n"))
    count = F.count(F.lit(1))
    spread = users.groupBy("metric").agg(F.sum("n").alias("sessions"), count.alias("users"), F.sqrt(
        ratio(count, count - 1) * F.sum(F.col("u") * F.col("u"))).alias("standard_error"))
    shift = means.groupBy("metric").agg(F.sum(F.col("share") * (F.col("mean_1") - F.col("mean_0"))).alias("difference"))
    return spread.join(shift, "metric").select("metric", "sessions", "users", "difference", "standard_error")
