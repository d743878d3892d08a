"""Quantile sketches, experiments by user, and comparison of tables, against plain NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators import monitoring, quality

DAYS = [dt.date(2024, 1, 1 + i) for i in range(5)]


def test_quantiles_of_merged_days_are_within_the_stated_rank(spark):
    rng = np.random.default_rng(3)
    p = np.where(rng.random(60_000) < 0.3, 0.25, rng.beta(1, 20, 60_000))  # one score is shared by a third
    day = rng.integers(0, 5, len(p))
    scored = spark.createDataFrame([("m", DAYS[d], float(x)) for d, x in zip(day, p)],
                                   "model string, session_date date, predicted_probability double")
    sketches = monitoring.score_sketches(scored)
    assert sketches.count() == 5
    for stored in (sketches, sketches.orderBy(F.desc("session_date"))):  # in whatever order they are merged
        for first, last in ((0, 4), (1, 3), (2, 2)):
            inside = p[(day >= first) & (day <= last)]
            for r in monitoring.score_quantiles(stored, (DAYS[first], DAYS[last])).collect():
                assert r.sessions == len(inside)
                below, up_to = np.mean(inside < r.score), np.mean(inside <= r.score)
                assert below - monitoring.RANK_ERROR <= r.probability <= up_to + monitoring.RANK_ERROR
    assert monitoring.score_quantiles(sketches, (DAYS[4] + dt.timedelta(1), DAYS[4] + dt.timedelta(2))).count() == 0


def plain_difference(user, band, arm, y):
    bands = [b for b in np.unique(band) if len(np.unique(arm[band == b])) == 2]
    n = sum((band == b).sum() for b in bands)
    out, u = 0.0, {}
    for b in bands:
        share = (band == b).sum() / n
        for a, sign in ((1, 1), (0, -1)):
            cell = (band == b) & (arm == a)
            mean = y[cell].mean()
            out += sign * share * mean
            for who, value in zip(user[cell], y[cell]):
                u[who] = u.get(who, 0.0) + sign * share * (value - mean) / cell.sum()
    return out, np.sqrt(len(u) / (len(u) - 1) * sum(v * v for v in u.values()))


def test_intervals_by_user_cover_the_truth(spark):
    """Sixty outcomes at once, each with a strong part that a user's sessions share: intervals by user cover the true difference,
    intervals that take sessions for independent do not."""
    rng = np.random.default_rng(8)
    users = [f"u{i}" for i in range(300)]
    who = rng.integers(0, 300, 3000)
    band = rng.integers(1, 5, 3000)
    band[:3] = 9  # a stratum that lacks an arm
    frame = spark.createDataFrame([(users[w], int(b)) for w, b in zip(who, band)], "user_pseudo_id string, score_band int")
    arms = {r.user_pseudo_id: r.arm for r in monitoring.assign_users(frame).select("user_pseudo_id", "arm").distinct().collect()}
    assert len(arms) == len(set(who)) and 100 < sum(arms.values()) < 200  # one arm for each user
    who[:3] = who[0]
    arm = np.array([arms[users[w]] for w in who])
    y = 0.3 * arm[:, None] + 0.1 * band[:, None] + rng.normal(size=(300, 60))[who] + 0.5 * rng.normal(size=(3000, 60))
    names = [f"y{i}" for i in range(60)]
    rows = [(users[w], int(b), int(a), *map(float, v)) for w, b, a, v in zip(who, band, arm, y)]
    table = spark.createDataFrame(rows, "user_pseudo_id string, score_band int, arm int, " + ", ".join(f"{n} double" for n in names))
    got = {r.metric: r for r in monitoring.clustered_difference(table, names).collect()}
    plain = plain_difference(who, band, arm, y[:, 7])
    assert (got["y7"].difference, got["y7"].standard_error) == pytest.approx(plain, abs=1e-9)
    assert got["y7"].sessions == 2997
    covered = sum(abs(r.difference - 0.3) <= 1.96 * r.standard_error for r in got.values())
    naive = [np.sqrt(y[arm == 1, i].var() / (arm == 1).sum() + y[arm == 0, i].var() / (arm == 0).sum()) for i in range(60)]
    short = sum(abs(got[f"y{i}"].difference - 0.3) <= 1.96 * naive[i] for i in range(60))
    assert covered >= 53 and short < 50, (covered, short)


def test_one_row_among_a_million_is_found(spark, tmp_path):
    spark.range(1_000_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("a"), F.lit("x").alias("b")).write.parquet(
        str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    changed = one.select("b", "id", F.when(F.col("id") == 77_777, 5).otherwise(F.col("a")).alias("a")).union(one.where("id = 5").select("b", "id", "a"))
    changed.write.parquet(str(tmp_path / "other"))
    other = spark.read.parquet(str(tmp_path / "other"))
    assert quality.differing_buckets(one, one.orderBy(F.desc("id"))) == []
    assert len(quality.differing_buckets(one, other)) in (2, 3)
    got = sorted((r.side, r.id, r.a) for r in quality.difference(one, other).collect())
    assert got == [("actual only", 77_777, None if 77_777 % 7 == 0 else 777), ("expected only", 5, 5), ("expected only", 77_777, 5)]
    assert quality.difference(one, one).count() == 0


def test_rows_that_differ_by_the_place_of_a_null_are_told_apart(spark):
    schema = "a string, b string"
    left, right = spark.createDataFrame([("x", None), ("y", "y")], schema), spark.createDataFrame([(None, "x"), ("y", "y")], schema)
    assert quality.difference(left, right).count() == 2
    assert quality.difference(left, right.limit(0)).count() == 2 and quality.difference(left.limit(0), right.limit(0)).count() == 0
