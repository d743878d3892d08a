"""Global rank, bands and metrics against brute force in NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from visitloom.operators import metrics
from visitloom.operators.ranking import rank_scores


def scored(spark, rows, partitions=4):
    return spark.createDataFrame(
        [(m, k, y, float(p)) for m, k, y, p in rows],
        "model string, session_id string, converted int, predicted_probability double").repartition(partitions)


def brute(y, p):
    """Metrics of rows given in key order."""
    y, p = np.asarray(y, float), np.round(np.asarray(p, float), 9)
    n, n1 = len(y), y.sum()
    order = np.lexsort((np.arange(n), -p))
    ys = y[order]
    out = {"pr_auc": None, "roc_auc": None}
    if n1:
        out["pr_auc"] = float((np.cumsum(ys) / np.arange(1, n + 1) * ys).sum() / n1)
    if n1 and n1 < n:
        wins = (p[y == 1][:, None] > p[y == 0][None, :]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).sum()
        out["roc_auc"] = float(wins / (n1 * (n - n1)))
    top = max(1, int(np.ceil(0.10 * n)))
    out["recall"] = float(ys[:top].sum() / n1) if n1 else None
    out["deciles"] = [int(b.sum()) for b in bands(ys, n)]
    return out


def bands(values, n):
    number = np.minimum(10, np.arange(n) * 10 // n + 1)
    return [values[number == d] for d in range(1, 11)]


def check(spark, y, p):
    keys = [f"k{i:05d}" for i in range(len(y))]
    ranked = rank_scores(scored(spark, [("m", k, a, b) for k, a, b in zip(keys, y, p)]))
    row = metrics.metrics_of(ranked).first()
    want = brute(y, p)
    assert row.pr_auc == pytest.approx(want["pr_auc"], abs=1e-12) if want["pr_auc"] is not None else row.pr_auc is None
    assert row.roc_auc == pytest.approx(want["roc_auc"], abs=1e-12) if want["roc_auc"] is not None else row.roc_auc is None
    assert row.recall_at_top_10pct == (pytest.approx(want["recall"]) if want["recall"] is not None else None)
    found = {r.score_decile: r.purchases for r in metrics.decile_table(ranked).collect()}
    assert [found.get(d, 0) for d in range(1, 11)] == want["deciles"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.1, 0.2, 0.5, 0.9])), min_size=1, max_size=60))
def test_metrics_match_brute_force(spark, rows):
    check(spark, [r[0] for r in rows], [r[1] for r in rows])


def test_one_score_shared_by_most_rows(spark):
    rng = np.random.default_rng(3)
    p = np.where(rng.random(3000) < 0.7, 0.25, rng.random(3000))
    check(spark, (rng.random(3000) < 0.2).astype(int).tolist(), p.tolist())


def test_hot_score_is_spread_over_partitions(spark):
    rows = scored(spark, [("m", f"k{i:06d}", i % 2, 0.5) for i in range(40_000)], 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = rank_scores(rows).rows.groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 20_000


def test_index_is_a_permutation_within_each_group(spark):
    rows = [(f"m{i % 3}", f"k{i:05d}", i % 2, (i * 7 % 11) / 11) for i in range(1000)]
    for descending in (True, False):
        got = rank_scores(scored(spark, rows), descending=descending).rows.collect()
        for m in ("m0", "m1", "m2"):
            mine = sorted((r for r in got if r.model == m), key=lambda r: r.rank_index)
            assert [r.rank_index for r in mine] == list(range(len(mine)))
            sign = -1 if descending else 1
            assert mine == sorted(mine, key=lambda r: (sign * r.sort_score, r.session_id))


def test_equal_scores_give_floor_sized_deciles_and_auc_one_half(spark):
    rows = [("m", f"k{i:02d}", i % 2, 0.3) for i in range(23)]
    ranked = rank_scores(scored(spark, rows))
    sizes = {r.score_decile: r.sessions for r in metrics.decile_table(ranked).collect()}
    assert [sizes[d] for d in range(1, 11)] == [len(b) for b in bands(np.zeros(23), 23)]
    assert metrics.roc_auc(ranked).first().roc_auc == 0.5


def test_short_bands_of_both_formulas(spark):
    n = 81_527
    frame = spark.range(n).selectExpr(
        "'m' AS model", "lpad(cast(id AS string), 8, '0') AS session_id", "cast(id % 90 = 0 AS int) AS converted",
        "1.0 / (id + 2) AS predicted_probability").selectExpr(
        "model", "session_id", "converted", "cast(predicted_probability AS double) AS predicted_probability")
    ranked = rank_scores(frame)
    floor = {r.score_decile: r.sessions for r in metrics.decile_table(ranked).collect()}
    tiles = {r.score_decile: r.sessions for r in metrics.lift_ntile(ranked).collect()}
    assert sorted(d for d, s in floor.items() if s == 8152) == [4, 7, 10]
    assert sorted(d for d, s in tiles.items() if s == 8152) == [8, 9, 10]
    assert sum(floor.values()) == sum(tiles.values()) == n


def test_fewer_rows_than_bands(spark):
    ranked = rank_scores(scored(spark, [("m", f"k{i}", 1, i / 10) for i in range(4)], 1))
    assert sorted(r.score_decile for r in metrics.lift_ntile(ranked).collect()) == [1, 2, 3, 4]
    assert sorted(r.score_decile for r in metrics.decile_table(ranked).collect()) == [1, 3, 6, 8]


def test_no_positive_rows_give_nulls(spark):
    row = metrics.model_metrics(scored(spark, [("m", f"k{i}", 0, i / 50) for i in range(30)])).first()
    assert row.pr_auc is None and row.roc_auc is None and row.recall_at_top_10pct is None and row.lift_top_10pct is None
    assert row.conversion_rate_top_10pct == 0.0 and row.log_loss > 0


def test_auc_of_mirrored_scores_adds_to_one(spark):
    rng = np.random.default_rng(5)
    rows = [("m", f"k{i:04d}", int(rng.random() < 0.3), round(float(rng.random()), 2)) for i in range(500)]
    auc = [metrics.roc_auc(rank_scores(scored(spark, r))).first().roc_auc
           for r in (rows, [(m, k, y, 1 - p) for m, k, y, p in rows])]
    assert sum(auc) == pytest.approx(1.0)


def test_calibration_sorts_upwards(spark):
    rows = [("m", f"k{i:02d}", int(i >= 25), i / 30) for i in range(30)]
    table = {r.risk_band: r for r in metrics.calibration_table(rank_scores(scored(spark, rows), descending=False)).collect()}
    assert table[1].predicted_rate < table[10].predicted_rate
    assert (table[1].observed_rate, table[10].observed_rate) == (0.0, 1.0)


def test_fixed_width_bands_keep_probability_one_in_the_last(spark):
    rows = [("m", "a", 1, 1.0), ("m", "b", 0, 0.95), ("m", "c", 0, 0.0)]
    assert {r.probability_band: r.sessions for r in metrics.calibration_fixed_width(scored(spark, rows)).collect()} == {
        9: 2, 0: 1}


def test_comparison_marks_the_best_model(spark):
    good = scored(spark, [("good", f"k{i:02d}", int(i >= 15), i / 20) for i in range(20)])
    poor = scored(spark, [("poor", f"k{i:02d}", int(i >= 15), 1 - i / 20) for i in range(20)])
    table = metrics.compare_models(good, poor)
    assert {r.model: r.selected for r in table.collect()} == {"good": True, "poor": False}
    assert metrics.best_model(table).first().selected_by_pr_auc == "good"


def test_runs_of_equal_scores_are_stitched_over_batches_and_files(spark):
    """A few scores over many files and tiny batches, so that nearly every run is cut somewhere."""
    rng = np.random.default_rng(12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        p = rng.choice([0.1, 0.2, 0.2000001, 0.7], 900, p=[0.6, 0.2, 0.1, 0.1])
        check(spark, (rng.random(900) < 0.3).astype(int).tolist(), p.tolist())
        rows = [(f"m{i % 3}" if i % 3 else None, f"k{i:05d}", int(rng.random() < 0.4), float(rng.choice([0.3, 0.4]))) for i in range(400)]
        got = {r.model: r.roc_auc for r in metrics.roc_auc(rank_scores(scored(spark, rows))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for model in (None, "m1", "m2"):
        mine = [r for r in rows if r[0] == model]
        assert got[model] == pytest.approx(brute([r[2] for r in mine], [r[3] for r in mine])["roc_auc"], abs=1e-12)


def test_scores_are_neither_shuffled_for_ties_nor_written_twice(spark):
    ranked = rank_scores(scored(spark, [("m", f"k{i}", i % 2, i / 100) for i in range(100)]))
    plan = metrics.metrics_of(ranked)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Runs meet by score under a name of their own; rows never do.
    assert exchanges and not any("sort_score" in line or "rank_index" in line for line in exchanges), plan
