"""Paired resampling of average precision against a plain loop over rows and replicates."""

import hashlib
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators import resampling
from visitloom.operators.metrics import average_precision
from visitloom.operators.ranking import rank_scores
from visitloom.operators.resampling import resampled_precision, selection_certainty

REPLICATES = 11


@pytest.fixture(scope="module")
def scored(spark):
    """Three groups: scores with ties and a hot score, a null group, and a group without positives."""
    draw = np.random.default_rng(5)
    rows = []
    for model, n, rate in (("a", 4_000, 0.1), (None, 1_500, 0.5), ("none", 300, 0.0)):
        for i in range(n):
            score = 0.5 if i % 3 == 0 else round(float(draw.random()), 3)
            rows.append((model, f"s{i:05d}", int(draw.random() < rate), score))
    return spark.createDataFrame(rows, "model string, session_id string, converted int, predicted_probability double")


def times(session: str, replicate: int) -> int:
    if replicate == 0:
        return 1
    block, place = divmod(replicate - 1, 4)
    u = int(hashlib.md5(f"resample:{session}:{block}".encode()).hexdigest()[8 * place: 8 * place + 8], 16) / 2 ** 32
    drawn, share = 0, exp(-1)
    while u >= share:
        drawn += 1
        share += exp(-1) / factorial(drawn)
    return drawn


def plain(rows) -> dict:
    out = {}
    for model in {r.model for r in rows}:
        order = sorted((r for r in rows if r.model == model), key=lambda r: (-r.predicted_probability, r.session_id))
        for replicate in range(REPLICATES + 1):
            seen = found = total = 0
            for r in order:
                w = times(r.session_id, replicate)
                seen, found = seen + w, found + w * r.converted
                total += w * r.converted * found / seen if seen else 0
            out[model, replicate] = total / found if found else None
    return out


def values(df) -> dict:
    return {(r.model, r.replicate): r.pr_auc for r in df.collect()}


def close(left: dict, right: dict) -> bool:
    return left.keys() == right.keys() and all(
        right[k] is None if v is None else v == pytest.approx(right[k], abs=1e-12) for k, v in left.items())


def test_replicates_equal_a_plain_loop(scored):
    ranked = rank_scores(scored)
    got = values(resampled_precision(ranked, REPLICATES))
    assert close(got, plain(scored.collect()))
    assert got["none", 0] is None
    for r in average_precision(ranked).collect():
        assert got[r.model, 0] == pytest.approx(r.pr_auc, abs=1e-12)


@pytest.mark.parametrize("partitions,batch,block", [(1, 10_000, 16_384), (5, 97, 16_384), (3, 97, 250)])
def test_partitions_batches_and_blocks_do_not_matter(spark, scored, monkeypatch, partitions, batch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": str(partitions)}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = values(resampled_precision(rank_scores(scored.repartition(partitions)), REPLICATES))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert close(got, plain(scored.collect()))


def test_draws_have_the_moments_of_their_law(spark):
    rows = spark.range(4_000).select(F.concat(F.lit("s"), F.col("id")).alias("session_id")).select(resampling.draws(replicates=50).alias("d"))
    drawn = resampling.drawn_times(rows.toArrow().column("d").combine_chunks(), 50)
    assert (drawn[:, 0] == 1).all()
    assert drawn[:, 1:].mean() == pytest.approx(1, abs=0.01) and drawn[:, 1:].var() == pytest.approx(1, abs=0.02)
    assert np.abs(np.corrcoef(drawn[:, 1:].T)[~np.eye(50, dtype=bool)]).max() < 0.1


def test_certainty_of_a_better_and_of_an_equal_model(spark, scored):
    """A model that sees the label a little is ahead in every replicate; a copy of the selected one in none, with no error."""
    one = scored.where("model = 'a'")
    better = one.withColumn("model", F.lit("b")).withColumn("predicted_probability", F.col("predicted_probability") + 0.3 * F.col("converted"))
    copy = better.withColumn("model", F.lit("c"))
    got = {r.model: r for r in selection_certainty(rank_scores(one.union(better).union(copy)), 60).collect()}
    assert set(got) == {"a", "c"} and {r.selected for r in got.values()} == {"b"}
    assert got["a"].share_ahead == 1 and got["a"].low > 0 and got["a"].standard_error > 0
    assert (got["c"].difference, got["c"].standard_error, got["c"].share_ahead) == (0, 0, 0)


def test_no_rows(spark, scored):
    assert resampled_precision(rank_scores(scored.limit(0)), REPLICATES).collect() == []
    assert selection_certainty(rank_scores(scored.limit(0)), REPLICATES).collect() == []
