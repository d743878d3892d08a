"""How certain the choice between models is: average precision under paired resampling of sessions.

Each replicate draws every session a Poisson(1) number of times. The number comes from MD5 of seed, session and replicate, so it is
the same for every model, partitioning and run, and models are compared on the same draws. A session drawn ``w`` times counts ``w``
times at its place; replicate 0 draws each once and is the plain average precision.

All replicates are taken in one read of the ranked rows, without a shuffle of them. What leaves a batch is one row for each positive,
with the draws of all rows since the positive before it, and one row of sums for each block of ranks. Sums of blocks give each block
what lies before it; a block's positives (at most ``BLOCK`` rows) are then added up on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.functions.scalar import ratio
from visitloom.operators.ranking import Ranked
from visitloom.sources.workspace import materialize
from visitloom.spec import KEY

REPLICATES = 200
SEED = "resample"
BLOCK = 16_384  # ranks whose positives are added up together
# Whole numbers of 32 bits below THRESHOLDS[k] and not below the one before it stand for k draws.
THRESHOLDS = [int(2 ** 32 * p) for p in accumulate(exp(-1) / factorial(k) for k in range(13))]


def draws(key: str = KEY, replicates: int = REPLICATES, seed: str = SEED) -> Column:
    """Four bytes for each replicate; one digest serves four of them."""
    digests = [F.unhex(F.md5(F.concat_ws(":", F.lit(seed), F.col(key), F.lit(str(i))))) for i in range(-(-replicates // 4))]
    return F.concat(*digests)


def drawn_times(digests: pa.Array, replicates: int) -> np.ndarray:
    """Rows by replicates: how often each row is drawn; the first column is the plain sample."""
    width = 16 * -(-replicates // 4)
    fixed = digests.cast(pa.binary(width))
    numbers = np.frombuffer(fixed.buffers()[1], ">u4", len(fixed) * width // 4, fixed.offset * width).reshape(len(fixed), -1)
    times = np.searchsorted(np.array(THRESHOLDS, "u8"), numbers[:, :replicates].astype("u8"), side="right").astype(np.int32)
    return np.hstack([np.ones((len(fixed), 1), np.int32), times])


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, np.int32).ravel()))


def _stretches(batches: Iterator[pa.RecordBatch], groups: int, replicates: int) -> Iterator[pa.RecordBatch]:
    """Rows (groups, draws, label, rank_index) as they lie in their files, to rows (groups, block, last, drawn, found).

    With ``last``: the draws from the row after the positive before (or from where the stretch begins) to the rank ``last``, and those of
    that row if it is a positive. Without: the sums of a stretch within one block. A stretch is a run of consecutive ranks of a group
    within a batch, so the order and cutting of batches do not matter.
    """
    for b in batches:
        if not b.num_rows:
            continue
        label, index = b.column(groups + 1).to_numpy().astype(np.int32), b.column(groups + 2).to_numpy()
        block = index // BLOCK
        opens = np.ones(len(index), bool)
        opens[1:] = (np.diff(index) != 1) | (np.diff(block) != 0)
        for i in range(groups):
            opens[1:] |= np.diff(b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy()) != 0
        drawn = drawn_times(b.column(groups), replicates)
        found = drawn * label[:, None]
        starts = opens.copy()
        starts[1:] |= label[:-1] == 1
        first, begins = np.flatnonzero(starts), np.flatnonzero(opens)
        last = np.append(first[1:], len(index)) - 1
        rows = pa.array(np.concatenate([first, begins]))
        yield pa.RecordBatch.from_arrays(
            [*[b.column(i).take(rows) for i in range(groups)], pa.array(block).take(rows),
             pa.concat_arrays([pa.array(index[last]), pa.nulls(len(begins), pa.int64())]),
             _lists(np.concatenate([np.add.reduceat(drawn, first), np.add.reduceat(drawn, begins)])),
             _lists(np.concatenate([found[last], np.add.reduceat(found, begins)]))],
            [*b.schema.names[:groups], "block", "last", "drawn", "found"])


def _block_precision(table: pa.Table, groups: list) -> pa.Table:
    """One block: the row of what lies before it (``last`` of -1) and its positives in their order, to a sum for each replicate."""
    table = table.sort_by("last").combine_chunks()

    def matrix(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    drawn, found = matrix("drawn"), matrix("found")
    precision = np.cumsum(found, axis=0)[1:] / np.maximum(np.cumsum(drawn, axis=0)[1:], 1)
    sums = (found[1:] * precision).sum(axis=0)
    first = pa.array(np.zeros(len(sums), np.int64))
    return pa.table([*[table.column(g).take(first) for g in groups], pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)],
                    [*groups, "replicate", "summed"])


def resampled_precision(ranked: Ranked, replicates: int = REPLICATES, seed: str = SEED, key: str = KEY) -> DataFrame:
    """groups, replicate (0 to ``replicates``), pr_auc; null where a replicate drew no positive. Needs a descending rank.

    A null group is a group; rows with equal keys are drawn together; without rows there are no replicates.
    """
    keys = list(ranked.groups)
    rows = ranked.rows.select(*keys, draws(key, replicates, seed).alias("draws"), "label", "rank_index")
    named = [rows.schema[k] for k in keys]
    schema = T.StructType([*named, T.StructField("block", T.LongType()), T.StructField("last", T.LongType()),
                           *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("drawn", "found")]])
    count = len(keys)
    parts = materialize(rows.mapInArrow(lambda batches: _stretches(batches, count, replicates), schema), "resampled")

    sums = parts.where("last IS NULL").select(*keys, "block", F.posexplode(F.arrays_zip("drawn", "found")).alias("replicate", "sums"))
    sums = sums.groupBy(*keys, "block", "replicate").agg(F.sum("sums.drawn").alias("drawn"), F.sum("sums.found").alias("found"))
    earlier = Window.partitionBy(*keys, "replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "block", "replicate", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("drawn", "found")])
    before = before.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("replicate", "drawn", "found"))).alias("all")).select(
        *keys, "block", F.lit(-1).cast("long").alias("last"), F.col("all.drawn").alias("drawn"), F.col("all.found").alias("found"))
    positives = parts.where("last IS NOT NULL").select(*keys, "block", "last", *[F.col(c).cast("array<bigint>").alias(c) for c in ("drawn", "found")])
    out = T.StructType([*named, T.StructField("replicate", T.IntegerType()), T.StructField("summed", T.DoubleType())])
    blocks = before.unionByName(positives).groupBy(*keys, "block").applyInArrow(lambda table: _block_precision(table, keys), out)
    # They meet in a grouping and not in a join, so a null group keeps its rows.
    every = blocks.unionByName(sums.select(*keys, "replicate", "found"), allowMissingColumns=True)
    return every.groupBy(*keys, "replicate").agg(ratio(F.sum("summed"), F.sum("found")).alias("pr_auc"))


def selection_certainty(ranked: Ranked, replicates: int = REPLICATES, seed: str = SEED) -> DataFrame:
    """One row for each model but the selected one: both values, their difference, its standard error and 95 % interval over the paired
    replicates, and the share of replicates in which the selected model is ahead.

    The model of the highest average precision is selected, of equal ones the first by name. Ranked by ``model`` alone.
    """
    values = materialize(resampled_precision(ranked, replicates, seed), "replicates")  # a row for each model and replicate
    best = values.where("replicate = 0").orderBy(F.col("pr_auc").desc(), "model").select("model").first()
    if best is None:
        best = (None,)
    leading = values.where(F.col("model").eqNullSafe(best[0])).select(
        "replicate", F.col("model").alias("selected"), F.col("pr_auc").alias("selected_pr_auc"))
    both = values.where(~F.col("model").eqNullSafe(best[0])).join(leading, "replicate")
    plain, ahead = F.col("replicate") == 0, F.col("selected_pr_auc") - F.col("pr_auc")
    drawn = F.when(~plain, ahead)
    return both.groupBy("selected", "model").agg(
        F.max(F.when(plain, F.col("selected_pr_auc"))).alias("selected_pr_auc"),
        F.max(F.when(plain, F.col("pr_auc"))).alias("pr_auc"),
        F.max(F.when(plain, ahead)).alias("difference"),
        F.stddev_samp(drawn).alias("standard_error"),
        F.percentile(drawn, 0.025).alias("low"),
        F.percentile(drawn, 0.975).alias("high"),
        F.avg((drawn > 0).cast("int")).alias("share_ahead"))
