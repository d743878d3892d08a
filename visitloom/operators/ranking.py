"""Exact global rank of scored rows without a single-task sort.

Rows are range-partitioned on (group, score, key). The key makes the sort key unique, so even a score shared by a third
of all rows is split over partitions. The sorted rows are written once with their position; counts per partition give
each partition its offset; index = offset + position inside the partition. The offsets, one row for each partition and group,
are joined where the rows are read, so the rows are written once. Everything built on the index (bands, top share, average
precision, AUC) is then a narrow read plus an aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.sources.workspace import materialize
from visitloom.spec import BANDS, CAPACITY, KEY, LABEL

_TASK_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


@dataclass(frozen=True)
class Ranked:
    """``rows`` carry ``rank_index`` (0 = first), ``group_rows`` and ``group_positives`` next to the scored columns."""

    rows: DataFrame
    groups: tuple

    @property
    def index(self) -> Column:
        return F.col("rank_index")


def rank_scores(scored: DataFrame, groups=("model",), descending: bool = True, score: str = "predicted_probability",
                label: str = LABEL, key: str = KEY, rank_by: str | None = None) -> Ranked:
    """Rank rows within each group by score, ties by key in ascending order.

    Scores are compared as they are; ``rank_by`` names another column to order by. A null group is a group.
    """
    direction = F.col("sort_score").desc() if descending else F.col("sort_score").asc()
    order = [*[F.col(g) for g in groups], direction, F.col(key)]
    ordered = materialize(
        scored.select(
            *groups, F.col(key), F.col(label).cast("int").alias("label"), F.col(score).alias("score"),
            F.col(rank_by or score).alias("sort_score"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("position", F.monotonically_increasing_id()),
        "ordered-scores",
    ).withColumn("part", F.shiftrightunsigned("position", _TASK_SHIFT).cast("int"))

    by_part = Window.partitionBy(*groups).orderBy("part")  # at most one row per group and partition
    earlier, whole = by_part.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
    offsets = materialize(
        ordered.groupBy(*groups, "part").agg(
            F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
        .select(
            *groups, "part", "first_position",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("positives").over(earlier), F.lit(0)).alias("positives_before"),
            F.sum("n").over(whole).alias("group_rows"),
            F.sum("positives").over(whole).alias("group_positives")),
        "rank-offsets",
    )
    named = offsets.select(F.col("part").alias("offset_part"), *[F.col(g).alias(f"offset_{g}") for g in groups],
                           *[c for c in offsets.columns if c not in {"part", *groups}])
    same = ordered["part"] == named["offset_part"]
    for g in groups:
        same = same & ordered[g].eqNullSafe(named[f"offset_{g}"])
    rows = ordered.join(named, same).withColumn(
        "rank_index", F.col("rows_before") + F.col("position") - F.col("first_position")).drop(
            "offset_part", *[f"offset_{g}" for g in groups])
    return Ranked(rows, tuple(groups))


def equal_frequency_band(bands: int = BANDS) -> Column:
    """1-based band floor(index * bands / n) + 1, in whole numbers."""
    return F.least(F.lit(bands), F.expr(f"(rank_index * {bands}) div group_rows") + 1).cast("int")


def ntile_band(bands: int = BANDS) -> Column:
    """The bucket NTILE assigns: the first ``n mod bands`` buckets hold one row more than the others."""
    short = f"(group_rows div {bands})"
    longer = f"(group_rows % {bands})"
    return F.expr(
        f"CASE WHEN rank_index < {longer} * ({short} + 1) THEN rank_index div ({short} + 1) "
        f"ELSE {longer} + (rank_index - {longer} * ({short} + 1)) div {short} END + 1").cast("int")


def top_share(capacity: float = CAPACITY) -> Column:
    """True for the first ``max(1, ceil(capacity * n))`` rows of the group."""
    return F.col("rank_index") < F.greatest(F.lit(1), F.ceil(F.lit(capacity) * F.col("group_rows")))
