"""Attributes as numbers: by how much the smoothed share of converted sessions of a value lies above that of all sessions,
without the row's own fold while training.

Sessions are dealt into folds by a hash of their id. Each value of an attribute has its sessions and purchases counted for each
fold; its rate for a training row leaves out the fold of that row, so no label ever enters its own number. ``SMOOTHING`` average
sessions are added to each value, and what is compared with is the share outside the same fold, so an attribute of one value
is 0 everywhere and tells nothing of folds. A value that was never met is 0. One number stands for an attribute whatever
the number of its values, and no two values share one by collision.

The rates are a written lookup, a row for each value, joined like every other: Spark plans by the size of its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.operators.lookups import Lookup, feature_values, write_lookup
from visitloom.spec import ATTRIBUTES, KEY, LABEL

FOLDS = 5
SMOOTHING = 20.0
_LOOKUP = T.StructType([T.StructField("value", T.StringType()), T.StructField("rates", T.ArrayType(T.DoubleType())),
                        T.StructField("column", T.StringType())])


def rate_column(feature: str) -> str:
    return f"{feature}_rate"


def fold(folds: int = FOLDS, seed: str = "fold", key: str = KEY) -> Column:
    """The fold of a session, from its id alone."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long")
    return (digest % folds).cast("int")


@dataclass(frozen=True)
class TargetEncoding:
    """Each value's ``rates`` in the lookup: over all training rows, then without fold 0, without fold 1, ..."""

    lookup: Lookup
    features: tuple
    folds: int
    seed: str

    def encode(self, df: DataFrame, training: bool = False) -> DataFrame:
        """``df`` with a rate for each feature in place of its text; ``training`` leaves out each row's own fold."""
        place = fold(self.folds, self.seed) + 1 if training else F.lit(0)
        for feature in self.features:
            rates = self.lookup.read(feature).withColumnRenamed("rates", "__rates")
            df = self.lookup.attach(df, feature, rates).withColumn(
                rate_column(feature), F.coalesce(F.get("__rates", place), F.lit(0.0))).drop("__rates", feature)
        return df

    def save(self, path: str) -> None:
        self.lookup.table().hint("rebalance", "column").write.mode("overwrite").partitionBy("column").parquet(f"{path}/rates")
        self.lookup.spark.createDataFrame(
            [(list(self.features), self.folds, self.seed)], "features array<string>, folds int, seed string",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/folds")


def load_target_encoding(spark: SparkSession, path: str) -> TargetEncoding:
    row = spark.read.parquet(f"{path}/folds").first()
    return TargetEncoding(Lookup(spark, f"{path}/rates", _LOOKUP), tuple(row["features"]), row["folds"], row["seed"])


def fit_target_encoding(train: DataFrame, features=ATTRIBUTES, folds: int = FOLDS, smoothing: float = SMOOTHING,
                        seed: str = "fold", label: str = LABEL) -> TargetEncoding:
    """Counts by value and fold in one pass; rows of a hot value meet only as partial counts."""
    dealt = train.withColumn("fold", fold(folds, seed))
    size, found = F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives")
    of_fold = {r["fold"]: (r["n"], r["positives"]) for r in dealt.groupBy("fold").agg(size, found).collect()}  # one row each
    if not of_fold:
        raise ValueError("training rows are needed")
    counts = feature_values(dealt, features, ("fold", label)).groupBy("column", "value", "fold").agg(size, found)
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(folds) for c in ("n", "positives")]
    values = counts.groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), *by_fold)

    def rate(left_out: int | None) -> Column:
        n, positives = F.col("n"), F.col("positives")
        if left_out is not None:
            n, positives = n - F.col(f"n_{left_out}"), positives - F.col(f"positives_{left_out}")
        all_n, all_positives = (sum(s[i] for f, s in of_fold.items() if f != left_out) for i in (0, 1))
        # In whole numbers, as an attribute of one value must be exactly 0.
        wide = "decimal(19,0)"
        above = positives.cast(wide) * F.lit(all_n).cast(wide) - n.cast(wide) * F.lit(all_positives).cast(wide)
        return above.cast("double") / F.lit(float(max(all_n, 1))) / (n + F.lit(float(smoothing)))

    table = values.select("value", F.array(rate(None), *[rate(f) for f in range(folds)]).alias("rates"), "column")
    return TargetEncoding(write_lookup(table, "target-rates"), tuple(features), folds, seed)
