"""Categorical Naive Bayes whose model is a written table of counts per feature value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.functions.scalar import sigmoid
from visitloom.operators.lookups import Lookup, feature_values, write_lookup
from visitloom.spec import LABEL, NAIVE_BAYES, NAIVE_BAYES_ALPHA, START_FEATURES


@dataclass(frozen=True)
class NaiveBayes:
    """Counts per (column, value) plus, for each feature, the class totals and the number of distinct values."""

    counts: Lookup
    totals: dict
    alpha: float

    @property
    def features(self) -> tuple:
        return tuple(self.totals)

    @property
    def prior(self) -> float:
        """Smoothed share of positives; the class totals are the same for every feature."""
        negatives, positives, _ = next(iter(self.totals.values()))
        return (positives + self.alpha) / (negatives + positives + 2 * self.alpha)

    def denominator(self, feature: str, label: int) -> float:
        """Class size plus one smoothing share per value seen, and one more for all values not seen."""
        return self.totals[feature][label] + self.alpha * (self.totals[feature][2] + 1)

    def probability(self, feature: str, label: int) -> Column:
        return (F.col(f"n{label}") + F.lit(self.alpha)) / F.lit(self.denominator(feature, label))

    def default(self, feature: str, label: int) -> float:
        return self.alpha / self.denominator(feature, label)

    def params(self) -> DataFrame:
        """(column, value, n0, n1, p0, p1) over all features."""
        def by_feature(label: int) -> Column:
            cases = [F.when(F.col("column") == f, self.probability(f, label)) for f in self.features]
            return F.coalesce(*cases).alias(f"p{label}")

        return self.counts.table().select("column", "value", "n0", "n1", by_feature(0), by_feature(1))

    def save(self, path: str) -> None:
        """Counts per value, one folder per feature, and totals per feature."""
        self.counts.table().hint("rebalance", "column").write.mode("overwrite").partitionBy("column").parquet(f"{path}/counts")
        rows = [(i, f, *map(int, t), self.alpha) for i, (f, t) in enumerate(self.totals.items())]
        self.counts.spark.createDataFrame(rows, _TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")

    def defaults(self) -> DataFrame:
        """(column, d0, d1, prior), one row per feature."""
        rows = [(f, self.default(f, 0), self.default(f, 1), self.prior) for f in self.features]
        return self.counts.spark.createDataFrame(rows, "column string, d0 double, d1 double, prior double")


_TOTALS = "place int, feature string, negatives long, positives long, distinct_values long, alpha double"


def load_naive_bayes(spark: SparkSession, path: str) -> NaiveBayes:
    totals = spark.read.schema(_TOTALS).parquet(f"{path}/totals").orderBy("place").collect()  # one row per feature
    counts = Lookup(spark, f"{path}/counts", spark.createDataFrame([], "column string, value string, n0 long, n1 long").schema)
    return NaiveBayes(counts, {r.feature: (r.negatives, r.positives, r.distinct_values) for r in totals}, totals[0].alpha)


def fit_naive_bayes(train: DataFrame, features=START_FEATURES, alpha: float = NAIVE_BAYES_ALPHA) -> NaiveBayes:
    """Count every feature value per class in one pass; repeated values are combined before the shuffle."""
    counts = feature_values(train, features, (LABEL,)).groupBy("column", "value").agg(
        F.count_if(F.col(LABEL) == 0).alias("n0"), F.count_if(F.col(LABEL) == 1).alias("n1"))
    lookup = write_lookup(counts, "naive-bayes-counts")
    totals = lookup.table().groupBy("column").agg(F.sum("n0"), F.sum("n1"), F.count(F.lit(1)))
    by_feature = {row[0]: tuple(row[1:]) for row in totals.collect()}  # one row per feature
    if not by_feature:
        raise ValueError("training rows are needed")
    return NaiveBayes(lookup, {f: by_feature[f] for f in features}, alpha)


def score_naive_bayes(model: NaiveBayes, df: DataFrame) -> DataFrame:
    """Add ``model`` and ``predicted_probability``; values the training rows lack take the feature's default."""
    columns = [c for c in df.columns if c != "model"]
    logit = F.ln(F.lit(model.prior)) - F.ln(F.lit(1.0 - model.prior))
    for feature in model.features:
        names = [f"__{feature}_p0", f"__{feature}_p1"]
        rows = model.counts.read(feature).select(
            "value", *[model.probability(feature, label).alias(names[label]) for label in (0, 1)])
        df = model.counts.attach(df, feature, rows)
        p0, p1 = (F.coalesce(F.col(names[label]), F.lit(model.default(feature, label))) for label in (0, 1))
        logit = logit + F.ln(p1) - F.ln(p0)
    return df.select(F.lit(NAIVE_BAYES).alias("model"), *columns, sigmoid(logit).alias("predicted_probability"))
