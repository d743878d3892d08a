"""Logistic regression over hashed feature buckets."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.functions.scalar import sigmoid
from visitloom.operators.features import bucket_column
from visitloom.sources.workspace import materialize
from visitloom.spec import HASH_BUCKETS, LABEL, LOGISTIC, LOGISTIC_L2, START_FEATURES


@dataclass(frozen=True)
class HashedLogistic:
    """``weights`` has one number per bucket, so its length is a parameter and not a property of the data."""

    spark: SparkSession
    weights: tuple
    intercept: float
    history: tuple
    features: tuple
    converged: bool = True

    def weight_table(self) -> DataFrame:
        rows = [(i, float(w)) for i, w in enumerate(self.weights)]
        return self.spark.createDataFrame(rows, "bucket int, weight double")

    def training_loss(self) -> DataFrame:
        """Objective (mean log loss plus penalty) after each iteration of the solver."""
        rows = [(i, float(loss)) for i, loss in enumerate(self.history)]
        return self.spark.createDataFrame(rows, "iteration int, objective double")

    def save(self, path: str) -> None:
        """Two tables: the weights, and all else."""
        self.weight_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        self.spark.createDataFrame(
            [(float(self.intercept), len(self.weights), list(self.features), [float(h) for h in self.history], self.converged)],
            "intercept double, buckets int, features array<string>, history array<double>, converged boolean",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/intercept")


def load_hashed_logistic(spark: SparkSession, path: str, features=None) -> HashedLogistic:
    """The model as it was saved. ``features``, if given, must be those it was fitted on."""
    weights = spark.read.parquet(f"{path}/weights").orderBy("bucket").collect()  # one row per bucket
    row = spark.read.parquet(f"{path}/intercept").first()
    if len(weights) != row["buckets"]:
        raise ValueError(f"{path}: {len(weights)} weights for {row['buckets']} buckets")
    if features is not None and tuple(features) != tuple(row["features"]):
        raise ValueError(f"{path} was fitted on {row['features']}, not on {list(features)}")
    return HashedLogistic(spark, tuple(w["weight"] for w in weights), row["intercept"], tuple(row["history"]),
                          tuple(row["features"]), row["converged"])


def _vectors(rows: DataFrame, features, buckets: int) -> DataFrame:
    """Sparse vector of bucket counts; two features in one bucket count twice."""
    tokens = F.array(*[F.col(bucket_column(f)).cast("string") for f in features])
    counter = CountVectorizerModel.from_vocabulary(
        [str(b) for b in range(buckets)], inputCol="tokens", outputCol="features")
    return counter.transform(rows.withColumn("tokens", tokens))


def fit_hashed_logistic(encoded: DataFrame, features=START_FEATURES, buckets: int = HASH_BUCKETS,
                        l2: float = LOGISTIC_L2, max_iter: int = 200, tol: float = 1e-9) -> HashedLogistic:
    """Minimise mean log loss + l2/2 |w|^2, intercept free.

    Sessions with the same buckets and label are one weighted row: the objective stays the same and the rows the solver
    visits in each iteration shrink from sessions to distinct feature combinations. They are written before the solver
    starts, because it reads them once per iteration.
    """
    combos = materialize(
        encoded.groupBy(*[bucket_column(f) for f in features], LABEL).agg(F.count(F.lit(1)).alias("n")), "feature-combos")
    data = _vectors(combos, features, buckets).select(
        "features", F.col(LABEL).cast("double").alias("label"), F.col("n").cast("double").alias("n"))
    solver = LogisticRegression(
        regParam=l2, elasticNetParam=0.0, standardization=False, weightCol="n", maxIter=max_iter, tol=tol,
        family="binomial")
    model: LogisticRegressionModel = solver.fit(data)
    converged = model.summary.totalIterations < max_iter
    if not converged:
        warnings.warn(f"the solver stopped at {max_iter} iterations before it converged", RuntimeWarning, stacklevel=2)
    return HashedLogistic(
        encoded.sparkSession, tuple(model.coefficients.toArray()), model.intercept,
        tuple(model.summary.objectiveHistory), tuple(features), converged)


def score_hashed_logistic(model: HashedLogistic, encoded: DataFrame) -> DataFrame:
    """Add ``model`` and ``predicted_probability`` = sigmoid(intercept + one weight per feature bucket)."""
    weights = F.split(F.lit(",".join(repr(float(w)) for w in model.weights)), ",").cast("array<double>")
    logit = F.lit(float(model.intercept))
    for feature in model.features:
        logit = logit + F.get(weights, F.col(bucket_column(feature)))
    columns = [c for c in encoded.columns if c not in {bucket_column(f) for f in model.features}]
    return encoded.select(F.lit(LOGISTIC).alias("model"), *columns, sigmoid(logit).alias("predicted_probability"))
