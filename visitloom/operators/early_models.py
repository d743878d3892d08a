"""Class-weighted models on early behaviour: logistic regression and boosted trees, with evaluation and attributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.functions.scalar import log_loss, ratio
from visitloom.operators.attributions import added_column, linear_attributions, tree_attributions
from visitloom.operators.metrics import roc_auc
from visitloom.operators.ranking import rank_scores
from visitloom.operators.target_encoding import TargetEncoding, fit_target_encoding, load_target_encoding, rate_column
from visitloom.sources.workspace import materialize
from visitloom.spec import ATTRIBUTES, DATE, KEY, LABEL

# Settings of the two models.
LOGISTIC_ITERATIONS = 30
LOGISTIC_PENALTY = 1.0
TREE_ROUNDS = 50
TREE_STEP = 0.05
TREE_DEPTH = 5
TREE_SUBSAMPLE = 0.8

WEIGHT = "class_weight"


@dataclass(frozen=True)
class EarlyModel:
    """``inputs``: the numeric columns that the model reads, attributes as their rates; ``means``: theirs over the training rows,
    weighted as in training."""

    name: str
    pipeline: PipelineModel
    inputs: tuple
    encoding: TargetEncoding
    means: tuple

    @property
    def columns(self) -> tuple:
        """The source column of each input."""
        rates = {rate_column(f): f for f in self.encoding.features}
        return tuple(rates.get(c, c) for c in self.inputs)

    def save(self, path: str) -> None:
        """The fitted pipeline, the encoding, and a table with name, inputs and means."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.encoding.save(f"{path}/encoding")
        spark = SparkSession.active()
        spark.createDataFrame([(self.name, list(self.inputs), list(self.means))], "name string, inputs array<string>, means array<double>",
                              ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_early_model(spark: SparkSession, path: str) -> EarlyModel:
    row = spark.read.parquet(f"{path}/model").first()
    return EarlyModel(row["name"], PipelineModel.load(f"{path}/pipeline"), tuple(row["inputs"]),
                      load_target_encoding(spark, f"{path}/encoding"), tuple(row["means"]))


def with_class_weights(train: DataFrame) -> tuple[DataFrame, float]:
    """Weight n / (2 * class size) per row, so that both classes weigh the same; also the number of rows."""
    sizes = {row[LABEL]: row["count"] for row in train.groupBy(LABEL).count().collect()}  # two rows
    if len(sizes) < 2:
        raise ValueError("training rows of both classes are needed")
    total = float(sum(sizes.values()))
    weight = F.when(F.col(LABEL) == 1, total / (2 * sizes[1])).otherwise(total / (2 * sizes[0]))
    return train.withColumn(WEIGHT, weight), total


def encode_training(train: DataFrame) -> tuple[TargetEncoding, DataFrame]:
    """The encoding fitted on the rows, and the rows with each attribute's rate outside their own fold."""
    encoding = fit_target_encoding(train, ATTRIBUTES)
    return encoding, encoding.encode(train, training=True)


def _fit(name: str, train: DataFrame, classifier) -> EarlyModel:
    """Numbers as they are, attributes as rates. The encoded rows are written: the fit reads them once for each step."""
    encoding, encoded = encode_training(train)
    encoded = materialize(encoded, "early-encoded")
    inputs = [c for c in encoded.columns if c not in {KEY, DATE, LABEL, WEIGHT}]
    means = encoded.agg(*[(F.sum(F.col(c) * F.col(WEIGHT)) / F.sum(WEIGHT)).alias(c) for c in inputs]).first()
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return EarlyModel(name, Pipeline(stages=[assembler, classifier]).fit(encoded), tuple(inputs), encoding,
                      tuple(float(means[c]) for c in inputs))


def fit_early_logistic(train: DataFrame) -> EarlyModel:
    weighted, rows = with_class_weights(train)
    # The solver minimises the mean loss, so a penalty meant for the summed loss is divided by the number of rows.
    return _fit("logistic", weighted, LogisticRegression(
        labelCol=LABEL, weightCol=WEIGHT, maxIter=LOGISTIC_ITERATIONS, regParam=LOGISTIC_PENALTY / rows))


def fit_early_trees(train: DataFrame, seed: int = 7) -> EarlyModel:
    weighted, _ = with_class_weights(train)
    return _fit("boosted_tree", weighted, GBTClassifier(
        labelCol=LABEL, weightCol=WEIGHT, maxIter=TREE_ROUNDS, stepSize=TREE_STEP, maxDepth=TREE_DEPTH,
        subsamplingRate=TREE_SUBSAMPLE, seed=seed))


def score_early(model: EarlyModel, df: DataFrame) -> DataFrame:
    """Model, key, date, label and P(label = 1)."""
    return model.pipeline.transform(model.encoding.encode(df)).select(
        F.lit(model.name).alias("model"), KEY, DATE, LABEL,
        vector_to_array("probability")[1].alias("predicted_probability"))


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, accuracy and F1 at the threshold, log loss and ROC-AUC; one row per model."""
    hit, label = F.col("score") >= threshold, F.col("label") == 1
    ranked = rank_scores(scored)
    precision, recall = ratio(F.col("both"), F.col("hits")), ratio(F.col("both"), F.col("positives"))
    at_threshold = ranked.rows.groupBy("model").agg(
        F.count_if(hit & label).alias("both"), F.count_if(hit).alias("hits"), F.count_if(label).alias("positives"),
        F.avg((hit == label).cast("int")).alias("accuracy"), F.avg(log_loss(F.col("label"), F.col("score"))).alias("log_loss"),
    ).select("model", precision.alias("precision"), recall.alias("recall"), "accuracy",
             ratio(2 * precision * recall, precision + recall).alias("f1_score"), "log_loss")
    both = at_threshold.unionByName(roc_auc(ranked), allowMissingColumns=True)
    return both.groupBy("model").agg(*[F.max(c).alias(c) for c in both.columns if c != "model"])


def explain_rows(model: EarlyModel, df: DataFrame) -> DataFrame:
    """model, key, base, margin and ``by_<column>``: what each source column adds to the base in each row; they sum to the margin,
    which is the log-odds of the logistic model and half of them of the trees."""
    encoded, fitted = model.encoding.encode(df), model.pipeline.stages[-1]
    if hasattr(fitted, "trees"):
        rows = tree_attributions(encoded, fitted, model.inputs, model.columns)
    else:
        rows = linear_attributions(encoded, fitted.coefficients.toArray(), fitted.intercept, model.means, model.inputs, model.columns)
    return rows.select(F.lit(model.name).alias("model"), "*")


def global_explain(model: EarlyModel, df: DataFrame) -> DataFrame:
    """(feature, attribution): mean absolute attribution of each source column over the rows given."""
    columns = list(model.columns)
    return explain_rows(model, df).agg(*[F.avg(F.abs(F.col(added_column(c)))).alias(c) for c in columns]).unpivot(
        [], columns, "feature", "attribution")
