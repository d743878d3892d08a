"""Session tables and result files: Parquet, CSV, JSON and catalog tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.spec import DATE, KEY, LABEL

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "date": T.DateType()}


def _struct(*groups) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for kind, names in groups for name in names.split()])


SESSION_SCHEMA = _struct(
    ("string", "session_id user_pseudo_id"),
    ("long", "ga_session_id"),
    ("date", "session_date"),
    ("int", "day_of_week is_weekend"),
    ("string", "traffic_source traffic_medium device_category operating_system country"),
    ("long", "total_events distinct_event_types page_views product_views add_to_cart_events checkout_events "
             "shipping_events payment_events purchase_events"),
    ("int", "viewed_product added_to_cart began_checkout added_shipping_info added_payment_info converted"),
    ("long", "transaction_count"),
    ("double", "revenue session_duration_seconds engagement_time_seconds"),
)

METRIC_SCHEMA = _struct(("string", "model metric"), ("double", "value"))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Create or replace the session table, one folder per day, so that a date split reads only its own days."""
    sessions.hint("rebalance", DATE).write.mode("overwrite").partitionBy(DATE).parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_SCHEMA).parquet(path).select(*SESSION_SCHEMA.fieldNames())


def save_as_table(df: DataFrame, database: str, table: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Create the database if needed, then create or replace ``database.table``."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    df = df.hint("rebalance", *partition_by) if partition_by else df
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(f"{database}.{table}")
    return spark.table(f"{database}.{table}")


def column_catalog(spark: SparkSession, table: str) -> DataFrame:
    """Column names and types of a catalog table."""
    columns = [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(columns, "column_name string, data_type string")


def read_session_csv(spark: SparkSession, path: str) -> DataFrame:
    """Session export as CSV, plain or gzip by suffix; only an empty field is null.

    Columns are found by the names of the header, which all files must share, in any order. A missing column raises at once,
    a malformed line or value when it is read. A gzip file is read by one task, so its rows are spread before any further work.
    """
    names = spark.read.option("header", True).csv(path).columns
    if absent := sorted(set(SESSION_SCHEMA.fieldNames()) - set(names)):
        raise ValueError(f"columns missing in {path}: {absent}")
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    text = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(as_text).csv(path)
    rows = text.select(*[_parsed(f) for f in SESSION_SCHEMA])
    return rows.repartition(F.col(KEY)) if any(f.endswith(".gz") for f in text.inputFiles()) else rows


def _parsed(field: T.StructField):
    """The text as the field's type; what is no such value raises, whatever the session's settings."""
    text, value = F.col(field.name), F.col(field.name).try_cast(field.dataType)
    message = F.concat(F.lit(f"{field.name}: no {field.dataType.simpleString()}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value).alias(field.name)


def write_session_csv(sessions: DataFrame, path: str, compression: str = "none") -> None:
    sessions.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def query_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sessions, conversion rate and revenue straight from a CSV export."""
    return read_session_csv(spark, path).agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("converted").alias("conversion_rate"), F.sum("revenue").alias("revenue"))


def write_scores(scored: DataFrame, path: str) -> None:
    """Scored sessions as CSV with ISO dates."""
    scored.select(
        F.col(KEY).cast("string").alias(KEY), F.date_format(DATE, "yyyy-MM-dd").alias(DATE), LABEL,
        "predicted_probability",
    ).write.mode("overwrite").option("header", True).csv(path)


def write_small_csv(table: DataFrame, order_by: str, path: str) -> None:
    """A table of a few rows (deciles, bands) as one CSV file."""
    table.orderBy(order_by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metrics table (model, metric, value) as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def write_document(row: DataFrame, path: str) -> None:
    """A table of one row as one indented JSON document."""
    row.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode(
        "overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A single (indented) JSON document."""
    return spark.read.option("multiLine", True).json(path)


def peek(df: DataFrame, order_by: str, rows: int = 5) -> DataFrame:
    """First rows in key order; a per-partition top list, not a full sort."""
    return df.orderBy(order_by).limit(rows)
