"""Per-feature lookup tables: (column, value) -> numbers, written once and joined to rows by value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from visitloom.functions.scalar import or_missing
from visitloom.sources.workspace import read_table, write_table


def feature_values(df: DataFrame, features, keep=()) -> DataFrame:
    """(keep..., column, value) rows: each feature of each row as text."""
    return df.select(*keep, *[or_missing(f).alias(f) for f in features]).unpivot(
        list(keep), list(features), "column", "value")


def distinct_values(df: DataFrame, features) -> DataFrame:
    return feature_values(df, features).distinct()


@dataclass(frozen=True)
class Lookup:
    """A lookup table written under ``path``, one folder per feature."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def table(self) -> DataFrame:
        """All features together."""
        return read_table(self.spark, self.path, self.schema)

    def read(self, feature: str) -> DataFrame:
        """Rows of one feature; read from its own folder, so that Spark plans with the size of that feature alone."""
        schema = T.StructType([f for f in self.schema if f.name != "column"])
        try:
            return read_table(self.spark, f"{self.path}/column={feature}", schema)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # no row had a value of this feature

    def attach(self, df: DataFrame, feature: str, rows: DataFrame) -> DataFrame:
        """Left join by feature text. No hint: the file size decides between broadcast and shuffled join."""
        key = f"__{feature}"
        return df.withColumn(key, or_missing(feature)).join(rows.withColumnRenamed("value", key), key, "left").drop(key)


def write_lookup(table: DataFrame, name: str) -> Lookup:
    return Lookup(table.sparkSession, write_table(table, name, ("column",)), table.schema)
