"""Feature tables known at session start, and their hashed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.hashing import stable_bucket
from visitloom.functions.scalar import or_missing
from visitloom.operators.lookups import distinct_values, write_lookup
from visitloom.spec import ATTRIBUTES, DATE, HASH_BUCKETS, KEY, LABEL, START_FEATURES


def start_features(sessions: DataFrame) -> DataFrame:
    """Key, date, label and the seven features known when the session starts."""
    return sessions.select(KEY, DATE, LABEL, "day_of_week", "is_weekend", *[or_missing(a).alias(a) for a in ATTRIBUTES])


def bucket_column(feature: str) -> str:
    return f"{feature}_bucket"


def hash_encode(df: DataFrame, features=START_FEATURES, buckets: int = HASH_BUCKETS) -> DataFrame:
    """Add one bucket id per feature.

    Every distinct (feature, value) is hashed once; the resulting dimension is written and looked up per feature.
    """
    hashed = distinct_values(df, features).withColumn("bucket", stable_bucket(buckets)(F.col("column"), F.col("value")))
    dimension = write_lookup(hashed, "hash-buckets")
    for feature in features:
        dimension_rows = dimension.read(feature).withColumnRenamed("bucket", bucket_column(feature))
        df = dimension.attach(df, feature, dimension_rows)
    return df
