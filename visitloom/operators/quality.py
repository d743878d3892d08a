"""Input checks: contract, missing values, duplicates, leakage, chronological split, reconciliation."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.scalar import is_close, ratio
from visitloom.spec import (CONTRACT_CONTROLS, DATE, KEY, LABEL, LABEL_DEFINITION, PROHIBITED_COLUMNS, QUALITY_CHECKS, REQUIRED_COLUMNS,
                            START_FEATURES)


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(REQUIRED_COLUMNS) - set(df.columns))


def quality_report(sessions: DataFrame) -> DataFrame:
    """(check, result) rows from one pass over the required columns."""
    absent = missing_columns(sessions)
    present = [c for c in REQUIRED_COLUMNS if c in sessions.columns]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in present), F.lit(0))
    names = list(QUALITY_CHECKS)
    return sessions.agg(
        F.lit("[" + ", ".join(absent) + "]").alias(names[0]),
        nulls.cast("string").alias(names[1]),
        _repeats(KEY).cast("string").alias(names[2]),
        F.min(DATE).cast("string").alias(names[3]),
        F.max(DATE).cast("string").alias(names[4]),
    ).unpivot([], names, "check", "result")


def _repeats(key: str):
    """Rows beyond the first of their key; all rows without a key count as one key."""
    return F.count(F.lit(1)) - F.count_distinct(key) - F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))


def uniqueness_audit(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - _repeats(key)).alias("unique_sessions"),
        _repeats(key).alias("duplicate_sessions"),
    )


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """The keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def columns_matching(columns, words, label: str | None = None) -> list[str]:
    """Names that match the word pattern; the label column may be exempt."""
    pattern = re.compile("|".join(words))
    return [c for c in columns if c != label and pattern.search(c.lower())]


def features_with_token(features, tokens) -> list[str]:
    """Names that contain one of the tokens as plain text."""
    return sorted(f for f in features if any(token in f.lower() for token in tokens))


def populated_columns(df: DataFrame, columns) -> DataFrame:
    """(column_name, populated_rows) for the given columns, one pass over the data."""
    columns = list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, populated_rows long")
    return df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "populated_rows")


def leakage_audit_regex(df: DataFrame, words, label: str | None = None) -> DataFrame:
    """Columns that the word policy forbids, with how many rows carry them; no row means the contract holds."""
    return populated_columns(df, columns_matching(df.columns, words, label))


def column_policy(df: DataFrame, words, label: str | None = None) -> DataFrame:
    """Every column with the verdict of the word policy and the rows that carry it."""
    forbidden = columns_matching(df.columns, words, label)
    return populated_columns(df, df.columns).select(
        "column_name", F.col("column_name").isin(forbidden).alias("forbidden"), "populated_rows")


def leakage_audit_tokens(df: DataFrame, features, tokens, purchases: str = "purchase_events") -> DataFrame:
    """Feature list against a token list: (control, result) rows; features must all be present in ``df``. Where the number of
    purchases is at hand, the label's definition is held against it."""
    found = features_with_token(features, tokens)
    names = list(CONTRACT_CONTROLS)
    complete = F.lit(True)
    for feature in features:
        complete = complete & F.col(feature).isNotNull()
    passed = len(features) == len(START_FEATURES) and not found
    odd = F.count_if((F.col(LABEL) == 1) != (F.col(purchases) > 0)) if purchases in df.columns else F.lit(0)
    return df.agg(
        F.lit(str(len(features))).alias(names[0]),
        F.lit("[" + ", ".join(found) + "]").alias(names[1]),
        F.when(odd == 0, LABEL_DEFINITION).otherwise("Violated").alias(names[2]),
        F.count_if(complete).cast("string").alias(names[3]),
        F.lit("Passed" if passed else "Failed").alias(names[4]),
    ).unpivot([], names, "control", "result")


def require_contract(df: DataFrame, features=START_FEATURES, prohibited=PROHIBITED_COLUMNS) -> None:
    """Raise when a required column is missing or a feature is on the prohibited list."""
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"required columns missing: {absent}")
    used = sorted(set(features) & set(prohibited))
    if used:
        raise ValueError(f"features known only after the session: {used}")


def leakage_audit_columns(df: DataFrame, features=START_FEATURES, prohibited=PROHIBITED_COLUMNS) -> DataFrame:
    """Every column's role under the exact-name policy (feature or excluded), after the contract check."""
    require_contract(df, features, prohibited)
    shown = [c for c in df.columns if c in set(features) | set(prohibited)]
    return populated_columns(df, shown).select(
        "column_name",
        F.when(F.col("column_name").isin(*features), "feature").otherwise("present but excluded").alias("role"),
        "populated_rows",
    )


def chrono_split(df: DataFrame, cutoff: dt.date, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, rows from the cutoff on; raises when a side is empty.

    Both sides are probed for one row, so the table should be a stored one.
    """
    train, test = df.where(F.col(date) < F.lit(cutoff)), df.where(F.col(date) >= F.lit(cutoff))
    if train.isEmpty() or test.isEmpty():
        raise ValueError(f"the split at {cutoff} leaves one side empty")
    return train, test


def split_summary(df: DataFrame, cutoff: dt.date) -> DataFrame:
    return df.groupBy(F.when(F.col(DATE) < F.lit(cutoff), "Train").otherwise("Test").alias("sample")).agg(
        F.min(DATE).alias("start_date"),
        F.max(DATE).alias("end_date"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum(LABEL).alias("purchases"),
        ratio(F.sum(LABEL), F.count(F.lit(1))).alias("conversion_rate"),
    )


def reconcile(actual: DataFrame, expected: DataFrame, on: str, tolerance: float = 0.0,
              relative: float = 1e-5) -> DataFrame:
    """Compare two (check, value) tables row by row; a check absent on one side fails.

    ``expected`` may carry a ``tolerance`` per check; otherwise the one given holds for all.
    """
    allowed = F.col("tolerance") if "tolerance" in expected.columns else F.lit(tolerance)
    left = actual.select(F.col(on).alias("check"), F.col("value").cast("double").alias("actual"))
    right = expected.select(F.col(on).alias("check"), F.col("value").cast("double").alias("expected"),
                            allowed.alias("tolerance"))
    close = is_close(F.col("actual"), F.col("expected"), F.col("tolerance"), relative)
    return left.join(right, "check", "full").select(
        "check", "actual", "expected", F.coalesce(close, F.lit(False)).alias("passed"))


def _row_hash(df: DataFrame, salt: int):
    """64 bits of a row; which columns are null counts, as Spark's hash passes over nulls."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)]
    return F.xxhash64(F.lit(salt), *columns, *[F.isnull(c) for c in columns])


def bucket_digests(df: DataFrame, buckets: int) -> DataFrame:
    """bucket, rows, first, second: rows dealt by their hash, and what identifies the rows of a bucket with their multiplicities,
    in whatever order: two sums of hashes. A task sends a row for each bucket."""
    hashes = df.select(_row_hash(df, 1).alias("h"), _row_hash(df, 2).alias("g"))
    return hashes.groupBy(F.expr(f"pmod(h, {buckets})").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(19,0)")).alias("first"),
        F.sum(F.col("g").cast("decimal(19,0)")).alias("second"))


def differing_buckets(actual: DataFrame, expected: DataFrame, buckets: int = 1024) -> list[int]:
    """The buckets whose rows are not the same on both sides."""
    left, right = (bucket_digests(df.select(*actual.columns), buckets) for df in (actual, expected))
    same = (left["rows"] == right["rows"]) & (left["first"] == right["first"]) & (left["second"] == right["second"])
    joined = left.join(right, left["bucket"] == right["bucket"], "full").where(~F.coalesce(same, F.lit(False)))
    return [r[0] for r in joined.select(F.coalesce(left["bucket"], right["bucket"])).collect()]  # ``buckets`` at most


def difference(actual: DataFrame, expected: DataFrame, buckets: int = 1024) -> DataFrame:
    """Rows found on one side only, duplicates counted; empty when the two tables are equal.

    Digests of buckets come first, which shuffles no row; only rows of buckets that differ are compared row by row. Both tables are
    read twice, so they should be stored ones.
    """
    expected = expected.select(*actual.columns)
    odd = differing_buckets(actual, expected, buckets)
    left, right = (df.where(F.pmod(_row_hash(df, 1), F.lit(buckets)).isin(odd)) for df in (actual, expected))
    return left.exceptAll(right).withColumn("side", F.lit("actual only")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("expected only")))
