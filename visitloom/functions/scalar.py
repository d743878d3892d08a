"""Small column expressions; all of them stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitloom.spec import LOGIT_LIMIT, MISSING, PROBABILITY_FLOOR


def int_param(params: str, key: str) -> Column:
    """``int_value`` of the first entry of an event-parameter array with this key, null when there is none.

    Written with field access on the whole array (not with a lambda), so that Parquet reads only ``key`` and
    ``value.int_value`` of each entry and leaves the long string values on disk.
    """
    position = F.array_position(F.col(f"{params}.key"), key)
    return F.get(F.col(f"{params}.value.int_value"), (position - 1).cast("int"))


def or_missing(column: str) -> Column:
    """Text of a column, with the marker for a missing value."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def ratio(numerator, denominator) -> Column:
    """Division as double; null when the denominator is zero."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(logit, -LOGIT_LIMIT, LOGIT_LIMIT)))


def log_loss(label: Column, score: Column) -> Column:
    """Loss of one row."""
    p = clip(score, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
    return -(label * F.ln(p) + (F.lit(1) - label) * F.ln(F.lit(1.0) - p))


def squared_error(label: Column, score: Column) -> Column:
    return F.pow(score - label, F.lit(2.0))


def is_close(actual: Column, expected: Column, tolerance: Column, relative: float = 1e-5) -> Column:
    """True when the two values differ by at most ``tolerance + relative * |expected|``."""
    return F.abs(actual - expected) <= tolerance + F.lit(relative) * F.abs(expected)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
