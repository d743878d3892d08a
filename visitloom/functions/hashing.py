"""The one hash Spark does not have."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F


def stable_bucket(buckets: int):
    """Vectorised function (column, value) -> bucket: 8-byte BLAKE2b of ``column=value``, little-endian, mod buckets.

    Fixed values: hash, digest size, byte order and the form of the text define the buckets.

    Meant for the distinct values of a feature, not for every row.
    """

    @F.pandas_udf("int")
    def bucket(column: pd.Series, value: pd.Series) -> pd.Series:
        texts = (column + "=" + value).map(lambda text: text.encode("utf-8", errors="replace"))
        return texts.map(lambda raw: int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") % buckets)

    return bucket
