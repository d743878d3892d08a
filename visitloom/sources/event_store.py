"""Flat events stored by session: one sorted file for each bucket of (session, part), so that what is computed for each session
finds a session's events together and shuffles none of them.

A session of more than ``hot`` events is spread over parts of about that many, which are hashed to buckets like sessions; a session
of fewer has the part 0 alone. So no bucket holds more of one session than a part, whatever its share of the log. The session key
may be null like any other; events that are equal in all their columns stay together only as far as they lie in one file split.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.operators.sessions import SESSION_KEY
from visitloom.sources.workspace import materialize

PART = "session_part"
HOT_EVENTS = 1_000_000
STORE_KEY = (*SESSION_KEY, PART)


def with_parts(flat: DataFrame, hot: int = HOT_EVENTS) -> DataFrame:
    """``flat`` and each event's part. At most one in ``hot`` events makes a hot session, so Spark decides by file size how they meet."""
    sizes = materialize(
        flat.groupBy(*SESSION_KEY).agg(F.count(F.lit(1)).alias("events")).where(F.col("events") > hot).select(
            *[F.col(c).alias(f"hot_{c}") for c in SESSION_KEY], F.ceil(F.col("events") / hot).alias("parts")), "hot-sessions")
    spread = F.xxhash64("event_id", "event_timestamp", "event_name", "scan_task")
    events = flat.withColumn("scan_task", F.spark_partition_id())  # copies of one event differ in it
    same = F.lit(True)
    for c in SESSION_KEY:
        same = same & events[c].eqNullSafe(sizes[f"hot_{c}"])
    part = F.when(F.col("parts").isNotNull(), F.pmod(spread, F.col("parts"))).otherwise(0)
    return events.join(sizes, same, "left").select(*flat.columns, part.cast("int").alias(PART))


@dataclass(frozen=True)
class EventStore:
    """A stored log. For a plan without a shuffle of events, ``buckets`` should not be below ``spark.sql.shuffle.partitions``."""

    path: str
    buckets: int
    columns: str  # names and types, as in CREATE TABLE

    def read(self, spark: SparkSession) -> DataFrame:
        """The events with :data:`PART`, in their buckets; the catalog forgets the table at once, the frame keeps its layout."""
        name, key = "event_store_" + uuid.uuid4().hex, ", ".join(STORE_KEY)
        spark.sql(f"CREATE TABLE {name} ({self.columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/events'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_event_store(flat: DataFrame, path: str, buckets: int | None = None, hot: int = HOT_EVENTS) -> EventStore:
    """Store ``flat`` under the new folder ``path``. Buckets are as many as shuffle partitions unless given; a bucket should be some
    hundred MB to few GB."""
    spark = flat.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    name = "event_store_" + uuid.uuid4().hex
    events = with_parts(flat, hot)
    try:
        (events.repartition(buckets, *STORE_KEY).write.bucketBy(buckets, *STORE_KEY).sortBy(*STORE_KEY)
         .option("path", f"{path}/events").format("parquet").saveAsTable(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(columns).alias("columns")).write.parquet(f"{path}/layout")
    return EventStore(path, buckets, columns)


def open_event_store(spark: SparkSession, path: str) -> EventStore:
    return EventStore(path, *spark.read.schema("buckets int, columns string").parquet(f"{path}/layout").first())
