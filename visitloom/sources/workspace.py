"""Written tables in the cluster's shared folder: model tables, ordered scores, and other results read more than once.

A written table cuts the lineage, survives the loss of executors, and gives Spark a real file size to plan joins with:
a lookup table is broadcast only while its files are below ``spark.sql.autoBroadcastJoinThreshold``; above it Spark
plans a shuffled join, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with the setting absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        folder = tempfile.mkdtemp(prefix="visitloom-")
        context.setCheckpointDir(folder)
        _local_folders[context.applicationId] = folder
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/visitloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` as a new Parquet table and return its path."""
    path = new_path(df.sparkSession, name)
    if partition_by:  # a few files for each folder, however many tasks; large folders are split
        df = df.hint("rebalance", *partition_by)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a written table; the schema is given, so no job is spent on inferring it."""
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return read_table(df.sparkSession, write_table(df, name), df.schema)
