"""Helpers that several operators share: whole texts, row keys, exact global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.sources.workspace import materialize

_TASK_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text as a string, null as empty. Clashing extra columns do no harm: only the named column is read."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def named(name: str) -> Column:
    """The column of exactly this name, which may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of a row; with ``doc_id`` beside it, it tells rows of one id apart.

    Spark's hash passes over nulls, so which columns are null is hashed too. Nested columns, some of which it does not
    take, are hashed as JSON.
    """
    parts = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        column = named(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        parts += [F.isnull(column), F.to_json(F.struct(column)) if nested else column]
    return F.xxhash64(*parts)


def global_positions(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` within ``group``) and ``group_rows``, without a single-task sort.

    Rows are range-partitioned on group and order, so that a group with a third of all rows spreads over many tasks; the
    sorted rows are written once with their place; counts per partition and group give each partition its offset. The
    window runs over these counts alone: one row for each partition and group. ``group`` holds no null.
    """
    keys = [F.col(group), *[F.col(c) for c in order]]
    rows = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), name
    ).withColumn("part", F.shiftrightunsigned("place", _TASK_SHIFT))
    parts = rows.groupBy(group, "part").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n"))
    by_part, whole = Window.partitionBy(group).orderBy("part"), Window.partitionBy(group)
    offsets = materialize(parts.select(
        F.col(group).alias("offset_group"), F.col("part").alias("offset_part"),
        (F.sum("n").over(by_part) - F.col("n") - F.col("first_place")).alias("shift"),
        F.sum("n").over(whole).alias("group_rows")), f"{name}-offsets")
    joined = rows.join(offsets, (rows[group] == F.col("offset_group")) & (rows["part"] == F.col("offset_part")))
    return joined.withColumn("pos", F.col("place") + F.col("shift")).drop(
        "place", "part", "shift", "offset_group", "offset_part")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores where the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and :func:`row_hash` are in ``keys`` (doc_id, row_hash); of rows that are equal
    in every column, one. Null ids match null ids. The text is shuffled once, by the hash, which no hot group shares."""
    name = fresh_name(docs, "row_hash_of_all")
    hashed = docs.withColumn(name, row_hash(docs))
    wanted = keys.select(F.col("doc_id").alias("wanted_doc"), F.col("row_hash").alias("wanted_hash"))
    kept = hashed.join(
        wanted, (hashed[name] == wanted["wanted_hash"]) & hashed["doc_id"].eqNullSafe(wanted["wanted_doc"]), "left_semi")
    return kept.dropDuplicates([name, "doc_id"]).drop(name)
