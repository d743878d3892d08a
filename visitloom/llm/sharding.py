"""Proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded hash of the id; the row of rank k among n gets the fractional rank
(k + 1/2) / n; sorted by it, the sources interleave in proportion, and equal cuts of this order give shards that each match
the mixture and differ by one row at most. Both orders are global ranks over range-partitioned narrow rows, so a source with
a third of all rows is spread over tasks.

Defined results: a null source is a source of its own; a null id is shuffled as one id; rows equal in all that is read are
interchangeable; a null text has no bytes (size 1, checksum 0); an empty table gives no rows; texts of
any length are measured whole; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import fresh_name, global_positions, whole_text


def interleaved(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, stratum, size, text_crc32, and ``pos``: the row's place, from 0, in the interleaved order; ``group_rows`` rows."""
    text = whole_text(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10)
        .cast("long").alias("shuffled"), F.monotonically_increasing_id().alias("row"))
    order = ["shuffled", "doc_id", "size", "text_crc32", "row"]  # the row's place in its file lets ranges split repeated rows
    ranked = global_positions(rows, "stratum", order, "shuffled-sources")
    fraction = (2 * F.col("pos") + 1).cast("double") / (2 * F.col("group_rows")).cast("double")
    mixed = ranked.select("doc_id", "stratum", "size", "text_crc32", "shuffled", "row", fraction.alias("fraction"), F.lit(0).alias("all_rows"))
    return global_positions(mixed, "all_rows", ["fraction", "stratum", *order], "interleaved").drop("all_rows", "shuffled", "row")


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, stratum, size, text_crc32, fraction, shard (from 0), slot (from 0 within the shard)."""
    of = F.expr(f"(pos * {shards}) div group_rows")
    start = F.expr(f"(shard * group_rows + {shards - 1}) div {shards}")
    return interleaved(docs, seed).withColumn("shard", of).select(
        "doc_id", "stratum", "size", "text_crc32", "fraction", F.col("shard").cast("int").alias("shard"),
        (F.col("pos") - start).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17) -> None:
    """Writes the documents as Parquet, a folder for each shard. Rows that share an id, size and checksum go together. The
    folders are named ``shard``, with underscores where the table has such a column."""
    keys = ["doc_id", "size", "text_crc32"]
    to = shard(docs, shards, seed).groupBy(*keys).agg(F.min("shard").alias("shard"))
    text, names = whole_text(docs), [fresh_name(docs, n) for n in ("to_doc", "to_size", "to_crc", "shard")]
    to = to.select(*[F.col(c).alias(n) for c, n in zip([*keys, "shard"], names)])
    joined = docs.join(to, docs["doc_id"].eqNullSafe(to[names[0]]) & (F.octet_length(text) + 1 == to[names[1]])
                       & (F.crc32(text.cast("binary")) == to[names[2]])).drop(*names[:3])
    joined.hint("rebalance", names[3]).write.partitionBy(names[3]).parquet(path)
