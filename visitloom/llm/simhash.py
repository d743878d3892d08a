"""SimHash near-duplicates: fingerprints, then tiled exact comparison of fingerprints.

Two fingerprints of 64 bits that differ in at most four bits agree in at least two of six blocks of bits. For each of the
15 pairs of blocks, fingerprints that agree there form a bucket; within a bucket, fingerprints sorted by their number of
set bits are compared tile by tile (exclusive or, bit count), and tile pairs whose bit counts differ by more than the radius
are skipped. So every pair within the radius is found, and the work for N documents falls by 2**21 / 15 against all pairs.

A bucket above ``tile`` rows is dealt in Spark into tiles of about that many rows, in the order of bit counts; rows of one
count are in any order, so a count that many share fills several tiles. Only tile pairs within the radius become work units:
no task holds more than two tiles. Neighbouring tiles are compared within and across in one unit, others across alone.
A unit gives a spanning star of each cluster in it, not its pairs.

Defined results: null text is empty; very long texts are read whole, some shingles at a time; a text without words has fingerprint zero; exact copies share a fingerprint and link;
rows that repeat an id are fingerprinted each on its own; a null id takes part but never names a component that has another
id; an empty table gives no rows; extra columns are only hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import keep_rows, row_hash, whole_text
from visitloom.llm.components import connected_components
from visitloom.sources.workspace import materialize

SEED = 42
#: Lowest bit and width of the blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Shingles of a text that are hashed at a time.
PORTION = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """The 64 bits of a text, as an unsigned number."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six white-space characters.
    parts = text.encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PORTION):
        pairs = zip(starts[at: at + PORTION], ends[at: at + PORTION])
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, row_hash, fp (the 64 bits as a signed long) of every row."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"),
                       whole_text(docs).alias("text")).mapInArrow(made, "doc_id long, row_hash long, fp long")


def _buckets(distinct: DataFrame) -> DataFrame:
    """bucket, fp: each fingerprint once for each pair of blocks."""
    def block(i: int):
        low, width = BLOCKS[i]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    keys = [F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(block(i), 11) + block(j)
            for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def _units(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """bucket, left, right, at, bits, fp: what one work unit compares. ``left`` and ``right`` are the tiles of a large bucket
    by number, ``at`` the one that the row is of; all are 0 for others."""
    rows = _buckets(distinct)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, "bucket").withColumn("bits", F.bit_count("fp").cast("long")), "shared-buckets")
    zero = F.lit(0).cast("long")
    small = shared.where(F.col("n") <= tile).select(
        "bucket", zero.alias("left"), zero.alias("right"), zero.alias("at"), "bits", "fp")

    # A row's place in its bucket, by bit count: at most 65 counts for each bucket tell where a count begins.
    large = shared.where(F.col("n") > tile)
    counts = large.groupBy("bucket", "bits").agg(F.count(F.lit(1)).alias("alike"))
    counts = counts.withColumn("before", F.sum("alike").over(Window.partitionBy("bucket").orderBy("bits")) - F.col("alike"))
    place = F.col("before") + F.pmod(F.xxhash64("fp"), F.col("alike"))
    dealt = large.join(counts, ["bucket", "bits"]).select("bucket", "bits", "fp", F.floor(place / tile).alias("part"))
    dealt = materialize(dealt, "dealt-buckets")

    order = Window.partitionBy("bucket").orderBy("part")
    tiles = dealt.groupBy("bucket", "part").agg(F.min("bits").alias("low"), F.max("bits").alias("high"))
    alone = ((F.lead("low").over(order) - F.col("high") > radius) | F.lead("low").over(order).isNull()) & (
        (F.col("low") - F.lag("high").over(order) > radius) | F.lag("high").over(order).isNull())
    tiles = materialize(tiles.select("bucket", "part", "low", "high", F.row_number().over(order).cast("long").alias("at"),
                                     alone.alias("alone")), "bucket-tiles")
    left = tiles.select("bucket", "alone", F.col("at").alias("left"), "high")
    right = tiles.select("bucket", F.col("at").alias("right"), "low")
    pairs = left.join(right, "bucket").where(
        ((F.col("left") < F.col("right")) & (F.col("low") - F.col("high") <= radius))
        | ((F.col("left") == F.col("right")) & F.col("alone"))).select("bucket", "left", "right")
    ends = pairs.select("bucket", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("at"))
    ends = ends.join(tiles.select("bucket", "at", "part"), ["bucket", "at"])
    return small.union(dealt.join(ends, ["bucket", "part"]).select("bucket", "left", "right", "at", "bits", "fp"))


def clusters(fps: np.ndarray, radius: int, side: int = 512, split: int | None = None) -> np.ndarray:
    """For fingerprints sorted by bit count, the index of the first member of each one's cluster. With ``split``, only those
    before it are compared with those from it on."""
    label, bits = np.arange(len(fps)), np.bitwise_count(fps)
    for i in range(0, len(fps) if split is None else split, side):
        for j in range(i if split is None else split, len(fps), side):
            a, b = slice(i, i + side if split is None else min(i + side, split)), slice(j, j + side)
            if int(bits[j]) - int(bits[a][-1]) > radius:
                break
            if label[a].min() == label[a].max() == label[b].min() == label[b].max():
                continue
            near = np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius
            while True:
                low_a = np.minimum(label[a], np.where(near, label[b][None, :], len(fps)).min(axis=1))
                low_b = np.minimum(label[b], np.where(near, low_a[:, None], len(fps)).min(axis=0))
                if (low_a == label[a]).all() and (low_b == label[b]).all():
                    break
                moved = np.unique(np.stack([np.concatenate([label[a], label[b]]), np.concatenate([low_a, low_b])]), axis=1)
                _merge(label, moved)
    return label


def _merge(label: np.ndarray, pairs: np.ndarray) -> None:
    """Joins the classes named in each pair, everywhere."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs.T.tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in root:
        to[x] = find(x)
    label[:] = to[label]


def links(distinct: DataFrame, radius: int = 4, tile: int = 4096) -> DataFrame:
    """a, b: enough pairs of the fingerprints (fp, distinct) within the radius to connect all that are."""
    units = _units(distinct, radius, tile)
    keys = ["bucket", "left", "right"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in range(6)]) if b.num_rows else np.zeros((6, 0), np.int64)
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            cut = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield stars(rows[:, :last], cut[:-1])
            rest = rows[:, last:]
        if rest is not None:
            yield stars(rest, np.zeros(0, np.int64))

    def stars(rows: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
        fps, apart = np.ascontiguousarray(rows[5]).view(np.uint64), rows[2] - rows[1] > 1
        starts, ends = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(fps)]]).astype(int)
        pairs = starts[ends - starts == 2]
        near = pairs[np.bitwise_count(fps[pairs] ^ fps[np.minimum(pairs + 1, max(len(fps) - 1, 0))]) <= radius]
        a, b = [fps[near + 1]], [fps[near]]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            split = int(np.searchsorted(rows[3, s:e], rows[2, s])) if apart[s] else None
            label = clusters(fps[s:e], radius, split=split)
            member = np.flatnonzero(label != np.arange(e - s))
            a.append(fps[s:e][member])
            b.append(fps[s:e][label[member]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return units.repartition(*keys).sortWithinPartitions(*keys, "at", "bits", "fp").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = 4096) -> DataFrame:
    """Of every row: doc_id, row_hash, fp, component_id (smallest doc_id reachable over links, itself included) and cluster
    (a number that the rows of a component share, also where all its ids are null)."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    parts = connected_components(links(distinct.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    linked = distinct.join(parts, "fp")
    named = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = distinct.join(parts, "fp", "left").join(named, "component", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("component", "fp").alias("cluster"))
    return rows.join(of_fp, "fp").select("doc_id", "row_hash", "fp", "component_id", "cluster")


def one_of_each_group(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The row with the smallest id of each group (ids before null, then the smallest hash), with all its columns."""
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_hash")).alias("first")
    return keep_rows(docs, near_duplicates(docs, words, radius).groupBy("cluster").agg(first).select("first.doc_id", "first.row_hash"))
