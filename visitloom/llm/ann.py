"""Approximate nearest neighbours by cosine, over several Hilbert orderings of projected vectors.

For each ordering, unit vectors are projected on a few orthonormal directions, drawn at random but longer where a bounded sample
of the vectors varies more, shifted, put on a grid and numbered along a Hilbert curve; Spark range-partitions the numbers and
gives each vector its exact place in the order. The order is cut into blocks of ``BLOCK`` places; a query goes to the blocks that
its window reaches, each block is scored as one matrix product in its own task, and the best of all orderings are merged and
ranked anew by the exact cosine.

Into the blocks go short codes, a byte for each component, with a bound of what the rounding changes in any cosine. A block
gives, of each query, all rows that can be among its nearest by these bounds, and so does the merge, so codes lose nothing;
only what is left after the merge is looked up in full and scored. Where more than ``CROWD`` rows of a block are too alike for
the codes to tell which are nearest, these rows and the query meet once more, with the vectors in full.

Window and number of orderings are not guessed: for a bounded sample of queries the true neighbours are found by brute force over
all vectors, and one pass that counts rows between them gives their exact places in ``CURVES`` orderings, none of which is sorted
for it. For each number of orderings the window is the smallest that holds the wanted share of the neighbours in at least one of
them; the number that costs least is taken, by places compared for each query and rows shipped. Vectors without structure need wide
windows, up to all rows; the result says how wide it was, how many orderings there are, and how many places a query is compared with.

Of equal vectors only as many with the smallest ids stay as could ever be returned; that loses nothing, as ties go to smaller
ids. Queries with equal vectors are searched once, for one neighbour more than wanted, and each then leaves itself out. So a
vector that a third of all rows share takes no more room than another, in the index and among the queries.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id; the
length of vectors is the most frequent one (the longest of those), others take no part; rows that repeat an id take part once,
with the smallest vector; fewer candidates than wanted are all returned; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.llm.common import global_positions
from visitloom.sources.workspace import materialize

#: Fewest and most orderings, dimensions of a projection and bits of each: 8 * 7 bits fit a long.
LEAST_CURVES, CURVES, DIMENSIONS, BITS = 3, 12, 8, 7
#: Shipping a row into the blocks of one ordering costs about as much as comparing it with so many queries.
SHIPPING = 1000
BLOCK = 4096
#: Blocks whose queries may come to another block in one task, at most, and bytes of their vectors as doubles.
QUERY_BLOCKS, QUERY_BYTES = 16, 1 << 25
#: Rows and bytes of the sample that the directions follow.
AXES_ROWS, AXES_BYTES = 4096, 1 << 23
#: Most rows of a block that are told apart after the merge, for each query; more are compared in full within the block.
CROWD = 32
#: Queries of the sample and the share of their neighbours that the window must hold.
SAMPLE, SHARE = 64, 0.97
SEED = 11


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of points on a grid (rows; whole numbers below 2 ** bits), many points at once.

    From the highest bit down, each axis either reflects the lower bits of the first axis or swaps them with it; the Gray
    code of what remains, read bit by bit over the axes, is the number.
    """
    axes = [grid[:, i].astype(np.uint64) for i in range(grid.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, lower = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            reflect = (axes[i] & bit) != 0
            swap = np.where(reflect, np.uint64(0), (axes[0] ^ axes[i]) & lower)
            axes[0] = axes[0] ^ np.where(reflect, lower, swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, np.uint64(0))
    number = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            number = (number << one) | (((axis ^ turn) >> np.uint64(level)) & one)
    return number


@dataclass(frozen=True)
class Axes:
    """The projections of the orderings. They depend on the sample and the seed alone."""

    mean: np.ndarray
    directions: list[np.ndarray]  # of unit length, a matrix for each ordering
    spread: list[np.ndarray]  # how far the sample varies along each
    shifts: list[np.ndarray]

    def first(self, curves: int) -> Axes:
        return Axes(self.mean, self.directions[:curves], self.spread[:curves], self.shifts[:curves])

    def numbers(self, unit: np.ndarray) -> np.ndarray:
        """A row for each unit vector, a column for each ordering."""
        columns = []
        for directions, spread, shift in zip(self.directions, self.spread, self.shifts):
            # Four times the spread on either side of the mean, and room for the shift.
            place = ((unit - self.mean) @ directions / spread + 4) / 8
            grid = np.clip((place + shift) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            columns.append(hilbert(grid.astype(np.int64), BITS).astype(np.int64))
        return np.stack(columns, axis=1)


def axes_of(sample: np.ndarray, curves: int = CURVES) -> Axes:
    """Directions for vectors like those of the sample (unit vectors): normal draws with its covariance, made orthonormal."""
    rng = np.random.default_rng(SEED)
    size = sample.shape[1]
    used = min(DIMENSIONS, size)
    mean = sample.mean(axis=0)
    covariance = (sample - mean).T @ (sample - mean) / len(sample)
    values, vectors = np.linalg.eigh(covariance)
    # A share of the mean variance in every direction, so that draws are never all within a few.
    root = vectors * np.sqrt(np.maximum(values, 0) + 0.01 * max(values.mean(), 1e-12))
    directions, spread, shifts = [], [], []
    for _ in range(curves):
        directions.append(np.linalg.qr(root @ rng.normal(size=(size, used)))[0])
        spread.append(np.sqrt(np.maximum(((covariance @ directions[-1]) * directions[-1]).sum(axis=0), 1e-12)))
        shifts.append(rng.uniform(0, 1, used))
    return Axes(mean, directions, spread, shifts)


def _matrix(packed: list[bytes], kind: str) -> np.ndarray:
    """The vectors as rows, each times the power of two that puts its largest component between 1/2 and 1: cosines stay the
    same to the last bit, and squares neither overflow nor vanish."""
    matrix = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True, initial=0))[1])


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _code_type(size: int) -> np.dtype:
    """A unit vector is ``signs * scale``, but for ``slack`` at most in any cosine with it, single-precision sums included."""
    return np.dtype([("scale", "<f4"), ("slack", "<f4"), ("signs", "i1", (size,))])


def codes(unit: np.ndarray) -> np.ndarray:
    """The short codes of unit vectors."""
    out = np.zeros(len(unit), _code_type(unit.shape[1]))
    out["scale"] = np.abs(unit).max(axis=1, initial=0) / 127
    scale = out["scale"].astype(np.float64)[:, None]
    out["signs"] = np.clip(np.rint(unit / scale), -127, 127)
    out["slack"] = 1.001 * (np.linalg.norm(unit - out["signs"] * scale, axis=1) + (unit.shape[1] + 4) * 2.0 ** -23)
    return out


def possible(coded: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, row, and bounds of their cosine, of all rows that can be among the k nearest to a query (unit vectors)."""
    vectors = coded["signs"].astype(np.float32) * coded["scale"][:, None]
    few, parts = min(k, len(coded)), []
    for at in range(0, len(queries), 256):
        near = queries[at: at + 256].astype(np.float32) @ vectors.T
        low, high = near - coded["slack"], near + coded["slack"]
        least = np.partition(low, len(coded) - few, axis=1)[:, len(coded) - few]
        query, row = np.nonzero(high >= least[:, None])
        parts.append((query + at, row, low[query, row], high[query, row]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _kind(vectors: DataFrame, vector: str) -> str:
    """How components are stored: as they came if they are floats, which loses nothing, else as doubles."""
    return "<f4" if vectors.schema[vector].dataType.elementType == T.FloatType() else "<f8"


def _exact(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines with one query or with one for each row, each by the same sums whatever block it is in."""
    return (others * query).sum(axis=1) / (np.sqrt((others * others).sum(axis=1)) * np.sqrt((query * query).sum(axis=-1)))


def _best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query, id, score) of the k nearest rows to each query, its own among them. Scores are exact cosines."""
    unit = _unit(vectors)
    out = []
    for at in range(0, len(queries), 256):
        some = queries[at: at + 256]
        near = _unit(some) @ unit.T
        for i, row in enumerate(near):
            few = min(k, len(row))
            least = np.partition(row, len(row) - few)[len(row) - few] - 1e-9  # with all that rounding could have put in
            picked = np.flatnonzero(row >= least)
            scores = _exact(some[i: i + 1], vectors[picked])
            first = np.lexsort((ids[picked], -scores))[:k]
            out += [(int(query_ids[at + i]), int(ids[picked[j]]), float(scores[j])) for j in first]
    return out


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
                                      ["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Spark keeps k rows of a query in each task before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and the components in bytes, of the rows that take part."""
    kind = _kind(vectors, vector)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)  # no nulls are left in them
            parts = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), kind)
            ends = (lists.offsets.to_numpy().astype(np.int64) * parts.itemsize).astype(np.int32)
            flat = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(parts)])
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["vec_id", "v"])

    once = rows.mapInArrow(packed, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))
    stored = materialize(once, "vectors")
    size = stored.groupBy(F.octet_length("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return stored.where(F.octet_length("v") == (size["size"] if size else 0))


def _orderings(candidates: DataFrame, axes: Axes, kind: str) -> DataFrame:
    """curve, vec_id, pos, group_rows: the place of each vector in each ordering."""
    curves = len(axes.shifts)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                numbers = axes.numbers(_unit(_matrix(b.column(1).to_pylist(), kind)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(curves), b.num_rows), pa.int32()), pa.array(numbers.ravel()),
                     pa.array(np.repeat(b.column(0).to_numpy(), curves))], ["curve", "number", "vec_id"])

    rows = candidates.select("vec_id", "v").mapInArrow(numbered, "curve int, number long, vec_id long")
    return global_positions(rows, "curve", ["number", "vec_id"], "hilbert").select("curve", "vec_id", "pos", "group_rows")


def _coded(candidates: DataFrame, kind: str) -> DataFrame:
    """vec_id and the short code, in bytes."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = codes(_unit(_matrix(b.column(1).to_pylist(), kind)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    return candidates.select("vec_id", "v").mapInArrow(made, "vec_id long, v binary")


_PAIRS = "curve int, block long, asker long, query_id long, vec_id long, low float, high float"


def _in_full(crowds: DataFrame, candidates: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, score of the k nearest in each crowd (curve, block, asker): its queries are the rows without vec_id,
    its members those without query_id."""
    crowd = crowds.withColumn("asks", F.isnull("vec_id")).withColumn("vec_id", F.coalesce("vec_id", "query_id")).join(
        candidates.select("vec_id", "v"), "vec_id").select("curve", "block", "asker", "vec_id", "v", "asks")

    def block_scores(group: pd.DataFrame) -> pd.DataFrame:
        asks, ids, matrix = group["asks"].to_numpy(), group["vec_id"].to_numpy(), _matrix(group["v"].tolist(), kind)
        found = _best(ids[~asks], matrix[~asks], ids[asks], matrix[asks], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return crowd.groupBy("curve", "block", "asker").applyInPandas(block_scores, _FOUND)


def _scored(possible_pairs: DataFrame, candidates: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, score of the pairs that can be among the k nearest of all blocks. A pair found in several blocks has
    bounds in each; all hold."""
    pairs = materialize(possible_pairs.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.min("high").alias("high")),
                        "merged-pairs")
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    least = pairs.select("query_id", "vec_id", "low").withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= k).groupBy(
        "query_id").agg(F.min("low").alias("least"))
    left = pairs.join(least, "query_id").where("high >= least").select("query_id", "vec_id")
    both = left.join(candidates.select("vec_id", "v"), "vec_id").join(
        candidates.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")), "query_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                queries, vectors = (_matrix(b.column(c).to_pylist(), kind) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_exact(queries, vectors))],
                                                 ["query_id", "vec_id", "score"])

    return both.select("query_id", "vec_id", "query", "v").mapInArrow(scored, _FOUND)


def _brute_force(candidates: DataFrame, queries: list[tuple[int, bytes]], k: int, kind: str) -> DataFrame:
    ids, matrix = np.array([q[0] for q in queries]), _matrix([q[1] for q in queries], kind)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _found(_best(b.column(0).to_numpy(), _matrix(b.column(1).to_pylist(), kind), ids, matrix, k))

    return _top(candidates.select("vec_id", "v").mapInArrow(scored, _FOUND), k)


def places_before(numbers: np.ndarray, ids: np.ndarray, point_numbers: np.ndarray, point_ids: np.ndarray) -> np.ndarray:
    """For rows of one ordering, how many of the points (sorted by number, then id) come no later than each."""
    low, high = (np.searchsorted(point_numbers, numbers, side) for side in ("left", "right"))
    for at in np.unique(low[low < high]):  # rows with the number of a point, for each such number
        tied = np.flatnonzero((low == at) & (high > at))
        end = high[tied[0]]
        low[tied] = at + np.searchsorted(point_ids[at:end], ids[tied], "right")
    return low


def _places(candidates: DataFrame, axes: Axes, points: list[tuple[int, bytes]], kind: str) -> np.ndarray:
    """The place of each point in each ordering: a count of the rows before it, by one pass that sorts nothing."""
    numbers, ids = axes.numbers(_unit(_matrix([p[1] for p in points], kind))), np.array([p[0] for p in points])
    curves, orders = len(axes.shifts), [np.lexsort((ids, column)) for column in numbers.T]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((curves, len(ids) + 1), np.int64)
        for b in batches:
            if b.num_rows:
                found, rows = axes.numbers(_unit(_matrix(b.column(1).to_pylist(), kind))), b.column(0).to_numpy()
                for curve, order in enumerate(orders):
                    counts[curve] += np.bincount(places_before(found[:, curve], rows, numbers[order, curve], ids[order]), minlength=len(ids) + 1)
        curve, gap = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(curve, pa.int32()), pa.array(gap, pa.int32()), pa.array(counts[curve, gap])],
                                         ["curve", "gap", "n"])

    gaps = candidates.select("vec_id", "v").mapInArrow(counted, "curve int, gap int, n long").groupBy("curve", "gap").agg(F.sum("n").alias("n"))
    counts = np.zeros((curves, len(ids) + 1), np.int64)
    for r in gaps.collect():  # a number for each ordering and point
        counts[r.curve, r.gap] = r.n
    places = np.zeros((len(ids), curves), np.int64)
    for curve, order in enumerate(orders):
        places[order, curve] = np.cumsum(counts[curve])[:-1]
    return places


def cheapest(away: np.ndarray, rows: int, queries: int, share: float = SHARE, block: int = BLOCK) -> tuple[int, int]:
    """Orderings and window. ``away``: how many places each sampled neighbour lies from its query, a column for each ordering."""
    if not len(away):
        return 1, 0
    nearest_so_far = np.sort(np.minimum.accumulate(away, axis=1), axis=0)
    windows = nearest_so_far[int(np.ceil(share * len(away))) - 1]
    counts = np.arange(1, away.shape[1] + 1)
    cost = counts * (SHIPPING + queries / rows * np.minimum(rows, 2 * windows + block))
    least = min(LEAST_CURVES, away.shape[1]) - 1
    best = least + int(np.argmin(cost[least:]))
    return best + 1, int(windows[best])


def _plan(candidates: DataFrame, k: int, kind: str, curves: int, block: int, sample: int = SAMPLE) -> tuple[Axes, int, int, int]:
    """The orderings, the window, the number of rows and the bytes of a vector as doubles."""
    rows, queries, size = candidates.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.octet_length("v"))).first()
    by_hash = (F.xxhash64("vec_id"), F.col("vec_id"))
    size = size or int(kind[-1])
    drawn = candidates.orderBy(*by_hash).limit(max(64, min(AXES_ROWS, AXES_BYTES // size))).select("v").collect() if rows else []
    axes = axes_of(_unit(_matrix([bytes(r.v) for r in drawn], kind)) if drawn else np.zeros((1, 1)), curves)
    wide = size // int(kind[-1]) * 8
    some = [(r.vec_id, bytes(r.v)) for r in candidates.where("is_query").orderBy(*by_hash).limit(sample).collect()]
    if not some:
        return axes.first(1), 0, rows, wide
    true = [(r.query_id, r.vec_id) for r in _brute_force(candidates, some, k + 1, kind).where("query_id != vec_id").collect()]
    known = dict(some)
    others = sorted({v for _, v in true} - known.keys())  # sample * (k + 1) rows at most
    known |= {r.vec_id: bytes(r.v) for r in candidates.where(F.col("vec_id").isin(others)).select("vec_id", "v").collect()}
    points = sorted(known.items())
    place = dict(zip((p[0] for p in points), _places(candidates, axes, points, kind)))
    away = np.array([np.abs(place[q] - place[v]) for q, v in true]).reshape(len(true), curves)
    count, window = cheapest(away, rows, queries, block=block)
    return axes.first(count), window, rows, wide


def _once(rows: DataFrame, is_query, k: int) -> DataFrame:
    """vec_id, v, is_query: the k + 1 smallest ids of each vector (Spark keeps so many in each task before it shuffles); the
    first of them stands for all queries with that vector, if there are any."""
    of_vector = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1)
    asked = rows.where(is_query).select("v").distinct().withColumn("asked", F.lit(True))
    return first.join(asked, "v", "left").select(
        "vec_id", "v", ((F.col("n") == 1) & F.coalesce("asked", F.lit(False))).alias("is_query"))


def _of_each_query(found: DataFrame, candidates: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: what was found for a vector, for each query that has it, without its own row."""
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(  # k + 1 at most
        (-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    of_vector = materialize(lists.join(candidates.where("is_query").select(F.col("vec_id").alias("query_id"), "v"), "query_id")
                            .select("v", "near"), "found")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asking.select(F.col("vec_id").alias("query_id"), "v").join(of_vector, "v").select(
        "query_id", F.posexplode(others).alias("place", "other")).select(
            "query_id", (F.col("place") + 1).cast("int").alias("rank"), "other.vec_id", (-F.col("other.minus")).alias("score"))


def nearest(vectors: DataFrame, is_query, k: int = 5, curves: int = CURVES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, window, orderings, compared (places for each query). ``is_query``: a condition on ``vec_id``.
    ``curves``: the most orderings."""
    kind = _kind(vectors, "embedding")
    rows = usable(vectors)
    candidates = materialize(_once(rows, is_query, k), "candidates")
    axes, window, total, wide = _plan(candidates, k, kind, curves, block)
    places = materialize(_orderings(candidates, axes, kind), "places")
    placed = places.withColumn("block", F.expr(f"pos div {block}"))
    reach = F.sequence(F.expr(f"greatest(pos - {window}, 0) div {block}"),
                       F.expr(f"least(pos + {window}, group_rows - 1) div {block}"))
    # Queries that are near each other in the order come to a block together, a bounded number of them in one task.
    asks_of = block * max(1, min(QUERY_BLOCKS, QUERY_BYTES // (block * wide)))
    askers = F.sequence(F.expr(f"greatest(block * {block} - {window}, 0) div {asks_of}"),
                        F.expr(f"least(block * {block} + {block - 1 + window}, group_rows - 1) div {asks_of}"))
    members = placed.join(_coded(candidates, kind), "vec_id").select(
        "curve", "block", F.explode(askers).alias("asker"), "vec_id", "v", F.lit(False).alias("asks"))
    asking = placed.join(candidates.where("is_query").select("vec_id", "v"), "vec_id").select(
        "curve", F.explode(reach).alias("block"), F.expr(f"pos div {asks_of}").alias("asker"), "vec_id", "v", F.lit(True).alias("asks"))

    def block_pairs(group: pd.DataFrame) -> pd.DataFrame:
        asks, ids, packed = group["asks"].to_numpy(), group["vec_id"].to_numpy(), group["v"]
        if asks.all() or not asks.any():
            return pd.DataFrame(columns=[f.split()[0] for f in _PAIRS.split(", ")])
        queries = _unit(_matrix(packed[asks].tolist(), kind))
        coded = np.frombuffer(b"".join(packed[~asks]), _code_type(queries.shape[1]))
        query, row, low, high = possible(coded, queries, k + 1)
        alike = np.bincount(query, minlength=len(queries)) > CROWD
        few, crowd = ~alike[query], np.unique(row[alike[query]])
        none = np.full(len(crowd) + alike.sum(), np.nan)
        asked, found = (pd.concat([pd.Series(x, dtype="Int64") for x in parts]).array for parts in (
            (ids[asks][query[few]], [None] * len(crowd), ids[asks][alike]),
            (ids[~asks][row[few]], ids[~asks][crowd], [None] * int(alike.sum()))))
        return pd.DataFrame({
            "curve": group["curve"].iat[0], "block": group["block"].iat[0], "asker": group["asker"].iat[0],
            "query_id": asked, "vec_id": found,
            "low": np.concatenate([low[few], none]), "high": np.concatenate([high[few], none])})

    pairs = materialize(members.union(asking).groupBy("curve", "block", "asker").applyInPandas(block_pairs, _PAIRS), "pairs")
    both = F.col("query_id").isNotNull() & F.col("vec_id").isNotNull()
    scored = _scored(pairs.where(both), candidates, k + 1, kind).union(_in_full(pairs.where(~both), candidates, k + 1, kind))
    compared = len(axes.shifts) * min(total, 2 * window + block)
    return _of_each_query(_top(scored, k + 1), candidates, rows.where(is_query), k).select(
        "*", *[F.lit(n).cast("long").alias(c) for c, n in (("window", window), ("orderings", len(axes.shifts)), ("compared", compared))])
