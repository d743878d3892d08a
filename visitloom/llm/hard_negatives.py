"""Hard negatives for contrastive training, with exact integer scores from Kronecker-packed products.

Components are whole numbers (``scale * x``, rounded down). In a tile of anchors and candidates, both are biased to be at least
zero and several candidates' components go into separated fields of one wide whole number; one multiplication and addition
for each anchor component then adds to all fields at once, and at the end the fields are cut out and the bias is taken
off. Fields are as wide as the largest sum that the data allow, so none runs into the next. The wide numbers stay below
2 ** 53, which doubles hold exactly, so that the product of a whole tile is one matrix product; components too large for two
fields are cut into digits, whose products add up in 64 bits.

An anchor's positives are its best other rows of its label. Its hard negatives for a positive are the best rows of other labels
whose score lies in a band below the positive's. Both are searched exactly, anchors (a stated set of queries) against all
rows, in tiles of ``TILE`` rows a side: rows in the order of their label are cut into even blocks, so equal rows and hot
labels fill several tiles; positives meet only in tiles where labels meet. A tile gives ``k`` rows for each anchor or
positive at most, and windows keep the best of all tiles.

Defined results: rows with a null label, vector or id, or with a null or non-finite component, take no part; the length of
vectors is the most frequent one (the longest of those), others take no part; scores are ordered with ties to the smaller id;
rows that share the anchor's id are not its partners, and otherwise rows that repeat are rows of their own, among anchors too;
anchors without positives, and positives without rows in their band, give no rows; scores that might not fit a long are
refused with an error; an empty table gives no rows; extra columns are not read. Vectors may be long: a tile holds ``TILE`` of
them a side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import global_positions, named
from visitloom.sources.workspace import materialize

#: Rows a side of a tile, and anchors whose scores are in memory at once.
TILE, STEP = 4096, 256
#: Most partitions that tiles are dealt to.
PARTITIONS = 100_000
#: Bits of a wide number that a double holds exactly.
WIDE = 53
_NONE = np.iinfo(np.int64).min


# ---- Packed products


def _digits(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    return [(values >> (bits * i)) & ((1 << bits) - 1) for i in range(count)]


def packed_product(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of 64-bit whole numbers, a row for each anchor; the caller sees to it that they fit 64 bits."""
    size = rows.shape[1]
    if not len(anchors) or not len(rows) or not size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    bias = min(int(anchors.min()), int(rows.min()))
    a, b = anchors - bias, rows - bias
    span = max(int(a.max()), int(b.max()))
    digit = span.bit_length()
    while 2 * (size * ((1 << digit) - 1) ** 2).bit_length() > WIDE:  # two fields at least
        digit -= 1
    if not digit and span:
        raise ValueError(f"vectors of {size} components are too long for exact packed products")
    count = -(-span.bit_length() // digit) if span else 1
    field = max((size * ((1 << digit) - 1) ** 2).bit_length(), 1)
    fields = max(WIDE // field, 1)
    room = -(-len(rows) // fields) * fields
    total = np.zeros((len(anchors), room), np.int64)
    of_anchor = [d.astype(np.float64) for d in _digits(a, digit, count)]
    for j, low in enumerate(_digits(b, digit, count)):
        parts = np.zeros((room, size), np.int64)
        parts[: len(rows)] = low
        parts = parts.reshape(fields, -1, size)  # the i-th field of a wide number is a row of the i-th part
        wide = sum(parts[i] << (field * i) for i in range(fields)).astype(np.float64)
        for i, part in enumerate(of_anchor):
            sums = (part @ wide.T).astype(np.int64)
            for f in range(fields):
                cut = (sums >> (field * f)) & ((1 << field) - 1)
                total[:, f * len(wide): (f + 1) * len(wide)] += cut << (digit * (i + j))
    total = total[:, : len(rows)]
    return total + bias * (a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]) + size * bias * bias


def first_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row, ties to the left."""
    masked = np.where(allowed, scores, _NONE)
    few = min(k, masked.shape[1])
    least = np.partition(masked, masked.shape[1] - few, axis=1)[:, masked.shape[1] - few]
    row, column = np.nonzero(allowed & (masked >= least[:, None]))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


# ---- Tiles


def _valid(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label and whole components of the rows that take part, whatever the length of their vector."""
    whole = F.transform(named(vector), lambda x: x.cast("double"))
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(named(vec_id).isNotNull() & label.isNotNull() & named(vector).isNotNull()).where(finite).select(
        named(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform(whole, lambda x: F.floor(scale * x)).alias("q"))


def _whole_rows(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """As ``_valid``, of the most frequent length, components in the narrowest type that holds them."""
    rows = _valid(vectors, vec_id, vector, label, scale)
    most = rows.groupBy(F.size("q").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs(F.array_min("q")), F.abs(F.array_max("q")))).alias("largest")
    ).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return rows.limit(0)
    largest = most.largest or 0
    # Half of a long's range is left to the sums of digits and of the bias.
    if 8 * most["size"] * (largest + 1) ** 2 >= 1 << 63:
        raise ValueError(f"scores of {most['size']} components up to {largest} might not fit a long")
    kind = "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "bigint"
    return rows.where(F.size("q") == most["size"]).select("vec_id", "label", F.col("q").cast(f"array<{kind}>").alias("q"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _met(anchors: DataFrame, rows: DataFrame, tiles: int, found, schema: str) -> DataFrame:
    """What ``found(anchors, rows)`` gives for each tile, both as pandas frames."""
    parts = max(1, min(tiles, PARTITIONS))
    # Keys of one type: a whole number hashes by its type.
    keys = {c: F.col(c).cast("long") for c in ("slice", "block")}
    left, right = (df.withColumns(keys).repartition(parts, *keys).groupBy(*keys) for df in (anchors, rows))
    return left.cogroup(right).applyInPandas(found, schema)


def _positives_in_tile(k: int):
    def found(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, labels, q = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["q"])
            for at in range(0, len(anchors), STEP):
                some = anchors.iloc[at: at + STEP]
                scores = packed_product(_matrix(some["q"]), q)
                allowed = (some["label"].to_numpy()[:, None] == labels) & (some["vec_id"].to_numpy()[:, None] != ids)
                row, column = first_of(scores, allowed, k)
                out.append((some["anchor"].to_numpy()[row], ids[column], scores[row, column]))
        columns = [np.concatenate(x) for x in zip(*out)] or [[], [], []]
        return pd.DataFrame(dict(zip(("anchor", "positive_id", "positive_score"), columns)), dtype="int64")

    return found


def _negatives_in_tile(k: int, low: int, high: int):
    def found(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, labels, q = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["q"])
            for at in range(0, len(anchors), STEP):
                some = anchors.iloc[at: at + STEP]
                scores = packed_product(_matrix(some["q"]), q)
                other = some["label"].to_numpy()[:, None] != labels
                for n in range(max(map(len, some["scores"]))):
                    has = np.array([len(s) > n for s in some["scores"]])
                    score = np.array([int(s[n]) for s in some["scores"][has]])
                    # 100 * negative >= low * positive, in whole numbers of any size.
                    least = np.array([max(-(-low * int(s) // 100), _NONE) for s in score])
                    most = np.array([high * int(s) // 100 for s in score])
                    of = scores[has]
                    row, column = first_of(of, other[has] & (of >= least[:, None]) & (of <= most[:, None]), k)
                    out.append((some["anchor"].to_numpy()[has][row], np.full(len(row), n), ids[column], of[row, column]))
        columns = [np.concatenate(x) for x in zip(*out)] or [[], [], [], []]
        return pd.DataFrame(dict(zip(("anchor", "n", "negative_id", "negative_score"), columns)), dtype="int64")

    return found


def _even_block() -> Column:
    """The block of a place among all rows: ``TILE`` rows at most, and as many in one as in the next."""
    blocks = f"((group_rows + {TILE - 1}) div {TILE})"
    return F.expr(f"pos div ((group_rows + {blocks} - 1) div {blocks})")


def _blocks(count: int) -> int:
    return max(1, -(-count // TILE))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
                   positives: int = 5, negatives: int = 5, scale: int = 256, band: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank (of the negative, from 1), negative_id, positive_score, negative_score, positive_rank.

    A negative's score lies between ``band`` hundredths of the positive's. ``is_anchor`` is a condition on ``vec_id``.
    """
    placed = global_positions(
        _whole_rows(vectors, vec_id, vector, label, scale).withColumn("all_rows", F.lit(0)), "all_rows", ["label", "vec_id"], "by-label")
    rows = materialize(placed.withColumn("block", _even_block()).drop("all_rows", "pos", "group_rows"), "blocks")
    asked = global_positions(rows.where(is_anchor).select("vec_id", "label", "q", F.lit(0).alias("all_rows")),
                             "all_rows", ["label", "vec_id"], "anchors-by-label")
    anchors = materialize(asked.withColumn("slice", _even_block()).withColumnRenamed("pos", "anchor").drop(
        "all_rows", "group_rows"), "slices")
    blocks, slices = _blocks(rows.count()), _blocks(anchors.count())

    # Blocks and slices are in the order of labels, so those of a label are neighbours.
    of_label = rows.groupBy("label").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block")).join(
        anchors.groupBy("label").agg(F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice")), "label")
    of_label = materialize(of_label, "labels")
    same = anchors.join(of_label, "label").withColumn("block", F.explode(F.sequence("first_block", "last_block")))
    with_label = rows.join(of_label, "label").withColumn("slice", F.explode(F.sequence("first_slice", "last_slice")))
    columns = ["slice", "block", "vec_id", "label", "q"]
    near = _met(same.select("anchor", *columns), with_label.select(columns), blocks + slices,
                _positives_in_tile(positives), "anchor long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    positive = materialize(near.withColumn("positive_rank", F.row_number().over(best)).where(F.col("positive_rank") <= positives), "positives")

    # At most ``positives`` scores for an anchor.
    scores = positive.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("s"))
    ready = anchors.join(scores.select("anchor", F.transform("s", lambda s: s["positive_score"]).alias("scores")), "anchor")
    everywhere = ready.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("anchor", "scores", *columns)
    all_rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(columns)
    hard = _met(everywhere, all_rows, blocks * slices, _negatives_in_tile(negatives, *band),
                "anchor long, n long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id")
    kept = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    asked_by = anchors.select(F.col("anchor").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    named_pairs = positive.join(asked_by, positive["anchor"] == asked_by["anchor_row"]).drop("anchor_row")
    return kept.withColumn("positive_rank", (F.col("n") + 1).cast("int")).join(named_pairs, ["anchor", "positive_rank"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
