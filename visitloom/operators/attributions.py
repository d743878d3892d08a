"""How much each column moved a score, row by row: Shapley values that add up to the margin exactly.

**Trees.** A row's path through a tree fixes some columns; columns outside a coalition follow both branches by the share of
training weight that went each way. For one leaf only the columns on its path play, and the row matters only by which of them
it satisfies. So a leaf's contributions depend on a pattern of as many bits as there are columns on the path: batches of rows
are turned into patterns, and the Shapley sum runs once for each pattern that occurs. Nodes come from the saved form of the
fitted model; their number is bounded by rounds and depth, whatever the data.

**Logistic model.** Columns enter alone, so a column's value is its coefficient times the distance from the mean of the training
rows (weighted as in training).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.sources.workspace import new_path
from visitloom.spec import KEY


@dataclass(frozen=True)
class Leaf:
    """``value``: prediction times the tree's weight. ``bounds``: for each column on the path, (low, high]; ``shares``: the share
    of training weight that the splits on this column let pass."""

    value: float
    columns: tuple
    bounds: tuple
    shares: tuple
    known: dict = field(default_factory=dict)

    def of_pattern(self, pattern: int) -> np.ndarray:
        """What each column on the path adds for rows that satisfy those with a bit in the pattern."""
        if pattern not in self.known:
            size = len(self.columns)
            hold = [pattern >> j & 1 for j in range(size)]
            out = np.zeros(size)
            for j in range(size):
                by_size = np.ones(1)  # coefficient of t ** s: coalitions of s other columns
                for k in range(size):
                    if k != j:
                        by_size = np.convolve(by_size, [self.shares[k], hold[k]])
                weights = [factorial(s) * factorial(size - 1 - s) / factorial(size) for s in range(size)]
                out[j] = self.value * (hold[j] - self.shares[j]) * (by_size @ weights)
            self.known[pattern] = out
        return self.known[pattern]

    def patterns(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for j, (column, (low, high)) in enumerate(zip(self.columns, self.bounds)):
            x = rows[:, column]
            # As the trees do, what is not below a threshold (not a number, too) goes on above it.
            inside = (~(x <= low) if low > -np.inf else np.ones(len(x), bool)) & ((x <= high) if high < np.inf else True)
            out |= inside.astype(np.int64) << j
        return out


def leaves_of(nodes: list[dict], weight: float = 1.0) -> list[Leaf]:
    """The leaves of one tree; a node has id, prediction, cover, left, right (-1 in a leaf), column and threshold."""
    by_id = {n["id"]: n for n in nodes}
    out = []

    def walk(node: dict, path: dict) -> None:
        if node["left"] < 0:
            columns = tuple(sorted(path))
            out.append(Leaf(weight * node["prediction"], columns, tuple(path[c][0] for c in columns), tuple(path[c][1] for c in columns)))
            return
        (low, high), share = path.get(node["column"], ((-np.inf, np.inf), 1.0))
        for child, bounds in ((by_id[node["left"]], (low, min(high, node["threshold"]))),
                              (by_id[node["right"]], (max(low, node["threshold"]), high))):
            walk(child, path | {node["column"]: (bounds, share * child["cover"] / node["cover"])})

    walk(by_id[0], {})
    return out


def shapley(leaves: list[Leaf], rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Attributions (row, column), the base, and the margin of each row."""
    added, margin, base = np.zeros(rows.shape), np.zeros(len(rows)), 0.0
    for leaf in leaves:
        base += leaf.value * float(np.prod(leaf.shares))
        pattern = leaf.patterns(rows)
        margin += leaf.value * (pattern == (1 << len(leaf.columns)) - 1)
        if leaf.columns and len(rows):
            met, place = np.unique(pattern, return_inverse=True)
            added[:, leaf.columns] += np.stack([leaf.of_pattern(int(p)) for p in met])[place]
    return added, base, margin


def tree_leaves(spark, model) -> list[Leaf]:
    """All leaves of a fitted boosted-tree model of numeric columns, from its saved form."""
    path = new_path(spark, "tree-nodes")
    model.write().save(path)
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # rounds * 2 ** (depth + 1) at most
        threshold = r["split"]["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], []).append({
            "id": r["id"], "prediction": r["prediction"], "cover": r["impurityStats"][0], "left": r["leftChild"],
            "right": r["rightChild"], "column": r["split"]["featureIndex"], "threshold": threshold[0] if threshold else None})
    return [leaf for n, weight in enumerate(model.treeWeights) for leaf in leaves_of(trees[n], weight)]


def added_column(feature: str) -> str:
    return f"by_{feature}"


def tree_attributions(encoded: DataFrame, model, inputs, names, key: str = KEY) -> DataFrame:
    """key, base, margin (half the log-odds), and ``by_<name>`` for each input column."""
    leaves = tree_leaves(encoded.sparkSession, model)

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(inputs))], axis=1).astype(float)
            added, base, margin = shapley(leaves, rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(rows), base)), pa.array(margin), *[pa.array(c) for c in added.T]],
                [key, "base", "margin", *[added_column(n) for n in names]])

    schema = ", ".join(["base double", "margin double", *[f"`{added_column(n)}` double" for n in names]])
    return encoded.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in inputs]).mapInArrow(
        explained, f"`{key}` string, {schema}")


def linear_attributions(encoded: DataFrame, coefficients, intercept: float, means, inputs, names, key: str = KEY) -> DataFrame:
    """The same for a logistic model, whose margin is the log-odds."""
    base = intercept + sum(w * m for w, m in zip(coefficients, means))
    margin = sum((F.lit(float(w)) * F.col(c) for w, c in zip(coefficients, inputs)), F.lit(float(intercept)))
    return encoded.select(
        F.col(key).cast("string").alias(key), F.lit(float(base)).alias("base"), margin.alias("margin"),
        *[(F.lit(float(w)) * (F.col(c) - F.lit(float(m)))).alias(added_column(n))
          for w, m, c, n in zip(coefficients, means, inputs, names)])
