"""Attributions of tree ensembles by their paths: polynomial in the features, where coalitions would be two to their number.

A leaf is reached if every condition on its path holds. Mix an explained row x with a background row b: a feature taken
from x keeps the path open if x meets the path's interval for it, one taken from b if b does. Features that only x meets
must come from x, those that only b meets must come from b, and the others do not matter; if neither meets one, the leaf
is never reached. With p features of the first kind and q of the second, the leaf's value counts

    +value * (p - 1)! q! / (p + q)!   for each of the first kind
    -value * p! (q - 1)! / (p + q)!   for each of the second

which summed over leaves and averaged over the background are the Shapley values of the ensemble's output, exactly. For a
leaf, rows differ only in which of its intervals they meet. So background rows are counted by that pattern, once, and
a batch of explained rows meets a few patterns a leaf instead of all background rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import quoted

ROW = "row_id"
#: A node is ``(tree, node, feature, threshold, left, right, value)``: values up to the threshold go left, any other, a
#: missing one too, goes right; a leaf has no feature, and its value is what it adds to the output.
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double"
#: What the leaves of one model may take in a worker; they are broadcast.
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class Leaves:
    """All leaves, padded to the longest path: at place j leaf i asks feature ``feature[i, j]`` to lie above ``low`` and
    not above ``high`` (NaN: no bound). Places beyond a path have feature -1."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, nodes: Sequence[tuple]) -> Leaves:
        """From node rows, in any order; a tree's root is the node that no other leads to."""
        known = {(n[0], n[1]): n for n in nodes}
        below = {(n[0], k) for n in nodes if n[2] is not None for k in (n[4], n[5])}
        paths, values = [], []
        open_nodes = [(key, {}) for key in sorted(known) if key not in below]
        while open_nodes:
            (tree, node), path = open_nodes.pop()
            _, _, feature, threshold, left, right, value = known[tree, node]
            if feature is None:
                paths.append(path)
                values.append(value)
                continue
            low, high = path.get(feature, (math.nan, math.nan))
            upper = threshold if math.isnan(high) else min(high, threshold)
            lower = threshold if math.isnan(low) else max(low, threshold)
            open_nodes += [((tree, right), {**path, feature: (lower, high)}), ((tree, left), {**path, feature: (low, upper)})]
        longest = max([1, *map(len, paths)])
        shape = (len(paths), longest)
        if len(paths) * longest * 24 > MOST_BYTES:
            raise ValueError(f"{len(paths)} leaves on paths of up to {longest} features: more than a worker may hold")
        found = cls(np.array(values, float), np.full(shape, -1), np.full(shape, math.nan), np.full(shape, math.nan))
        for i, path in enumerate(paths):
            for j, (feature, (low, high)) in enumerate(sorted(path.items())):
                found.feature[i, j], found.low[i, j], found.high[i, j] = feature, low, high
        return found

    def met(self, x: np.ndarray) -> np.ndarray:
        """Rows by leaves: a bit for every place whose interval the row meets; places beyond a path are met."""
        bits = np.zeros((len(x), len(self.value)), np.int64)
        for j in range(self.feature.shape[1]):
            used = self.feature[:, j] >= 0
            v, low, high = x[:, np.maximum(self.feature[:, j], 0)], self.low[:, j], self.high[:, j]
            fits = ~(v <= low) & ((v <= high) | np.isnan(high)) | ~used
            bits |= fits.astype(np.int64) << j
        return bits

    def output(self, x: np.ndarray) -> np.ndarray:
        return (self.met(x) == (1 << self.feature.shape[1]) - 1) @ self.value


class TreeExplainer:
    """The patterns of a background, and the attributions of rows against it."""

    def __init__(self, leaves: Leaves, background: np.ndarray):
        self.leaves, self.rows = leaves, len(background)
        met = leaves.met(background)
        patterns = [np.unique(met[:, i], return_counts=True) for i in range(met.shape[1])]
        most = max((len(p) for p, _ in patterns), default=0)
        self.pattern = np.zeros((most, met.shape[1]), np.int64)
        self.count = np.zeros((most, met.shape[1]))
        for i, (pattern, count) in enumerate(patterns):
            self.pattern[: len(pattern), i], self.count[: len(pattern), i] = pattern, count
        places = leaves.feature.shape[1]
        fact = [math.factorial(k) for k in range(places + 1)]
        # gain[p, q]: what each of the p features gets, loss[p, q]: what each of the q features gets
        self.gain, self.loss = np.zeros((places + 1, places + 1)), np.zeros((places + 1, places + 1))
        for p in range(places + 1):
            for q in range(places + 1 - p):
                self.gain[p, q] = fact[p - 1] * fact[q] / fact[p + q] if p else 0.0
                self.loss[p, q] = -fact[p] * fact[q - 1] / fact[p + q] if q else 0.0

    def phi(self, x: np.ndarray, features: int) -> np.ndarray:
        """Rows by features."""
        leaves, places = self.leaves, self.leaves.feature.shape[1]
        full = (1 << places) - 1
        mine, total = leaves.met(x), np.zeros((len(x), features))
        for pattern, count in zip(self.pattern, self.count, strict=True):
            share = np.where((mine | pattern) == full, leaves.value * count / self.rows, 0.0)
            only_x, only_b = mine & ~pattern, pattern & ~mine
            p, q = np.bitwise_count(only_x), np.bitwise_count(only_b)
            gain, loss = share * self.gain[p, q], share * self.loss[p, q]
            for j in range(places):
                used = np.flatnonzero(leaves.feature[:, j] >= 0)
                part = np.where(only_x[:, used] >> j & 1, gain[:, used], 0.0) + np.where(only_b[:, used] >> j & 1, loss[:, used], 0.0)
                np.add.at(total, (slice(None), leaves.feature[used, j]), part)
        return total


def tree_attributions(
    rows: DataFrame, background: DataFrame, features: Sequence[str], nodes: Sequence[tuple], max_background: int = 500
) -> DataFrame:
    """``(row_id, feature, phi)`` for every row of ``rows`` (``row_id`` plus the features), on the scale of the leaf values.

    ``background`` has at most ``max_background`` rows, which are broadcast with the leaves. Rows are spread over the
    cores and explained in batches; nothing is shuffled after that.
    """
    spark = rows.sparkSession
    values = [F.col(quoted(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    pool = background.select(*values).limit(max_background + 1).toArrow()
    if pool.num_rows > max_background:
        raise ValueError(f"the background has more than {max_background} rows")
    shared = spark.sparkContext.broadcast(TreeExplainer(Leaves.of(nodes), matrix(pool)) if pool.num_rows else None)
    names, step = list(features), 256

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if shared.value else 0, step):
                part = batch.slice(at, step)
                phi = shared.value.phi(matrix(part.select(range(1, part.num_columns))), len(names))
                which = np.repeat(np.arange(part.num_rows), len(names))
                columns = [part.column(0).take(pa.array(which)), pa.array(names * part.num_rows, pa.string()), pa.array(phi.ravel())]
                yield pa.RecordBatch.from_arrays(columns, [ROW, "feature", "phi"])

    spread = rows.select(ROW, *values).repartition(spark.sparkContext.defaultParallelism, ROW)
    return spread.mapInArrow(explain, f"{ROW} {rows.schema[ROW].dataType.simpleString()}, feature string, phi double")


def matrix(table) -> np.ndarray:
    """Columns of numbers as rows by columns; null is NaN."""
    columns = [c.to_numpy(zero_copy_only=False).astype(float) if isinstance(c, pa.Array) else c.to_numpy().astype(float) for c in table.columns]
    return np.stack(columns, axis=1) if columns else np.zeros((table.num_rows, 0))


def nodes_of(model, target: int = 1) -> list[tuple]:
    """Node rows of a fitted ``pyspark.ml`` tree model.

    Boosted trees and regression trees add up to the model's margin or prediction; for decision trees and forests of
    classes the output is the probability of class ``target``. Categorical splits have no threshold and are refused.
    """
    single = not hasattr(model, "trees")
    trees = [model] if single else list(model.trees)
    weights = [1.0] if single else list(model.treeWeights)
    boosted, classes = type(model).__name__.startswith("GBT"), getattr(model, "numClasses", None)
    scale = 1.0 if boosted or single else 1.0 / sum(weights)
    rows: list[tuple] = []
    for t, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        todo, used = [(tree._call_java("rootNode"), 0)], 1
        while todo:
            node, number = todo.pop()
            if node.subtreeDepth() == 0:
                if boosted or classes is None:
                    value = node.prediction()
                else:
                    stats = list(node.impurityStats().stats())
                    value = stats[target] / sum(stats)
                rows.append((t, number, None, None, None, None, value * weight * scale))
                continue
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("a split by categories has no threshold; encode the feature before fitting")
            rows.append((t, number, split.featureIndex(), split.threshold(), used, used + 1, None))
            todo += [(node.leftChild(), used), (node.rightChild(), used + 1)]
            used += 2
    return rows
