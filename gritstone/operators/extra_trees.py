"""Extremely randomised trees: every tree grows on all rows, and a node tries one random threshold per chosen feature.

All trees grow together, a level at a time, in two jobs: the least and greatest value of each feature in each open node,
then counts and target sums below the thresholds drawn in between. Thresholds and choices of features come from a
generator seeded with (seed, tree, node, feature), so the forest does not depend on how rows are dealt to tasks. A task
sends (open nodes x features) numbers. A score is the mean of nested CASE expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.operators.blocks import block_sums, doubles


@dataclass
class Node:
    n: float
    total: float
    squares: float
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0


@dataclass
class Forest:
    """Nodes by number: the root is 1, below node k are 2 k (x <= threshold) and 2 k + 1. A leaf gives its mean target."""

    features: list[str]
    trees: list[dict[int, Node]] = field(default_factory=list)

    def _column(self, tree: dict[int, Node], k: int) -> Column:
        node = tree[k]
        if node.feature < 0:
            return F.lit(node.total / node.n)
        x = F.col(self.features[node.feature]).cast("double")
        return F.when(x <= node.threshold, self._column(tree, 2 * k)).otherwise(self._column(tree, 2 * k + 1))

    def predict(self) -> Column:
        """The mean over the trees; null where a feature is null."""
        whole = F.lit(True)
        for c in self.features:
            whole = whole & F.col(c).isNotNull()
        return F.when(whole, sum((self._column(t, 1) for t in self.trees[1:]), self._column(self.trees[0], 1)) / len(self.trees))

    def importance(self, df: DataFrame) -> DataFrame:
        """feature, its share of how much splits lower the sum of squares, mean over the trees."""
        share = np.zeros(len(self.features))
        for tree in self.trees:
            gains = np.zeros(len(self.features))
            for node in tree.values():
                if node.feature >= 0:
                    gains[node.feature] += node.gain
            share += gains / gains.sum() if gains.sum() else 0
        return df.sparkSession.createDataFrame(list(zip(self.features, (share / len(self.trees)).tolist(), strict=True)), "feature string, importance double")


def _descended(tree: dict[int, Node], rows: np.ndarray) -> np.ndarray:
    """The node each row ends in."""
    at = np.ones(len(rows), np.int64)
    for k in sorted(tree):
        node = tree[k]
        if node.feature >= 0:
            here = at == k
            at[here] = 2 * k + (rows[here, node.feature] > node.threshold)
    return at


def drawn(seed: int, tree: int, node: int, width: int, tried: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
    """The features a node tries, of those that vary there, and a threshold for each, evenly between the feature's ends."""
    varied = [j for j in range(width) if high[j] > low[j]]
    order = np.random.default_rng([seed, tree, node]).permutation(width).tolist()
    chosen = [j for j in order if j in varied][:tried]
    out = []
    for j in chosen:
        cut = low[j] + np.random.default_rng([seed, tree, node, j]).random() * (high[j] - low[j])
        out.append((j, float(min(cut, np.nextafter(high[j], low[j])))))
    return out


def extra_trees(table: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 4, tried: int | None = None, least_rows: int = 2, seed: int = 42) -> Forest:
    """A forest for a numeric target, or for 0 and 1, where the gain is that of the Gini index up to a factor.

    tried: features tried per node; by default all. A node is not split at `depth`, with fewer than `least_rows` rows, or
    without spread in target and features. Rows with a null or a value that is not finite count nowhere.
    """
    width = len(features)
    tried = min(tried or width, width)
    held = doubles(table.select(*features, target), [*features, target]).persist()
    try:
        forest = Forest(features)
        row = held.agg(F.count("*").alias("n"), F.sum(target).alias("t"), F.sum(F.col(target) * F.col(target)).alias("s")).first()
        if not row["n"]:
            raise ValueError("no row is without nulls")
        forest.trees = [{1: Node(row["n"], row["t"], row["s"])} for _ in range(trees)]
        for level in range(depth):
            opened = [(t, k) for t, tree in enumerate(forest.trees) for k, node in tree.items() if node.feature < 0 and k >= 1 << level and node.n >= least_rows and node.squares - node.total**2 / node.n > 1e-12 * max(node.squares, 1e-300)]
            if not opened:
                break
            ends = _ends(held, features, forest, opened)
            splits = {}
            for at, (t, k) in enumerate(opened):
                if found := drawn(seed, t, k, width, tried, ends[at, :, 0], ends[at, :, 1]):
                    splits[t, k] = found
            if not splits:
                break
            for (t, k), tries in _split(held, features, target, forest, splits).items():
                node = forest.trees[t][k]
                own = node.total**2 / node.n
                best = None
                for (j, cut), (n, total, squares) in zip(splits[t, k], tries, strict=True):
                    if 0 < n < node.n:
                        gain = total**2 / n + (node.total - total) ** 2 / (node.n - n) - own
                        if best is None or gain > best[0]:
                            best = gain, j, cut, n, total, squares
                if best is not None:
                    node.gain, node.feature, node.threshold = best[0], best[1], best[2]
                    n, total, squares = best[3:]
                    forest.trees[t][2 * k] = Node(n, total, squares)
                    forest.trees[t][2 * k + 1] = Node(node.n - n, node.total - total, node.squares - squares)
        return forest
    finally:
        held.unpersist()


def _ends(held: DataFrame, features: list[str], forest: Forest, opened: list[tuple[int, int]]) -> np.ndarray:
    """opened x features x (least, greatest)."""
    width = len(features)
    place = {pair: at for at, pair in enumerate(opened)}

    def ends(batches):
        import pyarrow as pa

        low, high = np.full((len(opened), width), np.inf), np.full((len(opened), width), -np.inf)
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in features]) if batch.num_rows else np.zeros((0, width))
            for t, tree in enumerate(forest.trees):
                at = _descended(tree, rows)
                for k in np.unique(at):
                    if (t, int(k)) in place:
                        own, p = rows[at == k], place[t, int(k)]
                        low[p], high[p] = np.minimum(low[p], own.min(axis=0)), np.maximum(high[p], own.max(axis=0))
        met = np.flatnonzero(np.isfinite(low.ravel()))
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(low.ravel()[met]), pa.array(high.ravel()[met])], names=["cell", "low", "high"])

    out = np.zeros((len(opened) * width, 2))
    for r in held.select(*features).mapInArrow(ends, "cell bigint, low double, high double").groupBy("cell").agg(F.min("low"), F.max("high")).collect():
        out[r[0]] = r[1], r[2]
    return out.reshape(len(opened), width, 2)


def _split(held: DataFrame, features: list[str], target: str, forest: Forest, splits: dict[tuple[int, int], list[tuple[int, float]]]) -> dict[tuple[int, int], np.ndarray]:
    """For each split tried: rows, target sum and squares at or below the threshold."""
    starts, size = {}, 0
    for pair, tries in splits.items():
        starts[pair] = size
        size += 3 * len(tries)

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows, y, out = np.column_stack([x[c] for c in features]), x[target], np.zeros(size)
        for t, tree in enumerate(forest.trees):
            at = _descended(tree, rows)
            for k in np.unique(at):
                if (t, int(k)) in splits:
                    here = np.flatnonzero(at == k)
                    for i, (j, cut) in enumerate(splits[t, int(k)]):
                        below = y[here[rows[here, j] <= cut]]
                        p = starts[t, int(k)] + 3 * i
                        out[p : p + 3] += len(below), below.sum(), below @ below
        return out

    sums = block_sums(held, size, part)
    return {pair: sums[a : a + 3 * len(splits[pair])].reshape(-1, 3) for pair, a in starts.items()}
