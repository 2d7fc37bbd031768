"""Additive boosting: one feature at a time gets a step on its bins' mean residuals, in a cycle, giving a table per feature.

Boosting works on shared histograms, not on rows. For a numeric target one job counts rows and sums targets by every pair
of bins of two features; with them the sum of residuals in a bin after any number of steps is a matrix product, so the
whole cycle runs at the driver and is exactly what a pass per step would give. For a binary target each round takes the
histograms anew, weighted by the curvature of the log-loss at the present scores, and runs some cycles on that quadratic
model. What tasks send and the driver holds is (features x bins)^2 numbers, whatever the rows.

Bins are cut at quantiles of the training rows; nulls have a bin of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import logistic
from gritstone.operators.blocks import block_sums, doubles
from gritstone.operators.quantiles import quantiles_of


@dataclass
class Shape:
    """A feature's effect: values[0] for a null, values[i + 1] for cuts[i - 1] < x <= cuts[i]."""

    feature: str
    cuts: list[float]
    values: np.ndarray
    rows: np.ndarray

    def column(self) -> Column:
        x, out = F.col(self.feature).cast("double"), F.lit(float(self.values[-1]))
        for cut, value in zip(reversed(self.cuts), self.values[-2:0:-1], strict=True):
            out = F.when(x <= cut, float(value)).otherwise(out)
        return F.when(x.isNull() | ~(F.abs(x) < float("inf")), float(self.values[0])).otherwise(out)

    @property
    def importance(self) -> float:
        """The mean absolute effect over the training rows."""
        return float(np.abs(self.values) @ self.rows / max(self.rows.sum(), 1))


@dataclass
class Shapes:
    intercept: float
    shapes: list[Shape]
    binary: bool

    def linear(self) -> Column:
        return sum((s.column() for s in self.shapes), F.lit(float(self.intercept)))

    def predict(self) -> Column:
        return logistic(self.linear()) if self.binary else self.linear()

    def table(self, df: DataFrame) -> DataFrame:
        """feature, bin (0 for nulls), low, high, n, effect; above low, up to high."""
        rows = []
        for s in self.shapes:
            edges = [None, *s.cuts, None]
            for k, (value, n) in enumerate(zip(s.values.tolist(), s.rows.tolist(), strict=True)):
                rows.append((s.feature, k, None if k == 0 else edges[k - 1], None if k == 0 else edges[k], int(round(n)), value))
        return df.sparkSession.createDataFrame(rows, "feature string, bin int, low double, high double, n bigint, effect double")

    def importance(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([(s.feature, s.importance) for s in self.shapes], "feature string, importance double")


def cycled(pairs: np.ndarray, sums: np.ndarray, bounds: np.ndarray, cycles: int, rate: float, start: np.ndarray | None = None) -> np.ndarray:
    """Bins' effects after `cycles` over all features. pairs: (weighted) rows by two bins; sums: of the target by bin; bounds:
    where each feature's bins start. A step adds rate times the bins' mean residual, less its mean over the rows."""
    effect = np.zeros(len(sums)) if start is None else start.copy()
    count = np.diag(pairs)
    for _ in range(cycles):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rest = sums[a:b] - pairs[a:b] @ effect
            step = np.divide(rest, count[a:b], out=np.zeros(b - a), where=count[a:b] > 0)
            effect[a:b] += rate * (step - step @ count[a:b] / max(count[a:b].sum(), 1e-300))
    return effect


def additive_boosting(table: DataFrame, features: list[str], target: str, binary: bool = False, bins: int = 32, cycles: int = 200, rate: float = 0.1, rounds: int = 20) -> Shapes:
    """Shape tables by cyclic boosting. `cycles` in all; for a binary target they are dealt over `rounds` quadratic models.

    Rows with a null target count nowhere. Few cycles and a small rate leave effects shrunk, as in any boosting.
    """
    held = doubles(table.select(*features, target), [*features, target], whole=False).where(F.col(target).isNotNull()).persist()
    try:
        total = held.agg(F.count("*"), F.avg(target)).first()
        if not total[0]:
            raise ValueError("no row has a target")
        found = quantiles_of(held, {c: F.col(c) for c in features}, {c: [k / bins for k in range(1, bins + 1)] for c in features})
        cuts = [sorted({q for q in found[c] if q is not None and q < found[c][-1]}) for c in features]
        bounds = np.concatenate([[0], np.cumsum([len(c) + 2 for c in cuts])])
        size = int(bounds[-1])

        def binned(x: dict[str, np.ndarray]) -> np.ndarray:
            places = [np.where(np.isnan(x[c]), 0, np.searchsorted(cut, x[c], side="left") + 1) + a for c, cut, a in zip(features, cuts, bounds[:-1], strict=True)]
            return np.column_stack(places)

        def histograms(effect: np.ndarray | None, intercept: float) -> tuple[np.ndarray, np.ndarray, float, float]:
            """Weighted rows by pair of bins, sums of the working target by bin, its sum, and the weights' sum."""

            def part(x: dict[str, np.ndarray]) -> np.ndarray:
                place, z = binned(x), x[target]
                w = np.ones(len(z))
                if effect is not None:
                    eta = intercept + effect[place].sum(axis=1)
                    p = np.clip(1 / (1 + np.exp(-eta)), 1e-6, 1 - 1e-6)
                    w = p * (1 - p)
                    z = eta + (z - p) / w
                pairs, sums = np.zeros((size, size)), np.zeros(size)
                for a in range(len(features)):
                    sums += np.bincount(place[:, a], w * z, size)
                    for b in range(a, len(features)):
                        block = np.bincount(place[:, a] * size + place[:, b], w, size * size).reshape(size, size)
                        pairs += block + (block.T if a != b else 0)
                return np.concatenate([pairs.ravel(), sums, [(w * z).sum(), w.sum()]])

            cells = block_sums(held, size * size + size + 2, part)
            return cells[: size * size].reshape(size, size), cells[size * size : -2], float(cells[-2]), float(cells[-1])

        rows = np.diag(histograms(None, 0.0)[0]) if binary else None
        if not binary:
            pairs, sums, _, _ = histograms(None, 0.0)
            intercept, rows = float(total[1]), np.diag(pairs)
            effect = cycled(pairs, sums - intercept * rows, bounds, cycles, rate)
        else:
            if not 0 < total[1] < 1:
                raise ValueError("the target has one class only")
            intercept, effect = math.log(total[1] / (1 - total[1])), np.zeros(size)
            for k in range(rounds):
                pairs, sums, response, weight = histograms(effect, intercept)
                intercept = (response - np.diag(pairs) @ effect) / weight  # the steps leave the weighted mean alone
                own = cycles // rounds + (k < cycles % rounds)
                effect = cycled(pairs, sums - intercept * np.diag(pairs), bounds, own, rate, effect)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # effects are centred over the training rows
            shift = effect[a:b] @ rows[a:b] / max(rows[a:b].sum(), 1)
            effect[a:b] -= shift
            intercept += shift
        shapes = [Shape(c, cut, effect[a:b], rows[a:b]) for c, cut, a, b in zip(features, cuts, bounds[:-1], bounds[1:], strict=True)]
        return Shapes(float(intercept), shapes, binary)
    finally:
        held.unpersist()
