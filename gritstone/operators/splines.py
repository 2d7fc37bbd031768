"""Splines as column expressions, and additive models of them with a penalty chosen by generalised cross-validation.

A basis is a list of piecewise polynomials, computed at the driver; a fitted curve is one of them, so scoring is one CASE
and one polynomial per feature. Additive models need the moments of the basis only: one job for a numeric target, one per
round for a binary one; the smoothing penalty is chosen from them at the driver. A null stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import logistic
from gritstone.operators.blocks import block_sums, doubles


@dataclass
class Pieces:
    """Functions of one variable: on the interval from breaks[i - 1] to breaks[i] each is a polynomial in x - origin[i].

    The first interval reaches from below, the last to above; `clip` holds x within its bounds first.
    """

    breaks: np.ndarray
    origin: np.ndarray  # one more than breaks
    polynomials: np.ndarray  # functions x intervals x powers, from the constant up
    clip: tuple[float, float] | None = None

    def _held(self, x: Column) -> Column:
        return x if self.clip is None else F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(self.clip[0])), F.lit(self.clip[1])))

    def columns(self, x: Column) -> list[Column]:
        return [Pieces(self.breaks, self.origin, p[None], self.clip).column(x) for p in self.polynomials]

    def column(self, x: Column) -> Column:
        """The first function."""
        held, out = self._held(x), None
        for i in reversed(range(len(self.origin))):
            at, value = held - F.lit(float(self.origin[i])), F.lit(float(self.polynomials[0, i, -1]))
            for c in self.polynomials[0, i, -2::-1]:
                value = value * at + F.lit(float(c))
            out = value if out is None else F.when(held < F.lit(float(self.breaks[i])), value).otherwise(out)
        return F.when(x.isNotNull(), out)

    def values(self, x: np.ndarray) -> np.ndarray:
        """rows x functions."""
        held = x if self.clip is None else np.clip(x, *self.clip)
        i = np.searchsorted(self.breaks, held, side="right")
        at = held - self.origin[i]
        out = np.zeros((len(x), len(self.polynomials)))
        for power in range(self.polynomials.shape[2] - 1, -1, -1):
            out = out * at[:, None] + self.polynomials[:, i, power].T
        return out

    def combined(self, weights: np.ndarray) -> Pieces:
        """The weighted sum of the functions, as one."""
        return Pieces(self.breaks, self.origin, np.tensordot(weights, self.polynomials, 1)[None], self.clip)


def b_splines(low: float, high: float, knots: int = 5, degree: int = 3) -> Pieces:
    """B-splines on evenly spaced knots from low to high, which go on at either side; constant beyond. knots + degree - 1 functions."""
    if not low < high or knots < 2:
        raise ValueError("a spline needs two knots and a range of values")
    step = (high - low) / (knots - 1)
    inner = knots - 1  # intervals
    # on interval i (in units of a step, from its left end) function i + d of degree d has the cardinal spline's last piece
    pieces = np.array([[1.0] + [0.0] * degree])
    for d in range(1, degree + 1):
        # piece q of the cardinal spline of degree d, on [q, q + 1] in t = x - q: from two pieces of degree d - 1
        new = np.zeros((d + 1, degree + 1))
        for q in range(d + 1):
            if q < d:
                rise = pieces[q]
                new[q] += (np.append(0.0, rise[:-1]) + q * rise) / d
            if q > 0:
                fall = pieces[q - 1]
                new[q] += ((d + 1 - q) * fall - np.append(0.0, fall[:-1])) / d
        pieces = new
    polynomials = np.zeros((inner + degree, inner, degree + 1))
    for i in range(inner):
        for q in range(degree + 1):
            polynomials[i + degree - q, i] = pieces[q] / step ** np.arange(degree + 1)
    edges = low + step * np.arange(knots)
    return Pieces(edges[1:-1], edges[:-1], polynomials, (low, high))


def natural_splines(knots: np.ndarray) -> Pieces:
    """Cubic splines with values 1 at one knot each and 0 at the others, linear beyond the outer knots. One function per knot."""
    k, h = len(knots), np.diff(knots)
    if k < 3 or (h <= 0).any():
        raise ValueError("a natural spline needs three different knots")
    # second derivatives at inner knots from values at knots
    left, right = np.zeros((k - 2, k - 2)), np.zeros((k - 2, k))
    for i in range(k - 2):
        left[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < k - 2:
            left[i, i + 1] = left[i + 1, i] = h[i + 1] / 6
        right[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
    second = np.vstack([np.zeros(k), np.linalg.solve(left, right), np.zeros(k)])
    polynomials = np.zeros((k, k + 1, 4))
    for f in range(k):
        value, bend = np.eye(k)[f], second[:, f]
        for i in range(k - 1):
            slope = (value[i + 1] - value[i]) / h[i] - h[i] * (2 * bend[i] + bend[i + 1]) / 6
            polynomials[f, i + 1] = value[i], slope, bend[i] / 2, (bend[i + 1] - bend[i]) / (6 * h[i])
        first, last = polynomials[f, 1], polynomials[f, k - 1]
        polynomials[f, 0, :2] = first[:2]
        polynomials[f, k, :2] = value[-1], last[1] + 2 * last[2] * h[-1] + 3 * last[3] * h[-1] ** 2
    return Pieces(np.asarray(knots, float), np.concatenate([knots[:1], knots]), polynomials)


def natural_spline(train: DataFrame, column: str, functions: int = 4) -> Pieces:
    """Natural splines with knots at the ends and at even quantiles of the distinct training values.

    At least max(functions + 1, 8) training rows must have a value.
    """
    from gritstone.operators.quantiles import exact_quantiles

    known = doubles(train, [column])
    if known.limit(max(functions + 1, 8)).count() < max(functions + 1, 8):
        raise ValueError(f"{column} has too few values for a natural spline")
    return natural_splines(np.array(exact_quantiles(known.distinct(), column, [k / (functions - 1) for k in range(functions)])))


@dataclass
class Additive:
    """intercept + one curve per feature, through a logistic function for a binary target."""

    features: list[str]
    curves: list[Pieces]
    intercept: float
    weights: np.ndarray  # of the standardised basis functions, feature after feature
    penalty: float
    used: float  # effective degrees of freedom, the intercept included
    binary: bool

    def linear(self) -> Column:
        return sum((p.column(F.col(c).cast("double")) for c, p in zip(self.features, self.curves, strict=True)), F.lit(self.intercept))

    def predict(self) -> Column:
        return logistic(self.linear()) if self.binary else self.linear()


def _ridge(inside: np.ndarray, moment: np.ndarray, square: float, n: float, penalties: list[float]) -> tuple[np.ndarray, float, float, float]:
    """Weights, penalty, degrees and the cross-validation score of the best penalty, for centred moments."""
    values, vectors = np.linalg.eigh(inside)
    values, turned = np.maximum(values, 0), vectors.T @ moment
    found = []
    for penalty in penalties:
        b = vectors @ (turned / np.maximum(values + penalty, 1e-300))
        used = 1 + (values / np.maximum(values + penalty, 1e-300)).sum()
        rest = max(square - 2 * b @ moment + b @ inside @ b, 0.0)
        found.append((n * rest / max(n - used, 1e-9) ** 2, -penalty, used, b))
    score, penalty, used, b = min(found, key=lambda f: f[:2])
    return b, -penalty, used, score


def additive_splines(table: DataFrame, features: list[str], target: str, binary: bool = False, knots: int = 5, degree: int = 3, penalties: list[float] | None = None, rounds: int = 60) -> Additive:
    """Ridge regression, or logistic regression with a ridge, on B-splines of each feature but the last of each.

    Basis functions are standardised, so one penalty weighs all alike. Of several penalties the one with the least
    generalised cross-validation score n rss / (n - used)^2 is taken, for a binary target on the working response of each
    round; of equal ones the largest. Features must not be constant.
    """
    penalties = sorted(penalties or [10.0**k for k in range(-3, 6)])
    held = doubles(table.select(*features, target), [*features, target]).persist()
    try:
        row = held.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{j}") for j, c in enumerate(features) for k, f in (("low", F.min), ("high", F.max)))).first()
        if not row["n"]:
            raise ValueError("no row is without nulls")
        bases = [b_splines(row[f"low{j}"], row[f"high{j}"], knots, degree) for j in range(len(features))]
        width = knots + degree - 2  # the functions of a basis sum to 1: the last is left out beside the intercept
        size = 1 + width * len(features)

        def basis(x: dict[str, np.ndarray]) -> np.ndarray:
            return np.column_stack([np.ones(len(x[target])), *(b.values(x[c])[:, :width] for c, b in zip(features, bases, strict=True))])

        def moments(at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
            """X'WX, X'Wz and z'Wz; at: the linear predictor's weights for a binary target."""

            def part(x: dict[str, np.ndarray]) -> np.ndarray:
                rows, z, w = basis(x), x[target], np.ones(len(x[target]))
                if at is not None:
                    eta = rows @ at
                    mu = np.clip(1 / (1 + np.exp(-eta)), 1e-9, 1 - 1e-9)
                    w = mu * (1 - mu)
                    z = eta + (x[target] - mu) / w
                return np.concatenate([(rows.T @ (rows * w[:, None])).ravel(), rows.T @ (w * z), [(w * z * z).sum()]])

            sums = block_sums(held, size * size + size + 1, part)
            return sums[: size * size].reshape(size, size), sums[size * size : -1], float(sums[-1])

        whole, cross, square = moments(None)
        n = row["n"]
        mean = whole[0, 1:] / n
        spread = np.sqrt(np.maximum(np.diag(whole)[1:] / n - mean * mean, 0))
        spread = np.where(spread > 1e-12, spread, 1.0)

        def solve(whole: np.ndarray, cross: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray, float, float]:
            total, centre, level = whole[0, 0], whole[0, 1:] / whole[0, 0], cross[0] / whole[0, 0]
            inside = (whole[1:, 1:] - total * np.outer(centre, centre)) / np.outer(spread, spread)
            b, penalty, used, _ = _ridge(inside, (cross[1:] - total * centre * level) / spread, square - total * level * level, n, penalties)
            slopes = b / spread
            return np.append(level - slopes @ centre, slopes), b, penalty, used

        if not binary:
            at, weights, penalty, used = solve(whole, cross, square)
        else:
            rate = cross[0] / n
            if not 0 < rate < 1:
                raise ValueError("the target has one class only")
            at = np.append(np.log(rate / (1 - rate)), np.zeros(size - 1))
            for _ in range(rounds):
                new, weights, penalty, used = solve(*moments(at))
                moved, at = np.abs(new - at).max(), new
                if moved < 1e-9 * max(1.0, np.abs(at).max()):
                    break
            else:
                raise ArithmeticError(f"no convergence in {rounds} rounds")
        curves = [b.combined(np.append(at[1 + j * width : 1 + (j + 1) * width], 0.0)) for j, b in enumerate(bases)]
        return Additive(features, curves, float(at[0]), weights, penalty, used, binary)
    finally:
        held.unpersist()
