"""Models fitted by Newton's method on a row's likelihood: Tobit, beta, ordered logit, Cox; and their compositions.

A model gives the gradient of its rows' log-likelihood as a NumPy function of the parameters and a batch of columns. One
job sums it, batch by batch, at the parameters and a small step to both sides of each; the differences are the Hessian.
The driver sees k (2k + 1) sums. Rows with a null in any column count nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.distributions import normal_sf
from gritstone.functions.scalars import clipped_between, logistic
from gritstone.operators.models import Linear, iteratively_reweighted, ordinary_least_squares

#: Parameters and columns -> one row of k numbers per row of the batch.
Gradient = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


@dataclass
class Fit:
    names: list[str]
    values: np.ndarray
    covariance: np.ndarray

    def __getitem__(self, name: str) -> float:
        return float(self.values[self.names.index(name)])

    def table(self, df: DataFrame) -> DataFrame:
        """name, coefficient, std_error, z, p_value."""
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        rows = [(n, float(b), float(s), float(b / s) if s else None, 2 * normal_sf(abs(b / s)) if s else None) for n, b, s in zip(self.names, self.values, se, strict=True)]
        return df.sparkSession.createDataFrame(rows, "name string, coefficient double, std_error double, z double, p_value double")


def _summed(table: DataFrame, points: np.ndarray, gradient: Gradient) -> np.ndarray:
    """The gradient's sums at each point, points x k."""
    names = table.columns

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(points.shape)
        for batch in batches:
            held = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            total += [gradient(p, held).sum(axis=0) for p in points]
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "part"])

    rows = table.mapInArrow(sums, "cell bigint, part double").groupBy("cell").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(points.size)
    for r in rows:
        out[r["cell"]] = r["total"]
    return out.reshape(points.shape)


def newton(table: DataFrame, names: list[str], start: np.ndarray, gradient: Gradient, rounds: int = 50, step: float = 1e-5) -> Fit:
    """The root of the summed gradient; steps are halved while the gradient's norm grows. Without convergence an error."""
    k, held = len(names), table.persist()
    try:
        at, last, move = np.asarray(start, float), np.inf, None
        for _ in range(rounds):
            points = np.stack([at, *(at + s * step * e for e in np.eye(k) for s in (1, -1))])
            sums = _summed(held, points, gradient)
            size = np.abs(sums[0]).max()
            if move is not None and not size <= last * (1 + 1e-9) and np.abs(move).max() > 1e-8:
                move = move / 2
                at = at - move
                continue
            hessian = (sums[1::2] - sums[2::2]) / (2 * step)
            hessian = (hessian + hessian.T) / 2
            last, move = size, -np.linalg.solve(hessian, sums[0])
            if np.abs(move).max() < 1e-8 * max(1.0, np.abs(at).max()):
                return Fit(names, at, np.linalg.inv(-hessian))
            at = at + move
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    finally:
        held.unpersist()


def _whole(table: DataFrame, features: list[str], target: str) -> DataFrame:
    return table.select(*(F.col(c).cast("double").alias(c) for c in [*features, target])).na.drop()


def _linear(features: list[str], values: np.ndarray) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(features, values[1:], strict=True)), F.lit(float(values[0])))


_erfc = np.vectorize(math.erfc, otypes=[float])


def _mills(z: np.ndarray) -> np.ndarray:
    """Density over distribution function of a standard normal; in the far lower tail their asymptotic ratio."""
    below = 0.5 * _erfc(-z / math.sqrt(2))
    return np.where(z < -30, -z, np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(below, 1e-300))


def _design(features: list[str], x: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([np.ones(len(x[features[0]])), *(x[c] for c in features)])


def tobit(table: DataFrame, features: list[str], target: str, low: float | None = 0.0, high: float | None = None) -> Fit:
    """Normal errors, the target censored at `low` and `high`; parameters are intercept, features and log_sigma."""
    whole, k = _whole(table, features, target), len(features) + 1

    def gradient(p: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
        rows, y, sigma = _design(features, x), x[target], np.exp(p[k])
        eta = rows @ p[:k]
        z = (y - eta) / sigma
        slope, spread = z / sigma, z * z - 1
        if low is not None:
            at = (low - eta) / sigma
            slope, spread = np.where(y <= low, -_mills(at) / sigma, slope), np.where(y <= low, -_mills(at) * at, spread)
        if high is not None:
            at = (high - eta) / sigma
            slope, spread = np.where(y >= high, _mills(-at) / sigma, slope), np.where(y >= high, _mills(-at) * at, spread)
        return np.column_stack([rows * slope[:, None], spread])

    first = ordinary_least_squares(whole, features, target)
    spread = whole.agg(F.stddev_pop(F.col(target) - first.linear())).first()[0]
    return newton(whole, ["intercept", *features, "log_sigma"], np.append(first.coefficients, math.log(spread)), gradient)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to an argument above 6, then its asymptotic series (error below 1e-10)."""
    y = x + 6
    tail = 1 / (y * y)
    series = np.log(y) - 0.5 / y - tail * (1 / 12 - tail * (1 / 120 - tail * (1 / 252 - tail * (1 / 240 - tail / 132))))
    return series - sum(1 / (x + k) for k in range(6))


def beta_regression(table: DataFrame, features: list[str], target: str, floor: float = 1e-6) -> Fit:
    """A beta target with logit mean and constant precision; parameters are intercept, features and log_precision."""
    whole, k = _whole(table, features, target).withColumn(target, clipped_between(target, floor, 1 - floor)), len(features) + 1

    def gradient(p: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
        rows, y, phi = _design(features, x), x[target], np.exp(p[k])
        mu = 1 / (1 + np.exp(-rows @ p[:k]))
        a, b = mu * phi, (1 - mu) * phi
        gap = np.log(y / (1 - y)) - digamma(a) + digamma(b)
        spread = phi * (mu * gap + np.log(1 - y) - digamma(b) + digamma(np.full(1, phi)))
        return np.column_stack([rows * (phi * gap * mu * (1 - mu))[:, None], spread])

    first = iteratively_reweighted(whole, features, target)
    mu = first.predict()
    # the precision by moments: the variance of a beta is mu (1 - mu) / (1 + precision)
    spread, rest = whole.agg(F.avg(mu * (1 - mu)), F.avg((F.col(target) - mu) * (F.col(target) - mu))).first()
    start = math.log(max(spread / max(rest, 1e-12) - 1, 0.1))
    return newton(whole, ["intercept", *features, "log_precision"], np.append(first.coefficients, start), gradient)


def ordered_logit(table: DataFrame, features: list[str], target: str, levels: int) -> Fit:
    """P(y <= j) = logistic(cut_j - x b) for levels 0..levels - 1; parameters are the cuts, then the features."""
    whole, cuts = _whole(table, features, target), levels - 1

    def gradient(p: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
        rows, y = _design(features, x)[:, 1:], x[target].astype(int)
        every = np.arange(len(y))
        upto = np.column_stack([np.zeros(len(y)), 1 / (1 + np.exp(-(p[:cuts] - (rows @ p[cuts:])[:, None]))), np.ones(len(y))])
        steep = upto * (1 - upto)
        chance = upto[every, y + 1] - upto[every, y]
        each = np.zeros((len(y), levels + 1))
        each[every, y + 1] = steep[every, y + 1] / chance
        each[every, y] = -steep[every, y] / chance
        slope = (steep[every, y] - steep[every, y + 1]) / chance
        return np.column_stack([each[:, 1:-1], rows * slope[:, None]])

    counts = {int(r[target]): r["count"] for r in whole.groupBy(target).count().collect()}
    below = np.cumsum([counts.get(j, 0) for j in range(cuts)]) / max(sum(counts.values()), 1)
    return newton(whole, [*(f"cut_{j}" for j in range(cuts)), *features], np.concatenate([np.log(below / (1 - below)), np.zeros(len(features))]), gradient)


def cox(table: DataFrame, features: list[str], duration: str, event: str, rounds: int = 50) -> Fit:
    """Proportional hazards by Breslow's partial likelihood: one row per distinct duration carries the sums of its risk set.

    Durations are to be whole periods or otherwise rounded by the caller, so that their number stays small.
    """
    whole = _whole(table, [*features, duration], event).persist()
    k, at = len(features), np.zeros(len(features))
    xs = [F.col(c) for c in features]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    later = Window.orderBy(F.desc(duration)).rowsBetween(Window.unboundedPreceding, 0)
    try:
        for _ in range(rounds):
            risk = F.exp(sum((x * float(b) for x, b in zip(xs, at, strict=True)), F.lit(0.0)))
            sums = {"s": risk} | {f"s{i}": risk * x for i, x in enumerate(xs)} | {f"s{i}_{j}": risk * xs[i] * xs[j] for i, j in pairs}
            died = {"d": F.col(event)} | {f"d{i}": F.col(event) * x for i, x in enumerate(xs)}
            held = whole.groupBy(duration).agg(*(F.sum(c).alias(n) for n, c in {**sums, **died}.items()))
            held = held.select("d", *died.keys() - {"d"}, *(F.sum(n).over(later).alias(n) for n in sums))
            mean = [F.col(f"s{i}") / F.col("s") for i in range(k)]
            row = held.agg(*(F.sum(F.col(f"d{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(k)), *(F.sum(F.col("d") * (F.col(f"s{i}_{j}") / F.col("s") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in pairs)).first()
            information = np.zeros((k, k))
            for i, j in pairs:
                information[i, j] = information[j, i] = row[f"h{i}_{j}"]
            move = np.linalg.solve(information, np.array([row[f"g{i}"] for i in range(k)]))
            at = at + move
            if np.abs(move).max() < 1e-10:
                return Fit(features, at, np.linalg.inv(information))
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    finally:
        whole.unpersist()


@dataclass
class Inflated:
    """A target on [0, 1] with lumps at both ends: the chances of either, and a beta in between."""

    zero: Linear
    one: Linear
    inner: Fit
    features: list[str]

    def predict(self) -> Column:
        """E y = (1 - p0) (p1 + (1 - p1) mu), p1 being the chance of one among those that are not zero."""
        mu = logistic(_linear(self.features, self.inner.values[: len(self.features) + 1]))
        p1 = self.one.predict()
        return (1 - self.zero.predict()) * (p1 + (1 - p1) * mu)


def zero_one_inflated_beta(table: DataFrame, features: list[str], target: str) -> Inflated:
    whole, y = _whole(table, features, target), F.col(target)
    ends = whole.withColumns({"is_zero__": (y <= 0).cast("double"), "is_one__": (y >= 1).cast("double")})
    return Inflated(
        iteratively_reweighted(ends, features, "is_zero__", ridge=1e-6, rounds=200),
        iteratively_reweighted(ends.where(y > 0), features, "is_one__", ridge=1e-6, rounds=200),
        beta_regression(whole.where((y > 0) & (y < 1)), features, target),
        features,
    )


@dataclass
class TwoStage:
    """Whether there is a loss at all, and how large it is then."""

    incidence: Linear
    severity: Linear
    floor: float
    high: float

    def predict(self) -> Column:
        return self.incidence.predict() * clipped_between(self.severity.predict(), self.floor, self.high)


def two_stage_loss(table: DataFrame, features: list[str], target: str, threshold: float = 0.0, low: float = 0.0, high: float = 1.0) -> TwoStage:
    """Logistic regression on target > threshold, then least squares on the rows above it."""
    whole = _whole(table, features, target).withColumn("is_loss__", (F.col(target) > threshold).cast("double"))
    return TwoStage(iteratively_reweighted(whole, features, "is_loss__"), ordinary_least_squares(whole.where("is_loss__ = 1"), features, target), low, high)


def discrete_hazard(table: DataFrame, features: list[str], event: str, entity: str, order: list[str]) -> tuple[Linear, DataFrame]:
    """A logistic model of the event in each period of an entity, with the period and its square as features.

    Returns the model and the table with ``period`` and ``period_squared``.
    """
    period = F.row_number().over(Window.partitionBy(entity).orderBy(*order)).cast("double")
    held = table.withColumn("period", period).withColumn("period_squared", F.col("period") * F.col("period"))
    return iteratively_reweighted(held, [*features, "period", "period_squared"], event), held
