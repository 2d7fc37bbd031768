"""Multinomial and elastic-net logistic models by Newton's method on block sums, one job a round.

Features are standardised (mean 0, population deviation 1; a constant feature is only centred) while a model is fitted,
so penalties weigh them alike and sums stay well conditioned; coefficients are given on the features' own scale. Rows with
a null or a value that is not finite count nowhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.distributions import normal_sf
from gritstone.operators.blocks import block_sums, design, doubles
from gritstone.operators.models import Linear

#: Classes a multinomial model may have; its moments grow with their square.
MOST_CLASSES = 100


def standardising(table: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population deviations (1 where there is none) and the number of rows of a table without nulls."""
    row = table.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{j}") for j, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not row["n"]:
        raise ValueError("no row is without nulls")
    mean, spread = (np.array([row[f"{k}_{j}"] for j in range(len(features))], float) for k in "ms")
    return mean, np.where(spread > 0, spread, 1.0), row["n"]


def own_scale(mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The matrix that takes coefficients of standardised features (intercept first) to those of the features themselves."""
    out = np.diag(np.append(1.0, 1 / spread))
    out[0, 1:] = -mean / spread
    return out


@dataclass
class Multinomial:
    features: list[str]
    classes: list
    coefficients: np.ndarray  # a row per class, intercept first
    log_likelihood: float
    covariance: np.ndarray | None = None  # of the rows after the first, one after the other

    def scores(self) -> list[Column]:
        return [sum((F.col(c) * float(b) for c, b in zip(self.features, row[1:], strict=True)), F.lit(float(row[0]))) for row in self.coefficients]

    def probabilities(self) -> list[Column]:
        """One column per class, in the order of `classes`."""
        scores = self.scores()
        most = F.greatest(*scores) if len(scores) > 1 else scores[0]
        raised = [F.exp(s - most) for s in scores]
        total = sum(raised[1:], raised[0])
        return [x / total for x in raised]

    def predict(self) -> Column:
        """The most probable class; of equal ones the first."""
        best, chosen = self.scores()[0], F.lit(self.classes[0])
        for score, name in zip(self.scores()[1:], self.classes[1:], strict=True):
            chosen, best = F.when(score > best, F.lit(name)).otherwise(chosen), F.greatest(best, score)
        return chosen

    def table(self, df: DataFrame) -> DataFrame:
        """class, name, coefficient, std_error, z, p_value; errors of an unpenalised fit, whose first class has none."""
        names, width = ["intercept", *self.features], len(self.features) + 1
        error = np.full(self.coefficients.shape, np.nan)
        if self.covariance is not None:
            error[1:] = np.sqrt(np.maximum(np.diag(self.covariance), 0)).reshape(-1, width)
        rows = []
        for c, row, errors in zip(self.classes, self.coefficients, error, strict=True):
            for n, b, s in zip(names, row.tolist(), errors.tolist(), strict=True):
                known = s > 0
                rows.append((str(c), n, b, s if known else None, b / s if known else None, 2 * normal_sf(abs(b / s)) if known else None))
        return df.sparkSession.createDataFrame(rows, "class string, name string, coefficient double, std_error double, z double, p_value double")

    def importance(self, df: DataFrame) -> DataFrame:
        """feature, mean absolute and mean signed coefficient over the classes."""
        slopes = self.coefficients[:, 1:]
        rows = list(zip(self.features, np.abs(slopes).mean(axis=0).tolist(), slopes.mean(axis=0).tolist(), strict=True))
        return df.sparkSession.createDataFrame(rows, "feature string, importance double, coefficient double")


def _softmax_sums(table: DataFrame, features: list[str], target: str, mean: np.ndarray, spread: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient (class after class) and information at standardised coefficients."""
    classes, width = at.shape
    size = classes * width

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows = design({c: (x[c] - m) / s for c, m, s in zip(features, mean, spread, strict=True)}, features, len(x[target]))
        y = x[target].astype(int)
        score = rows @ at.T
        score -= score.max(axis=1, keepdims=True)
        total = np.exp(score).sum(axis=1)
        p = np.exp(score) / total[:, None]
        apart = -p
        apart[np.arange(len(y)), y] += 1
        information = np.zeros((classes, width, classes, width))
        for a in range(classes):
            for b in range(a, classes):
                block = rows.T @ (rows * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                information[a, :, b, :] = information[b, :, a, :] = block
        likely = (score[np.arange(len(y)), y] - np.log(total)).sum()
        return np.concatenate([[likely], (apart.T @ rows).ravel(), information.ravel()])

    sums = block_sums(table, 1 + size + size * size, part)
    return sums[0], sums[1 : 1 + size], sums[1 + size :].reshape(size, size)


def multinomial_logistic(table: DataFrame, features: list[str], target: str, ridge: float = 0.0, rounds: int = 50) -> Multinomial:
    """P(class) in proportion to exp(intercept + x b) over the target's values, in their order.

    Without a ridge the first class has coefficients 0. With one, half of ridge times the squared slopes of standardised
    features is added for every class, which makes them unique; intercepts then sum to 0. A value that separates
    the classes has no finite fit: without convergence there is an error.
    """
    known = table.where(F.col(target).isNotNull())
    classes = [r[0] for r in known.select(target).distinct().orderBy(target).limit(MOST_CLASSES + 1).collect()]
    if not 2 <= len(classes) <= MOST_CLASSES:
        raise ValueError(f"a target needs 2 to {MOST_CLASSES} classes")
    number = (F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1).cast("double")
    taken, name = {c.lower() for c in features}, "class"
    while name in taken:
        name += "_"
    held = doubles(known.select(*features, number.alias(name)), [*features, name]).persist()
    try:
        mean, spread, n = standardising(held, features)
        width = len(features) + 1
        at = np.zeros((len(classes), width))
        free = np.arange(0 if ridge else width, at.size)
        slope = np.tile(np.append(0.0, np.ones(width - 1)), len(classes))
        last, move = -np.inf, np.zeros(at.size)
        for _ in range(rounds):
            likely, gradient, information = _softmax_sums(held, features, name, mean, spread, at)
            value = likely - ridge / 2 * (slope * at.ravel() ** 2).sum()
            if value < last - 1e-10 * abs(last):
                move /= 2
                at = at - move.reshape(at.shape)
                continue
            last = value
            gradient, information = gradient - ridge * slope * at.ravel(), information + np.diag(ridge * slope)
            inner = information[np.ix_(free, free)]
            move = np.zeros(at.size)
            move[free] = np.linalg.lstsq(inner, gradient[free], rcond=1e-12)[0] if ridge else np.linalg.solve(inner, gradient[free])
            at = at + move.reshape(at.shape)
            if np.abs(move).max() < 1e-9:
                back = own_scale(mean, spread)
                wide = np.kron(np.eye(len(classes) - 1), back)
                return Multinomial(features, classes, at @ back.T, likely, None if ridge else wide @ np.linalg.inv(inner) @ wide.T)
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    finally:
        held.unpersist()


@dataclass
class Path:
    """Fits for falling penalties: their models, how many slopes are not 0, and the mean negative log-likelihood."""

    features: list[str]
    mix: float
    rows: int
    largest: float  # the least penalty at which all slopes are 0
    null_loss: float
    penalties: list[float] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def chosen(self) -> int:
        """The fit with the least BIC, of equal ones the larger penalty."""
        bic = [2 * self.rows * loss + math.log(self.rows) * (1 + np.count_nonzero(m.coefficients[1:])) for loss, m in zip(self.losses, self.models, strict=True)]
        return int(np.argmin(bic))

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(float(p), n, float(b)) for p, m in zip(self.penalties, self.models, strict=True) for n, b in zip(["intercept", *self.features], m.coefficients, strict=True)]
        return df.sparkSession.createDataFrame(rows, "penalty double, name string, coefficient double")


def shrunk_step(gradient: np.ndarray, curve: np.ndarray, at: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, sweeps: int = 10_000) -> np.ndarray:
    """The least of gradient.d + d.curve.d / 2 + lasso |at + d| + ridge (at + d)^2 / 2, as at + d, by coordinate descent.

    Coordinates that are nearly collinear move slowly together; so every few sweeps the equations of those that are not 0
    are solved at once, and the solution is taken if it keeps their signs and the others' conditions hold.
    """
    new, slope = at.copy(), gradient.copy()
    for sweep in range(sweeps):
        if sweep % 10 == 9:
            on = np.flatnonzero((new != 0) | (lasso == 0))
            sign = np.sign(new[on])
            solved = np.zeros(len(at))
            try:
                solved[on] = np.linalg.solve(curve[np.ix_(on, on)] + np.diag(ridge[on]), curve[on] @ at - gradient[on] - lasso[on] * sign)
            except np.linalg.LinAlgError:
                solved[on] = np.nan
            pull = gradient + curve @ (solved - at)
            off = np.setdiff1d(np.arange(len(at)), on)
            if np.isfinite(solved).all() and ((np.sign(solved[on]) == sign) | (lasso[on] == 0)).all() and (np.abs(pull[off]) <= lasso[off] * (1 + 1e-12)).all():
                return solved
        moved = 0.0
        for j in range(len(at)):
            steep = curve[j, j] + ridge[j]
            if steep <= 0:
                continue
            pull = curve[j, j] * new[j] - slope[j]
            want = math.copysign(max(abs(pull) - lasso[j], 0.0), pull) / steep
            if want != new[j]:
                slope += curve[:, j] * (want - new[j])
                moved = max(moved, abs(want - new[j]))
                new[j] = want
        if moved < 1e-13:
            return new
    raise ArithmeticError(f"no convergence in {sweeps} sweeps")


def elastic_net_logistic(table: DataFrame, features: list[str], target: str, mix: float = 0.5, penalties: list[float] | None = None, steps: int = 10, least: float = 1e-3, rounds: int = 50) -> Path:
    """Fits of mean log-loss + penalty (mix |b| + (1 - mix) |b|^2 / 2), b being slopes of standardised features.

    Without given penalties, `steps` of them fall evenly in the logarithm from the largest that lets any slope in to `least`
    times as much (0 < mix). Each fit starts from the one before; a round is one job for loss, gradient and curvature,
    then coordinate descent on their quadratic model at the driver, with halved steps while the objective grows.
    """
    held = doubles(table.select(*features, target), [*features, target]).persist()
    width = len(features) + 1

    def moments(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(x: dict[str, np.ndarray]) -> np.ndarray:
            rows = design({c: (x[c] - m) / s for c, m, s in zip(features, mean, spread, strict=True)}, features, len(x[target]))
            eta, y = rows @ at, x[target]
            p = 1 / (1 + np.exp(-eta))
            loss = np.logaddexp(0.0, eta) - y * eta
            return np.concatenate([[loss.sum()], rows.T @ (p - y), (rows.T @ (rows * (p * (1 - p))[:, None])).ravel()])

        sums = block_sums(held, 1 + width + width * width, part) / n
        return sums[0], sums[1 : 1 + width], sums[1 + width :].reshape(width, width)

    try:
        mean, spread, n = standardising(held, features)
        rate = held.agg(F.avg(target)).first()[0]
        if not 0 < rate < 1:
            raise ValueError("the target has one class only")
        at = np.append(math.log(rate / (1 - rate)), np.zeros(width - 1))
        state = moments(at)
        largest = float(np.abs(state[1][1:]).max() / max(mix, 1e-3))
        path = Path(features, mix, n, largest, state[0])
        back, inner = own_scale(mean, spread), np.append(0.0, np.ones(width - 1))
        for penalty in penalties if penalties is not None else largest * np.logspace(0, math.log10(least), steps):
            lasso, ridge = penalty * mix * inner, penalty * (1 - mix) * inner
            cost = lambda b, loss: loss + (lasso * np.abs(b) + ridge * b * b / 2).sum()  # noqa: B023, E731
            for _ in range(rounds):
                loss, gradient, curve = state
                # how far the subgradient nearest to 0 is from 0
                pull = gradient + ridge * at
                off = np.where(at != 0, np.abs(pull + lasso * np.sign(at)), np.maximum(np.abs(pull) - lasso, 0))
                if off.max() < 1e-10:
                    break
                move = shrunk_step(gradient, curve, at, lasso, ridge) - at
                best = cost(at, loss)
                for _ in range(30):
                    state = moments(at + move)
                    if cost(at + move, state[0]) <= best + 1e-13:
                        break
                    move = move / 2
                at = at + move
                if np.abs(move).max() < 1e-12:
                    break
            else:
                raise ArithmeticError(f"no convergence in {rounds} rounds")
            path.penalties.append(float(penalty))
            path.models.append(Linear(features, back @ at, None, "logit"))
            path.losses.append(float(state[0]))
        return path
    finally:
        held.unpersist()
