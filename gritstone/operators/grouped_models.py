"""Models of rows that come in groups: a random intercept by likelihood, and a logistic marginal model with a sandwich.

Rows are summed per group with partial sums before the shuffle, so a group of half of all rows is one row like any other.
Everything after works on the table of groups, whose sums over groups the driver sees. A null group is a group; rows with
a null or a value that is not finite in any other column count nowhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.distributions import normal_sf
from gritstone.operators.blocks import block_sums, doubles
from gritstone.operators.models import Linear, gram
from gritstone.operators.penalised import own_scale, standardising


#: Rows of a group up to which they are kept together in one partition, and rows of a partition.
TOGETHER = 1_000_000


def _standardised(table: DataFrame, features: list[str], target: str, group: str) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """g, x0 (ones), x1, ... (standardised features) and y, persisted, with the means, deviations and row count."""
    held, mean, spread, n = _whole_rows(table, features, target, group)
    return held.persist(), mean, spread, n


def _whole_rows(table: DataFrame, features: list[str], target: str, group: str) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    names = [f"x{j}" for j in range(1, len(features) + 1)]
    raw = table.select(F.struct(F.col(group)).alias("g"), *(F.col(c).cast("double").alias(n) for c, n in zip([*features, target], [*names, "y"], strict=True)))
    finite = F.lit(True)
    for n in (*names, "y"):
        finite = finite & (F.abs(n) < float("inf"))
    raw = raw.where(finite)
    mean, spread, n = standardising(raw, names)
    held = raw.select("g", F.lit(1.0).alias("x0"), *(((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(names, mean, spread, strict=True)), "y")
    return held, mean, spread, n


@dataclass
class MixedEffects:
    """y = intercept + x b + u(group) + e."""

    features: list[str]
    coefficients: np.ndarray  # intercept first
    covariance: np.ndarray
    group_variance: float
    residual_variance: float
    log_likelihood: float
    restricted: bool
    groups: DataFrame  # g (a struct of the group), n, mean residual as `apart`

    def predict(self) -> Column:
        """The fixed part, which is what an unknown group gets."""
        return Linear(self.features, self.coefficients).linear()

    def effects(self) -> DataFrame:
        """group, n and its predicted intercept: the mean residual, shrunk by the group's size."""
        ratio = self.group_variance / self.residual_variance
        n = F.col("n")
        return self.groups.select(F.col("g").getField(self.groups.schema["g"].dataType.names[0]).alias("group"), n, (F.col("apart") * n * ratio / (1 + n * ratio)).alias("effect"))

    def table(self, df: DataFrame) -> DataFrame:
        return Linear(self.features, self.coefficients, self.covariance).table(df)


def mixed_effects(table: DataFrame, features: list[str], target: str, group: str, restricted: bool = False, points: int = 8, tolerance: float = 1e-11) -> MixedEffects:
    """A random intercept per group, by maximum or restricted likelihood over the ratio of the two variances.

    With a group's size n, sums s and residual sum r, the inverse covariance of its rows is I - w 11' times the residual
    precision, w = ratio / (1 + n ratio). So the likelihood and its slope need, beside the moments of all rows, sums over groups of w and
    1 / (1 + n ratio)^2 times products of group sums. One job gives them at `points` ratios; the root of the slope is
    bracketed ever more closely until the bracket's logarithm is below `tolerance`. The ratio is 0 where the slope is not
    positive there.
    """
    held, mean, spread, n = _standardised(table, features, target, group)
    p = len(features) + 1
    names = [f"x{j}" for j in range(p)]
    try:
        g0, v0, yy, _ = gram(held, names[1:], F.col("y"))
        whole = np.zeros((p + 1, p + 1))  # moments of (x, y) over all rows
        whole[:p, :p], whole[:p, p], whole[p, :p], whole[p, p] = g0, v0, v0, yy
        sums = held.groupBy("g").agg(*(F.sum(c).alias(c) for c in (*names, "y"))).persist()
        # x0 is a group's size
        size = (p + 1) ** 2

        def moments(ratios: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
            def part(x: dict[str, np.ndarray]) -> np.ndarray:
                rows, out = np.column_stack([x[c] for c in (*names, "y")]), []
                for t in ratios:
                    grown = 1 + x["x0"] * t
                    out += [(rows.T @ (rows * (t / grown)[:, None])).ravel(), (rows.T @ (rows / (grown * grown)[:, None])).ravel(), [np.log(grown).sum(), (x["x0"] / grown).sum()]]
                return np.concatenate(out)

            cells = block_sums(sums.drop("g"), len(ratios) * (2 * size + 2), part).reshape(len(ratios), -1)
            return [(whole - c[:size].reshape(p + 1, -1), c[size : 2 * size].reshape(p + 1, -1), float(c[-2]), float(c[-1])) for c in cells]

        def fit(state: tuple) -> tuple[np.ndarray, float, float, float]:
            """Coefficients, residual variance, log-likelihood and its slope by the ratio."""
            inside, slopes, logs, traces = state
            b = np.linalg.solve(inside[:p, :p], inside[:p, p])
            away = np.append(-b, 1.0)
            rss = float(away @ inside @ away)
            free = n - p if restricted else n
            variance = rss / free
            # the derivative of rss is minus the weighted sum of squared residual sums
            slope = 0.5 * float(away @ slopes @ away) / variance - 0.5 * traces
            value = -0.5 * (free * math.log(2 * math.pi * variance) + free + logs)
            if restricted:
                value -= 0.5 * np.linalg.slogdet(inside[:p, :p])[1]
                slope += 0.5 * float(np.trace(np.linalg.solve(inside[:p, :p], slopes[:p, :p])))
            return b, variance, value, slope

        low, high, ratio = math.log(1e-8), math.log(1e8), 0.0
        found = moments(np.array([0.0]))[0]
        if fit(found)[3] > 0:
            while high - low > tolerance:
                grid = np.linspace(low, high, points + 2)[1:-1]
                rising = [fit(s)[3] > 0 for s in moments(np.exp(grid))]
                # the slope falls through 0 between the last rising point and the next
                last = max((k for k, up in enumerate(rising) if up), default=-1)
                low, high = grid[last] if last >= 0 else low, grid[last + 1] if last + 1 < points else high
                if not low < high or last + 1 < points and grid[last + 1] == high == low:
                    break
            ratio = math.exp((low + high) / 2)
            found = moments(np.array([ratio]))[0]
        b, variance, value, _ = fit(found)
        back = own_scale(mean, spread)
        away = sum((F.col(c) * float(-x) for c, x in zip(names, b, strict=True)), F.col("y"))
        groups = sums.select("g", F.col("x0").cast("bigint").alias("n"), (away / F.col("x0")).alias("apart"))
        return MixedEffects(features, back @ b, back @ (np.linalg.inv(found[0][:p, :p]) * variance) @ back.T, ratio * variance, variance, value, restricted, groups)
    finally:
        held.unpersist()


def _by_group(rows: DataFrame, sizes: DataFrame | None, n: int) -> list[DataFrame]:
    """The rows dealt by group and persisted, and those of groups above TOGETHER, if `sizes` are given, as they come."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TOGETHER))
    if sizes is None:
        return [rows.repartition(parts, "g").persist()]
    large = F.broadcast(sizes.where(F.col("count") > TOGETHER).select("g"))  # at most n / TOGETHER groups
    return [rows.join(large, "g", "left_anti").repartition(parts, "g").persist(), rows.join(large, "g", "left_semi").persist()]


@dataclass
class Marginal:
    """A logistic model of the mean with a working correlation between the rows of a group."""

    features: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray  # sandwich
    naive: np.ndarray  # as if the working correlation held
    correlation: float
    dispersion: float
    groups: int

    def predict(self) -> Column:
        return Linear(self.features, self.coefficients, None, "logit").predict()

    def table(self, df: DataFrame) -> DataFrame:
        """name, coefficient, std_error (robust), z, p_value, naive_error, odds_ratio."""
        rows = []
        for c, b, s, w in zip(["intercept", *self.features], self.coefficients.tolist(), np.sqrt(np.diag(self.covariance)).tolist(), np.sqrt(np.diag(self.naive)).tolist(), strict=True):
            rows.append((c, b, s, b / s, 2 * normal_sf(abs(b / s)), w, math.exp(b) if b < 700 else math.inf))
        return df.sparkSession.createDataFrame(rows, "name string, coefficient double, std_error double, z double, p_value double, naive_error double, odds_ratio double")


def estimating_equations(table: DataFrame, features: list[str], target: str, group: str, exchangeable: bool = True, rounds: int = 60) -> Marginal:
    """Generalised estimating equations with a logit link; rows of a group are exchangeable or taken as independent.

    Rows are dealt by group once and kept, so that a round sums groups where they lie and shuffles nothing; groups of more
    than TOGETHER rows are kept apart, as they come, and their partial sums shuffled. A round is one job: residuals at the
    present coefficients give the dispersion and the correlation that the next round uses, and the step. A group's inverse
    working correlation is (I - c 11') / (1 - a), c = a / (1 + (n - 1) a), so that its share of the equations and of the
    sandwich follows from its sums. Dispersion and correlation are divided by the rows and the pairs of rows, less the
    number of coefficients.
    """
    rows, mean, spread, n = _whole_rows(table, features, target, group)
    p = len(features) + 1
    names = [f"x{j}" for j in range(p)]
    sizes = rows.groupBy("g").count()
    pairs, groups, most = sizes.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.count("*"), F.max("count")).first()
    pairs, groups = float(pairs), int(groups)
    kept = _by_group(rows, sizes if most > TOGETHER else None, n)
    tied = exchangeable and pairs > p
    at, alpha, cells = np.zeros(p), 0.0, p * p

    zs = [f"z{j}" for j in range(p)]
    crossed = {f"q{i}_{j}": F.col(f"z{i}") * F.col(f"z{j}") for i in range(p) for j in range(i, p)}

    def group_sums(held: DataFrame, mu: Column) -> DataFrame:
        scaled = held.select("g", F.sqrt(mu * (1 - mu)).alias("d"), mu.alias("mu"), *names, "y")
        rows = scaled.select("g", ((F.col("y") - F.col("mu")) / F.col("d")).alias("r"), *((F.col(c) * F.col("d")).alias(f"z{j}") for j, c in enumerate(names)))
        return rows.groupBy("g").agg(
            F.count("*").cast("double").alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"), *(F.sum(z).alias(z) for z in zs),
            *(F.sum(F.col(z) * F.col("r")).alias(f"v{j}") for j, z in enumerate(zs)), *(F.sum(c).alias(q) for q, c in crossed.items()),
        ).drop("g")

    def state(at: np.ndarray, alpha: float) -> tuple[np.ndarray, ...]:
        eta = sum((F.col(c) * float(b) for c, b in zip(names, at, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))

        def part(x: dict[str, np.ndarray]) -> np.ndarray:
            c = alpha / (1 + (x["n"] - 1) * alpha)
            z, v = np.column_stack([x[k] for k in zs]), np.column_stack([x[f"v{j}"] for j in range(p)])
            score = (v - z * (c * x["r"])[:, None]) / (1 - alpha)
            inside = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    inside[i, j] = inside[j, i] = x[f"q{i}_{j}"].sum()
            inside = (inside - z.T @ (z * c[:, None])) / (1 - alpha)
            return np.concatenate([[x["rr"].sum(), ((x["r"] ** 2 - x["rr"]) / 2).sum()], score.sum(axis=0), inside.ravel(), (score.T @ score).ravel()])

        by = reduce(DataFrame.unionByName, (group_sums(held, mu) for held in kept))
        sums = block_sums(by, 2 + p + 2 * cells, part)
        return sums[0], sums[1], sums[2 : 2 + p], sums[2 + p : 2 + p + cells].reshape(p, p), sums[2 + p + cells :].reshape(p, p)

    try:
        for _ in range(rounds):
            squares, products, score, inside, outer = state(at, alpha)
            dispersion = squares / (n - p)
            following = products / dispersion / (pairs - p) if tied else 0.0
            move = np.linalg.solve(inside, score)
            settled = np.abs(move).max() < 1e-9 and abs(following - alpha) < 1e-10
            if settled:
                back, inverse = own_scale(mean, spread), np.linalg.inv(inside)
                return Marginal(features, back @ at, back @ inverse @ outer @ inverse @ back.T, back @ inverse @ back.T * dispersion, alpha, dispersion, groups)
            at, alpha = at + move, following
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    finally:
        for held in kept:
            held.unpersist()
