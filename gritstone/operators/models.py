"""Regression and scorecard models from Spark aggregates, and tree families from pyspark.ml.

A fit is one aggregate per iteration: the sums of X'WX and X'Wz over all rows, solved with NumPy at the driver (k x k
numbers). A fitted linear model is a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.distributions import normal_sf
from gritstone.functions.scalars import clipped_between, logistic, normal_cdf, normal_cdf_array
from gritstone.operators.blocks import block_sums, design


@dataclass
class Linear:
    features: list[str]
    coefficients: np.ndarray  # intercept first
    covariance: np.ndarray | None = None
    link: str = "identity"
    intercept: bool = True

    def linear(self) -> Column:
        first, slopes = (self.coefficients[0], self.coefficients[1:]) if self.intercept else (0.0, self.coefficients)
        return sum((F.col(c) * float(b) for c, b in zip(self.features, slopes, strict=True)), F.lit(float(first)))

    def predict(self) -> Column:
        return self.mean(self.linear())

    def mean(self, eta: Column) -> Column:
        """The mean at a linear predictor."""
        if self.link == "logit":
            return logistic(eta)
        if self.link == "probit":
            return normal_cdf(eta)
        return F.exp(eta) if self.link == "log" else eta

    def table(self, df: DataFrame) -> DataFrame:
        """name, coefficient, standard error, z, p."""
        se = np.sqrt(np.diag(self.covariance)) if self.covariance is not None else np.full(len(self.coefficients), np.nan)
        rows = [(n, float(b), float(s), float(b / s) if s else None, 2 * normal_sf(abs(b / s)) if s else None) for n, b, s in zip(["intercept"] * self.intercept + self.features, self.coefficients, se, strict=True)]
        return df.sparkSession.createDataFrame(rows, "name string, coefficient double, std_error double, z double, p_value double")


#: Features up to which moments are sums in generated code; their number grows with the square, so more features are summed
#: in blocks by NumPy.
WIDE = 20


def gram(table: DataFrame, features: list[str], response: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'WX, X'Wy, y'Wy and n over rows without nulls, in one job: k(k+3)/2 sums."""
    named = table.where(response.isNotNull()).na.drop(subset=features)
    # a projection of its own, so that response and weight are computed once a row, not once a sum
    whole = named.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features, 1)), response.alias("y"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    k, y, w = len(features) + 1, F.col("y"), F.col("w")
    if len(features) > WIDE:
        names = [f"x{i}" for i in range(1, k)]

        def part(x: dict[str, np.ndarray]) -> np.ndarray:
            rows = np.column_stack([design(x, names), x["y"]])
            return np.append((rows.T @ (rows * x["w"][:, None])).ravel(), len(rows))

        sums = block_sums(whole, (k + 1) ** 2 + 1, part)
        both = sums[:-1].reshape(k + 1, k + 1)
        return both[:k, :k].copy(), both[:k, k].copy(), float(both[k, k]), int(sums[-1])
    xs = [F.lit(1.0), *(F.col(f"x{i}") for i in range(1, k))]
    cells = {f"g_{i}_{j}": F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)} | {f"v_{i}": F.sum(w * xs[i] * y) for i in range(k)}
    row = whole.agg(F.count("*").alias("n"), F.sum(w * y * y).alias("yy"), *(c.alias(n) for n, c in cells.items())).first()
    g, v = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        v[i] = row[f"v_{i}"] or 0.0
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    return g, v, row["yy"] or 0.0, row["n"]


def ordinary_least_squares(table: DataFrame, features: list[str], target: str, ridge: float = 0.0) -> Linear:
    g, v, yy, n = gram(table, features, F.col(target).cast("double"))
    penalty = np.diag([0.0, *[ridge] * len(features)])
    b = np.linalg.solve(g + penalty, v)
    sse = max(yy - 2 * b @ v + b @ g @ b, 0.0)
    return Linear(features, b, np.linalg.inv(g + penalty) * sse / max(n - len(b), 1))


def iteratively_reweighted(table: DataFrame, features: list[str], target: str, family: str = "binomial", ridge: float = 0.0, rounds: int = 25, dispersion: float = 1.0, power: float = 1.5) -> Linear:
    """Binomial (also fractional targets), probit, Poisson, gamma, negative-binomial and Tweedie models by Fisher scoring.

    dispersion belongs to the negative binomial, power (of the mean in the variance) to Tweedie. The source is read once
    and kept while the fit runs. Coefficients that still move after `rounds`, as where the classes are separable, are an error.
    """
    table = table.select(*features, target).persist()
    try:
        return _scored(table, features, target, family, ridge, rounds, dispersion, power)
    finally:
        table.unpersist()


def _scored(table: DataFrame, features: list[str], target: str, family: str, ridge: float, rounds: int, dispersion: float, power: float) -> Linear:
    y = F.col(target).cast("double")
    model = Linear(features, np.zeros(len(features) + 1), None, {"binomial": "logit", "probit": "probit"}.get(family, "log"))
    if family not in ("binomial", "probit"):
        model.coefficients[0] = math.log(max(table.agg(F.avg(y)).first()[0] or 1e-9, 1e-9))
    for _ in range(rounds):
        eta, mu = model.linear(), model.predict()
        if family == "binomial":
            mu = clipped_between(mu, 1e-9, 1 - 1e-9)
            slope = mu * (1 - mu)
            w, z = slope * slope / (mu * (1 - mu)), eta + (y - mu) / slope
        elif family != "probit":
            w = {"poisson": mu, "gamma": F.lit(1.0), "negative_binomial": mu / (1 + dispersion * mu), "tweedie": F.pow(mu, F.lit(2 - power))}[family]
            z = eta + (y - mu) / mu
        g, v = _probit_moments(table, features, y, model.coefficients) if family == "probit" else gram(table, features, z, w)[:2]
        g = g + np.diag([0.0, *[ridge] * len(features)])
        new = np.linalg.solve(g, v)
        moved = np.abs(new - model.coefficients).max()
        model.coefficients, model.covariance = new, np.linalg.inv(g)
        if moved < 1e-9 * max(1.0, np.abs(new).max()):
            return model
    raise ArithmeticError(f"no convergence in {rounds} rounds: the last moved a coefficient by {moved}")


def _probit_moments(table: DataFrame, features: list[str], y: Column, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wz of a round of scoring; the distribution function is NumPy's work, a batch at once."""
    names, k = [f"x{i}" for i in range(1, len(features) + 1)], len(features) + 1

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows = design(x, names)
        eta = rows @ b
        mu = np.clip(normal_cdf_array(eta), 1e-9, 1 - 1e-9)
        slope = np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
        weighted = rows * (slope * slope / (mu * (1 - mu)))[:, None]
        return np.append((weighted.T @ rows).ravel(), weighted.T @ (eta + (x["y"] - mu) / slope))

    whole = table.na.drop(subset=features).where(y.isNotNull()).select(*(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)), y.alias("y"))
    sums = block_sums(whole, k * k + k, part)
    return sums[: k * k].reshape(k, k), sums[k * k :]


def accelerated_failure_time(table: DataFrame, features: list[str], duration: str) -> Linear:
    """Least squares on the log duration."""
    fitted = ordinary_least_squares(table.where(F.col(duration) > 0).withColumn("__log", F.log(duration)), features, "__log")
    return Linear(features, fitted.coefficients, fitted.covariance, "log")


def within_entity(table: DataFrame, features: list[str], target: str, entity: str) -> Linear:
    """Panel regression with entity effects: least squares on deviations from entity means.

    There is no intercept; each entity's mean takes a degree of freedom. Rows with a null in any column count nowhere.
    """
    columns = [*features, target]
    whole = table.na.drop(subset=columns)
    means = whole.groupBy(entity).agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    apart = whole.join(means, entity).select(entity, *((F.col(c) - F.col(f"__{c}")).alias(c) for c in columns))
    g, v, yy, n = gram(apart, features, F.col(target).cast("double"))
    g, v, entities = g[1:, 1:], v[1:], means.count()
    b = np.linalg.solve(g, v)
    sse = max(yy - b @ v, 0.0)
    return Linear(features, b, np.linalg.inv(g) * sse / max(n - entities - len(b), 1), intercept=False)


def fit_by_segment(table: DataFrame, features: list[str], target: str, segment: str, min_rows: int = 30) -> DataFrame:
    """One-job least squares for many segments of one feature: segment, n, intercept, slope; small segments are left out."""
    x = features[0]
    return table.groupBy(segment).agg(F.count("*").alias("n"), F.regr_intercept(target, x).alias("intercept"), F.regr_slope(target, x).alias("slope")).where(F.col("n") >= min_rows)


def quantile_regression(table: DataFrame, features: list[str], target: str, q: float, rounds: int = 200) -> Linear:
    """Pinball loss by reweighted least squares; an error if the coefficients still move after `rounds`."""
    model = ordinary_least_squares(table, features, target)
    for _ in range(rounds):
        e = F.col(target) - model.linear()
        w = F.when(e >= 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(1e-4))
        g, v, _, _ = gram(table, features, F.col(target).cast("double"), w)
        new = np.linalg.solve(g, v)
        moved = np.abs(new - model.coefficients).max()
        model = Linear(features, new)
        if moved < 1e-5:
            return model
    raise ArithmeticError(f"no convergence in {rounds} rounds: the last moved a coefficient by {moved}")


@dataclass
class Scorecard:
    """factor = PDO / ln 2; points of a bin = -factor * coefficient * woe."""

    base_score: float = 600.0
    base_odds: float = 50.0
    points_to_double: float = 20.0

    @property
    def factor(self) -> float:
        return self.points_to_double / math.log(2)

    def offset(self, intercept: float) -> float:
        return self.base_score - self.factor * math.log(self.base_odds) - self.factor * intercept

    def points(self, model: Linear) -> dict[str, Column]:
        return {c: -self.factor * float(b) * F.col(c) for c, b in zip(model.features, model.coefficients[1:], strict=True)}

    def score(self, model: Linear) -> Column:
        return sum(self.points(model).values(), F.lit(self.offset(float(model.coefficients[0]))))

    def reasons(self, model: Linear, k: int = 3) -> Column:
        """Names of the k features with the fewest points, ties by name."""
        held = F.array_sort(F.array(*(F.struct(p.alias("points"), F.lit(c).alias("name")) for c, p in self.points(model).items())))
        return F.transform(F.slice(held, 1, k), lambda x: x["name"])


def tree_model(table: DataFrame, features: list[str], target: str, kind: str = "decision_tree", classify: bool = True, **options):
    """decision_tree, random_forest, boosted, or shallow_boosted (an additive stand-in of depth two) from pyspark.ml."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler

    if kind == "shallow_boosted":
        options = {"maxDepth": 2, **options}
    name = {"decision_tree": "DecisionTree", "random_forest": "RandomForest", "boosted": "GBT", "shallow_boosted": "GBT"}[kind]
    estimator = getattr(C if classify else R, name + ("Classifier" if classify else "Regressor"))(featuresCol="__features", labelCol=target, seed=7, **options)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep"), estimator]).fit(table)
