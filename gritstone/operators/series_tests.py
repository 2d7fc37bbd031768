"""Tests of time series (one row per period) and of the rows behind a least-squares model, with p-values.

A series has a row per period, so a window over it in order is short however many rows lie behind it. Regressions are
moments in one aggregate, solved at the driver.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.distributions import chi2_sf, f_sf, normal_sf
from gritstone.functions.scalars import correlation
from gritstone.operators.blocks import block_sums, design, doubles
from gritstone.operators.models import Linear

RESULT = "test string, n bigint, statistic double, p_value double"

#: MacKinnon's response surfaces for unit-root tests with a constant, for one series and for the residuals of
#: a regression on one other: statistics below `least` have p 0, above `most` p 1; up to `turn` the first polynomial
#: holds, above it the second; p is the normal distribution function of the polynomial.
SURFACES = {
    1: {"least": -18.83, "most": 2.74, "turn": -1.61, "low": (2.1659, 1.4412, 0.038269), "high": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"least": -18.86, "most": 0.92, "turn": -2.62, "low": (2.92, 1.5012, 0.039796), "high": (2.1945, 0.64695, -0.29198, -0.042377)},
}
#: Critical values of the level-stationarity statistic and their p-values.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def unit_root_p(statistic: float | None, series: int = 1) -> float | None:
    if statistic is None or statistic != statistic:
        return None
    s = SURFACES[series]
    if statistic <= s["least"] or statistic >= s["most"]:
        return float(statistic >= s["most"])
    polynomial = s["low"] if statistic <= s["turn"] else s["high"]
    return normal_sf(-sum(c * statistic**k for k, c in enumerate(polynomial)))


def kpss_p(statistic: float | None) -> float | None:
    """Linear between the tabled points; beyond them the outermost p-value."""
    if statistic is None or statistic != statistic:
        return None
    return float(np.interp(statistic, *zip(*KPSS_POINTS, strict=True)))


def with_p_value(test: DataFrame, name: str) -> DataFrame:
    """The result of a stationarity test (n, statistic) as test, n, statistic, p_value; name: adf, phillips_perron or kpss."""
    row = test.first()
    p = (kpss_p if name == "kpss" else unit_root_p)(row["statistic"])
    return test.sparkSession.createDataFrame([(name, row["n"], row["statistic"], p)], RESULT)


def _regressed(table: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, float, float, int]:
    """Coefficients, residual and total sum of squares, and rows, of least squares on a table of finite doubles."""
    names = [*features, target]
    held = doubles(table, names)
    shift = held.agg(*(F.avg(c).alias(c) for c in names)).first()
    if shift is None or shift[0] is None:
        raise ValueError("no row is without nulls")
    mean = np.array([shift[c] for c in names])
    k = len(names)

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows = design({c: x[c] - m for c, m in zip(names, mean, strict=True)}, names)
        return (rows.T @ rows).ravel()

    whole = block_sums(held, (k + 1) ** 2, part).reshape(k + 1, k + 1)
    n, inside = int(whole[0, 0]), whole[1:, 1:] - np.outer(whole[0, 1:], whole[0, 1:]) / whole[0, 0]
    b = np.linalg.lstsq(inside[:-1, :-1], inside[:-1, -1], rcond=1e-12)[0]
    rest = max(float(inside[-1, -1] - b @ inside[:-1, -1]), 0.0)
    return np.append(mean[-1] - b @ mean[:-1], b), rest, float(inside[-1, -1]), n


def _lagged(series: DataFrame, order: str, columns: list[str], lags: int, keep: list[str] = ()) -> DataFrame:
    own = Window.orderBy(order)
    return series.select(order, *columns, *keep, *(F.lag(c, k).over(own).alias(f"{c}_{k}") for c in columns for k in range(1, lags + 1)))


def _result(df: DataFrame, name: str, n: int, statistic: float, p: float | None) -> DataFrame:
    return df.sparkSession.createDataFrame([(name, int(n), float(statistic), p)], RESULT)


def breusch_godfrey(series: DataFrame, order: str, features: list[str], target: str, lags: int) -> DataFrame:
    """n R^2 of the regression's residuals on its features and their own lags (0 before the start); chi-squared."""
    held = series.select(order, *features, target).na.drop()
    b, _, _, _ = _regressed(held, features, target)
    apart = held.select(order, *features, (F.col(target) - Linear(features, b).linear()).alias("e"))
    own = [f"e_{k}" for k in range(1, lags + 1)]
    _, rest, total, n = _regressed(_lagged(apart, order, ["e"], lags, features).na.fill(0.0, own), [*features, *own], "e")
    statistic = n * (1 - rest / total) if total else 0.0
    return _result(series, "breusch_godfrey", n, statistic, chi2_sf(statistic, lags))


def arch_lm(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """n R^2 of squared values on their own lags; chi-squared."""
    squares = series.select(order, (F.col(value) * F.col(value)).alias("s"))
    _, rest, total, n = _regressed(_lagged(squares, order, ["s"], lags), [f"s_{k}" for k in range(1, lags + 1)], "s")
    statistic = n * (1 - rest / total) if total else 0.0
    return _result(series, "arch_lm", n, statistic, chi2_sf(statistic, lags))


def granger(series: DataFrame, order: str, cause: str, effect: str, most_lags: int = 2) -> DataFrame:
    """For each number of lags the F test that lags of `cause` add nothing to those of `effect`: lags, n, statistic, p_value."""
    rows = []
    for lags in range(1, most_lags + 1):
        wide = _lagged(series, order, [cause, effect], lags).na.drop()
        own, other = ([f"{c}_{k}" for k in range(1, lags + 1)] for c in (effect, cause))
        _, alone, _, n = _regressed(wide, own, effect)
        _, both, _, _ = _regressed(wide, [*own, *other], effect)
        free = n - 2 * lags - 1
        statistic = (alone - both) / lags / (both / free)
        rows.append((lags, n, float(statistic), f_sf(statistic, lags, free)))
    return series.sparkSession.createDataFrame(rows, "lags int, n bigint, statistic double, p_value double")


def engle_granger(series: DataFrame, order: str, a: str, b: str, lags: int = 1) -> DataFrame:
    """The unit-root statistic (no constant, `lags` lagged changes) of the residuals of a on b, with its p-value for two series."""
    fit, _, _, _ = _regressed(series, [b], a)
    e = F.col(a) - Linear([b], fit).linear()
    own = Window.orderBy(order)
    steps = series.na.drop(subset=[a, b]).select(order, e.alias("e")).select(order, F.lag("e").over(own).alias("level"), (F.col("e") - F.lag("e").over(own)).alias("change"))
    names = ["level", *(f"change_{k}" for k in range(1, lags + 1))]
    wide = doubles(_lagged(steps, order, ["change"], lags, ["level"]), [*names, "change"])
    k = len(names)

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows = np.column_stack([x[c] for c in (*names, "change")])
        return np.append((rows.T @ rows).ravel(), len(rows))

    sums = block_sums(wide, (k + 1) ** 2 + 1, part)
    whole, n = sums[:-1].reshape(k + 1, k + 1), int(sums[-1])
    c = np.linalg.solve(whole[:k, :k], whole[:k, k])
    variance = (whole[k, k] - c @ whole[:k, k]) / (n - k)
    statistic = float(c[0] / math.sqrt(variance * np.linalg.inv(whole[:k, :k])[0, 0]))
    return _result(series, "cointegration", n, statistic, unit_root_p(statistic, 2))


def seasonality(series: DataFrame, order: str, value: str, period: int) -> DataFrame:
    """bucket, n, mean and strength: how much of the values' variance the means of the buckets (place modulo period) have.

    With fewer than two whole periods the strength is null.
    """
    known = series.where(F.col(value).isNotNull())
    placed = known.select(F.col(value).cast("double").alias("v"), F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(period)).alias("bucket"))
    total = placed.agg(F.count("*").alias("n"), F.var_pop("v").alias("s")).first()
    means = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    strength = F.lit(None).cast("double") if total["n"] < 2 * period else F.var_pop("mean").over(Window.partitionBy()) / F.lit(total["s"]) if total["s"] else F.lit(0.0)
    return means.withColumn("strength", strength)


def autocorrelation(series: DataFrame, order: str, value: str, lag: int = 1) -> DataFrame:
    """The correlation of values with those `lag` periods before: n pairs and r."""
    pairs = series.where(F.col(value).isNotNull()).select(F.col(value).alias("a"), F.lag(value, lag).over(Window.orderBy(order)).alias("b")).na.drop()
    return pairs.agg(F.count("*").alias("n"), correlation("a", "b").alias("r"))


# rows behind a least-squares model
def white(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """n R^2 of squared residuals on all features, squares and products; chi-squared with as many degrees as these."""
    b, _, _, _ = _regressed(table, features, target)
    held = doubles(table, [*features, target])
    e = F.col(target) - Linear(features, b).linear()
    pairs = list(combinations_with_replacement(features, 2))
    wide = held.select((e * e).alias("s"), *features, *((F.col(x) * F.col(y)).alias(f"p{k}") for k, (x, y) in enumerate(pairs)))
    names = [*features, *(f"p{k}" for k in range(len(pairs)))]
    spread = wide.agg(*(F.stddev_pop(c).alias(c) for c in names)).first()
    wide = wide.select("s", *((F.col(c) / float(spread[c] or 1.0)).alias(c) for c in names))
    _, rest, total, n = _regressed(wide, names, "s")
    statistic = n * (1 - rest / total) if total else 0.0
    return _result(table, "white", n, statistic, chi2_sf(statistic, len(names)))


def deletion_influence(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """The rows without nulls with `dffits`, one `dfbeta_<name>` per coefficient, and the name of the largest, `driver`.

    How much the fitted value and each coefficient move, in their standard errors, when the row is left out; from the
    inverse moments alone, so no row leaves its task.
    """
    held = doubles(table, [*features, target], whole=False)
    b, rest, _, n = _regressed(table, features, target)
    p = len(b)

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows = design(x, features)
        return (rows.T @ rows).ravel()

    inverse = np.linalg.inv(block_sums(held.na.drop().select(*features), p * p, part).reshape(p, p))
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    turned = [sum((x[j] * float(inverse[i, j]) for j in range(p)), F.lit(0.0)) for i in range(p)]
    h = sum((x[i] * turned[i] for i in range(p)), F.lit(0.0))
    e = F.col(target).cast("double") - Linear(features, b).linear()
    # the residual variance without the row
    left = (F.lit(rest) - e * e / (1 - h)) / (n - p - 1)
    outside = e / F.sqrt(left * (1 - h))
    names = ["intercept", *features]
    finite = F.lit(True)
    for c in (*features, target):
        finite = finite & (F.abs(F.col(c).cast("double")) < float("inf"))
    moved = {f"dfbeta_{c}": turned[i] * e / (1 - h) / F.sqrt(left * float(inverse[i, i])) for i, c in enumerate(names)}
    out = table.where(finite).withColumns({"dffits": outside * F.sqrt(h / (1 - h)), **moved})
    most = F.greatest(*(F.abs(f"dfbeta_{c}") for c in features)) if len(features) > 1 else F.abs(f"dfbeta_{features[0]}")
    return out.withColumn("driver", F.coalesce(*(F.when(F.abs(f"dfbeta_{c}") == most, c) for c in features)))


def flagged_influence(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """How many rows pass the usual limits: |dfbeta| >= 2 / sqrt(n) for any feature, |dffits| >= 2 sqrt(p / n)."""
    held = deletion_influence(table, features, target)
    n, p = F.count("*"), len(features) + 1
    row = held.agg(n.alias("n")).first()["n"]
    limit_beta, limit_fit = 2 / math.sqrt(max(row, 1)), 2 * math.sqrt(p / max(row, 1))
    any_beta: Column = F.lit(False)
    for c in features:
        any_beta = any_beta | (F.abs(f"dfbeta_{c}") >= limit_beta)
    return held.agg(n.alias("n"), F.sum(any_beta.cast("bigint")).alias("dfbetas"), F.sum((F.abs("dffits") >= limit_fit).cast("bigint")).alias("dffits"))


def link_test(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """A logistic model of the linear predictor and its square: term, coefficient, z, p_value; a clear square speaks against the link.

    The predictor is standardised first, since it and its square are all but collinear otherwise; that leaves the z of
    the square as it is.
    """
    from gritstone.operators.models import iteratively_reweighted

    model = iteratively_reweighted(table, features, target)
    eta = model.linear()
    mean, spread = table.na.drop(subset=[*features, target]).agg(F.avg(eta), F.stddev_pop(eta)).first()
    z = (eta - float(mean)) / float(spread or 1.0)
    held = table.select(z.alias("linear"), (z * z).alias("square"), target)
    return iteratively_reweighted(held, ["linear", "square"], target).table(table).select(F.col("name").alias("term"), "coefficient", "z", "p_value")


def box_tidwell(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """For each positive feature a logistic model with x and x ln x: feature, coefficient of x ln x, z, p_value."""
    from gritstone.operators.models import iteratively_reweighted

    out = None
    for c in features:
        x = F.col(c).cast("double")
        held = table.where(x > 0).select(x.alias("x"), (x * F.log(x)).alias("bent"), target)
        row = iteratively_reweighted(held, ["x", "bent"], target).table(table).where("name = 'bent'").select(F.lit(c).alias("feature"), "coefficient", "z", "p_value")
        out = row if out is None else out.unionByName(row)
    return out


def binomial_influence(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """The rows without nulls with fitted probability, leverage, Pearson residual (standardised), Cook's distance and one
    `dfbeta_<name>` per coefficient of a logistic model: its one-step change when the row is left out.

    All follow from the fit and its inverse information, k^2 numbers, so no row leaves its task.
    """
    from gritstone.operators.models import iteratively_reweighted

    model = iteratively_reweighted(table, features, target)
    inverse = model.covariance
    k = len(model.coefficients)
    y, mu = F.col(target).cast("double"), model.predict()
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    turned = [sum((x[j] * float(inverse[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
    held = table.where(y.isNotNull()).na.drop(subset=features).withColumn("fitted", mu)
    weight = F.col("fitted") * (1 - F.col("fitted"))
    held = held.withColumn("leverage", weight * sum((x[i] * turned[i] for i in range(k)), F.lit(0.0)))
    left = 1 - F.col("leverage")
    residual = (y - F.col("fitted")) / F.sqrt(weight * left)
    moved = {f"dfbeta_{c}": turned[i] * (y - F.col("fitted")) / left for i, c in enumerate(["intercept", *features])}
    held = held.withColumns({"residual": residual, **moved})
    return held.withColumn("cooks_distance", F.col("residual") * F.col("residual") * F.col("leverage") / left / k)
