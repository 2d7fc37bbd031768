"""Fits against NumPy: the score equations hold at the coefficients, to 1e-6 of the likelihood's own optimum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions.scalars import normal_cdf, normal_cdf_array
from gritstone.operators import likelihoods as L
from gritstone.operators import models as M

N = 800


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 2))
    eta = 0.3 + x @ [0.8, -0.5]
    mu = 1 / (1 + np.exp(-eta))
    return {
        "a": x[:, 0], "b": x[:, 1], "binary": (rng.random(N) < mu).astype(float), "count": rng.poisson(np.exp(0.5 * eta)).astype(float),
        "censored": np.maximum(eta + rng.normal(size=N), 0), "share": rng.beta(mu * 6, (1 - mu) * 6), "level": np.digitize(eta + rng.logistic(size=N), [-0.5, 1.0]).astype(float),
        "time": np.ceil(rng.exponential(np.exp(-0.6 * eta)) * 8), "died": (rng.random(N) < 0.7).astype(float), "amount": rng.gamma(2.0, np.exp(0.4 * eta) / 2),
    }


@pytest.fixture(scope="module")
def table(spark, data):
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(data))
    nulls = df.limit(3).withColumn("a", F.lit(None).cast("double"))
    return df.union(nulls).repartition(3).persist()


def design(data):
    return np.column_stack([np.ones(N), data["a"], data["b"]])


def test_normal_cdf(spark):
    z = [x / 10 for x in range(-90, 91)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-13 for r in got)


@pytest.mark.parametrize("family, target", [("binomial", "binary"), ("binomial", "share"), ("poisson", "count"), ("gamma", "amount"), ("negative_binomial", "count"), ("tweedie", "count"), ("probit", "binary")])
def test_scores_vanish(table, data, family, target):
    model = M.iteratively_reweighted(table, ["a", "b"], target, family)
    x, y = design(data), data[target]
    eta = x @ model.coefficients
    if family == "probit":
        mu = np.array([0.5 * math.erfc(-e / math.sqrt(2)) for e in eta])
        slope, variance = np.exp(-eta**2 / 2) / math.sqrt(2 * math.pi), mu * (1 - mu)
    elif family == "binomial":
        mu = 1 / (1 + np.exp(-eta))
        slope = variance = mu * (1 - mu)
    else:
        mu = slope = np.exp(eta)
        variance = {"poisson": mu, "gamma": mu**2, "negative_binomial": mu + mu**2, "tweedie": mu**1.5}[family]
    assert np.abs(x.T @ ((y - mu) * slope / variance)).max() < 1e-6
    information = (x * (slope**2 / variance)[:, None]).T @ x
    assert np.allclose(model.covariance, np.linalg.inv(information), rtol=1e-6)


def test_ridge_and_ordinary_least_squares(table, data):
    x, y = design(data), data["censored"]
    for ridge in (0.0, 10.0):
        want = np.linalg.solve(x.T @ x + np.diag([0, ridge, ridge]), x.T @ y)
        assert np.allclose(M.ordinary_least_squares(table, ["a", "b"], "censored", ridge).coefficients, want, atol=1e-9)


def test_quantile_regression_is_near_the_pinball_optimum(table, data):
    model = M.quantile_regression(table, ["a", "b"], "censored", 0.75)
    x, y, rng = design(data), data["censored"], np.random.default_rng(1)
    loss = lambda b: np.mean(np.maximum(0.75 * (y - x @ b), -0.25 * (y - x @ b)))
    best = loss(model.coefficients)
    assert all(best <= loss(model.coefficients + rng.normal(size=3) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(300))


def numeric(f, p, h=1e-6):
    return np.array([(f(p + h * e) - f(p - h * e)) / (2 * h) for e in np.eye(len(p))])


def test_tobit(table, data):
    fit = L.tobit(table, ["a", "b"], "censored", 0.0)
    x, y = design(data), data["censored"]

    def likelihood(p):
        z = (y - x @ p[:3]) / np.exp(p[3])
        below = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z])
        return np.where(y <= 0, below, -p[3] - z * z / 2).sum()

    assert np.abs(numeric(likelihood, fit.values)).max() < 1e-3
    assert np.abs(fit.values[:3] - [0.3, 0.8, -0.5]).max() < 0.2


def test_beta_and_inflated_beta(table, data):
    fit = L.beta_regression(table, ["a", "b"], "share")
    x, y = design(data), np.clip(data["share"], 1e-6, 1 - 1e-6)

    def likelihood(p):
        mu, phi = 1 / (1 + np.exp(-x @ p[:3])), np.exp(p[3])
        return sum(math.lgamma(phi) - math.lgamma(m * phi) - math.lgamma((1 - m) * phi) + (m * phi - 1) * math.log(v) + ((1 - m) * phi - 1) * math.log(1 - v) for m, v in zip(mu, y))

    assert np.abs(numeric(likelihood, fit.values)).max() < 1e-3
    lumps = table.withColumn("share", F.when(F.col("a") > 1, 1.0).when(F.col("b") > 1, 0.0).otherwise(F.col("share")))
    model = L.zero_one_inflated_beta(lumps, ["a", "b"], "share")
    row = lumps.na.drop().agg(F.avg("share"), F.avg(model.predict())).first()
    assert abs(row[0] - row[1]) < 0.03


def test_ordered_logit(table, data):
    fit = L.ordered_logit(table, ["a", "b"], "level", 3)
    x, y = design(data)[:, 1:], data["level"].astype(int)

    def likelihood(p):
        upto = np.column_stack([np.zeros(N), *(1 / (1 + np.exp(-(c - x @ p[2:]))) for c in p[:2]), np.ones(N)])
        return np.log(upto[np.arange(N), y + 1] - upto[np.arange(N), y]).sum()

    assert np.abs(numeric(likelihood, fit.values)).max() < 1e-3


def test_cox(table, data):
    fit = L.cox(table, ["a", "b"], "time", "died")
    x, t, d = design(data)[:, 1:], data["time"], data["died"]

    def likelihood(b):
        risk = np.exp(x @ b)
        return sum(x[i] @ b - math.log(risk[t >= t[i]].sum()) for i in range(N) if d[i])

    assert np.abs(numeric(likelihood, fit.values)).max() < 1e-3


def test_two_stage_and_hazard(table, data):
    model = L.two_stage_loss(table.withColumn("loss", F.when(F.col("share") > 0.5, F.col("share")).otherwise(0.0)), ["a", "b"], "loss")
    row = table.agg(F.avg(F.when(F.col("share") > 0.5, F.col("share")).otherwise(0.0)), F.avg(model.predict())).first()
    assert abs(row[0] - row[1]) < 0.05
    held = table.withColumn("entity", F.floor("time"))
    hazard, rows = L.discrete_hazard(held, ["a"], "binary", "entity", ["b", "a"])
    assert hazard.features == ["a", "period", "period_squared"] and rows.select(F.max("period")).first()[0] > 1


def test_empty_table_is_an_error_not_a_model(table):
    with pytest.raises((np.linalg.LinAlgError, ArithmeticError, TypeError)):
        L.cox(table.where("false"), ["a"], "time", "died")


def test_normal_cdf_is_plain_arithmetic(spark):
    """No loop over a row's terms: a fold per row took most of a probit fit."""
    assert "aggregate" not in str(normal_cdf(F.col("z")))
    z = np.linspace(-37, 37, 1481)
    exact = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    got = spark.createDataFrame([(float(x),) for x in z], "z double").select(normal_cdf(F.col("z")).alias("p")).toPandas()["p"].to_numpy()
    for p in (got, normal_cdf_array(z)):
        assert np.abs(p - exact).max() < 1e-15 and np.abs(p / exact - 1).max() < 1e-12
    assert normal_cdf_array(np.array([-np.inf, np.inf])).tolist() == [0.0, 1.0]
