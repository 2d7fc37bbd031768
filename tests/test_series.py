"""Tests of series, influence, selection and screens against NumPy."""

import math
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions.distributions import chi2_sf, f_sf
from gritstone.operators import selection as S
from gritstone.operators import series_tests as T

N = 120


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(17)
    x = rng.normal(size=N).cumsum() * 0.3
    e = rng.normal(size=N)
    for k in range(1, N):
        e[k] += 0.5 * e[k - 1]
    return x, 2 + 1.5 * x + e


@pytest.fixture(scope="module")
def series(spark, data):
    x, y = data
    return spark.createDataFrame([(f"{k:04d}", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "t string, x double, y double").repartition(4)


def fitted(columns, y):
    a = np.column_stack([np.ones(len(y)), *columns])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return b, y - a @ b


def determination(columns, y):
    _, r = fitted(columns, y)
    return 1 - (r @ r) / ((y - y.mean()) ** 2).sum()


def back(v, k):
    return np.concatenate([np.zeros(k), v[:-k]])


@pytest.mark.parametrize("lags", [1, 3])
def test_breusch_godfrey_and_arch(series, data, lags):
    x, y = data
    _, e = fitted([x], y)
    want = N * determination([x, *(back(e, k) for k in range(1, lags + 1))], e)
    got = T.breusch_godfrey(series, "t", ["x"], "y", lags).first()
    assert got["n"] == N and math.isclose(got["statistic"], want, rel_tol=1e-7) and math.isclose(got["p_value"], chi2_sf(want, lags), rel_tol=1e-5)
    s = y * y
    want = (N - lags) * determination([s[lags - k : N - k] for k in range(1, lags + 1)], s[lags:])
    got = T.arch_lm(series, "t", "y", lags).first()
    assert got["n"] == N - lags and math.isclose(got["statistic"], want, rel_tol=1e-7)


def test_granger(series, data):
    x, y = data
    for r in T.granger(series, "t", "x", "y", 3).collect():
        k = r["lags"]
        own = [y[k - j : N - j] for j in range(1, k + 1)]
        other = [x[k - j : N - j] for j in range(1, k + 1)]
        (_, alone), (_, both) = fitted(own, y[k:]), fitted(own + other, y[k:])
        free = N - k - 2 * k - 1
        f = (alone @ alone - both @ both) / k / (both @ both / free)
        assert math.isclose(r["statistic"], f, rel_tol=1e-6) and math.isclose(r["p_value"], f_sf(f, k, free), rel_tol=1e-5)


@pytest.mark.parametrize("lags", [0, 2])
def test_cointegration(series, data, lags):
    x, y = data
    _, e = fitted([x], y)
    d = np.diff(e)
    rows = np.column_stack([e[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
    b, *_ = np.linalg.lstsq(rows, d[lags:], rcond=None)
    r = d[lags:] - rows @ b
    t = b[0] / math.sqrt(r @ r / (len(r) - len(b)) * np.linalg.inv(rows.T @ rows)[0, 0])
    got = T.engle_granger(series, "t", "y", "x", lags).first()
    assert got["n"] == len(r) and math.isclose(got["statistic"], t, rel_tol=1e-7) and got["p_value"] < 0.01


def test_unit_root_p_values():
    """The critical values of the literature."""
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert abs(T.unit_root_p(t) - p) < 0.003
    for t, p in ((-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10)):
        assert abs(T.unit_root_p(t, 2) - p) < 0.003
    values = [T.unit_root_p(t) for t in np.linspace(-20, 4, 200)]
    assert values == sorted(values) and values[0] == 0 and values[-1] == 1 and T.unit_root_p(None) is None
    assert T.kpss_p(0.1) == 0.1 and T.kpss_p(0.463) == 0.05 and T.kpss_p(9.0) == 0.01 and abs(T.kpss_p(0.405) - 0.075) < 1e-9


def test_seasonality(spark, series, data):
    _, y = data
    rows = T.seasonality(series, "t", "y", 7).orderBy("bucket").collect()
    means = np.array([y[k::7].mean() for k in range(7)])
    assert np.allclose([r["mean"] for r in rows], means) and math.isclose(rows[0]["strength"], means.var() / y.var(), rel_tol=1e-9)
    assert T.seasonality(series.limit(10), "t", "y", 7).first()["strength"] is None
    assert T.seasonality(series.withColumn("y", F.lit(1.0)), "t", "y", 7).first()["strength"] == 0
    assert math.isclose(T.autocorrelation(series, "t", "y").first()["r"], np.corrcoef(y[1:], y[:-1])[0, 1], rel_tol=1e-9)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(200, 2)) * [1, 30] + [2, 0]
    y = 1 + x @ [1.0, 0.1] + rng.normal(size=200) * (1 + np.abs(x[:, 0]))
    held = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))] + [(900, None, 1.0, 1.0), (901, 1.0, 1.0, math.nan)], "id bigint, a double, b double, y double")
    return x, y, held.repartition(3)


def test_white(rows):
    x, y, held = rows
    _, e = fitted([x], y)
    more = [x[:, 0], x[:, 1], *(x[:, i] * x[:, j] for i, j in combinations_with_replacement(range(2), 2))]
    want = 200 * determination(more, e * e)
    got = T.white(held, ["a", "b"], "y").first()
    assert got["n"] == 200 and math.isclose(got["statistic"], want, rel_tol=1e-6) and math.isclose(got["p_value"], chi2_sf(want, 5), rel_tol=1e-4)


def test_deletion_influence_by_deleting(rows):
    x, y, held = rows
    got = {r["id"]: r for r in T.deletion_influence(held, ["a", "b"], "y").collect()}
    assert got.keys() == set(range(200))
    full = np.column_stack([np.ones(200), x])
    b, _ = fitted([x], y)
    inverse = np.linalg.inv(full.T @ full)
    counts = [0, 0]
    for k in range(200):
        keep = np.arange(200) != k
        bk, rk = fitted([x[keep]], y[keep])
        s = math.sqrt(rk @ rk / (199 - 3))
        beta = (b - bk) / (s * np.sqrt(np.diag(inverse)))
        h = full[k] @ inverse @ full[k]
        fit = full[k] @ (b - bk) / (s * math.sqrt(h))
        r = got[k]
        assert np.allclose([r["dfbeta_intercept"], r["dfbeta_a"], r["dfbeta_b"], r["dffits"]], [*beta, fit], atol=1e-8)
        assert r["driver"] == "ab"[int(np.argmax(np.abs(beta[1:])))]
        counts[0] += np.abs(beta[1:]).max() >= 2 / math.sqrt(200)
        counts[1] += abs(fit) >= 2 * math.sqrt(3 / 200)
    flagged = T.flagged_influence(held, ["a", "b"], "y").first()
    assert [flagged["dfbetas"], flagged["dffits"]] == counts


def test_link_and_box_tidwell(spark):
    rng = np.random.default_rng(23)
    x = rng.uniform(0.2, 4, 3000)
    straight, bent = ((rng.random(3000) < 1 / (1 + np.exp(-e))).astype(float) for e in (x - 2, 2 * np.sin(2 * x)))
    held = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, straight, bent)], "x double, s double, b double")
    square = lambda t: T.link_test(held, ["x"], t).where("term = 'square'").first()["p_value"]
    assert square("s") > 0.01 > square("b")
    assert T.box_tidwell(held, ["x"], "s").first()["p_value"] > 0.01 > T.box_tidwell(held, ["x"], "b").first()["p_value"]


# selection
def auc(v, y):
    pos, neg = v[y == 1], v[y == 0]
    return (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(29)
    n = 400
    a, c = rng.normal(size=n), np.round(rng.normal(size=n))
    y = (rng.random(n) < 1 / (1 + np.exp(-a - 0.3 * c))).astype(int)
    b = a + 0.1 * rng.normal(size=n)
    b[rng.random(n) < 0.1] = np.nan
    kind = np.where(rng.random(n) < 0.2, "", rng.choice(["u", "v", "w"], n))
    held = [(float(a[k]), None if math.isnan(b[k]) else float(b[k]), float(c[k]), kind[k] or None, 1.0, int(y[k])) for k in range(n)]
    return a, b, c, kind, y, spark.createDataFrame(held + [(1.0, 1.0, 1.0, "u", 1.0, None)], "a double, b double, c double, kind string, flat double, y int").repartition(3)


def test_univariate_scores(people):
    a, b, c, kind, y, held = people
    got = S.univariate_scores(held, ["a", "b", "c", "flat"], ["kind"], "y")
    rate = np.array([y[kind == k].mean() for k in kind])
    middle = np.median(np.append(b[~np.isnan(b)], []))
    want = {"a": auc(a, y), "b": auc(np.where(np.isnan(b), middle, b), y), "c": auc(c, y), "kind": auc(rate, y)}
    assert all(math.isclose(got[k], abs(v - 0.5) * 2, abs_tol=1e-12) for k, v in want.items()) and got["flat"] == 0
    assert S.univariate_scores(held.limit(0), ["a"], ["kind"], "y") == {"a": 0.0, "kind": 0.0}
    assert S.univariate_scores(held, [], [], "y") == {}


def test_rules():
    scores = {"a": 0.9, "b": 0.8, "c": 0.5, "d": 0.5, "e": 0.1, "k": 0.7}
    kinds = dict.fromkeys("abcde", "numeric") | {"k": "categorical"}
    near = {("a", "b"): 0.95, ("b", "a"): 0.95, ("c", "d"): 0.9, ("d", "c"): 0.9}
    pick = lambda **rules: {c.feature: (c.selected, c.reason) for c in S.decide(scores, kinds, near, S.Rules(**rules))}
    assert all(v == (True, "screen_passed") for v in pick().values())
    assert pick(least_score=0.2)["e"] == (False, "below_univariate_threshold")
    got = pick(most_correlation=0.9)
    assert got["b"] == (False, "correlated_with:a") and got["d"] == (False, "correlated_with:c") and got["c"][0]
    assert pick(most_correlation=0.9, include=["b"])["b"] == (True, "locked_include")
    got = pick(most_features=2, include=["e"], exclude=["a", "nobody"])
    assert got["e"] == (True, "locked_include") and got["a"] == (False, "locked_exclude") and got["b"] == (True, "screen_passed") and got["k"] == (False, "max_feature_cap")
    assert pick(include=["a"], exclude=["a"])["a"] == (False, "locked_exclude")
    order = [c.feature for c in S.decide(scores, kinds, near, S.Rules(exclude=["a"]))]
    assert order == ["b", "k", "c", "d", "e", "a"]
    changed = {c.feature: (c.selected, c.reason) for c in S.reviewed(S.decide(scores, kinds, near, S.Rules()), {"a": (False, "policy")})}
    assert changed["a"] == (False, "manual_review:policy") and changed["b"][0]


def test_prescreen(people):
    held = people[-1].withColumn("gone", F.lit(None).cast("double")).withColumn("name", F.concat(F.lit("n"), F.monotonically_increasing_id()))
    rows = {r["feature"]: r for r in S.prescreen(held, ["a", "gone", "flat"], ["kind", "name"], "y", F.rand(1) < 2).collect()}
    assert rows["gone"]["reason"] == "very_high_missingness,low_variance" and rows["flat"]["reason"] == "low_variance"
    assert rows["name"]["reason"] == "high_cardinality_categorical" and rows["a"]["action"] == rows["kind"]["action"] == "retain"
    assert rows["gone"]["missing"] == 1 and rows["kind"]["distinct_values"] == 3


def test_stability_of_moved_and_unmoved(spark):
    held = spark.range(4000).select(F.col("id"), (F.col("id") % 100).cast("double").alias("same"), (F.col("id") % 100 + F.when(F.col("id") >= 2000, 50).otherwise(0)).cast("double").alias("moved"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"))
    got = S.stability(held, F.col("id") < 2000, ["same", "moved"], ["kind"])
    assert abs(got["same"]) < 1e-9 and abs(got["kind"]) < 1e-9 and got["moved"] > 1


def test_binomial_influence(spark):
    """Against NumPy at the fit, and its one-step changes against fits without the row."""
    from gritstone.operators.models import iteratively_reweighted

    rng = np.random.default_rng(37)
    x = rng.normal(size=(120, 2))
    y = (rng.random(120) < 1 / (1 + np.exp(-(0.3 + x[:, 0] - x[:, 1])))).astype(float)
    held = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))] + [(500, None, 1.0, 1.0)], "id bigint, a double, b double, y double").repartition(3)
    full, b = np.column_stack([np.ones(120), x]), iteratively_reweighted(held, ["a", "b"], "y").coefficients

    def newton(rows, y, b):
        for _ in range(30):
            p = 1 / (1 + np.exp(-rows @ b))
            b = b + np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows, rows.T @ (y - p))
        return b

    p = 1 / (1 + np.exp(-full @ b))
    w = p * (1 - p)
    inverse = np.linalg.inv((full * w[:, None]).T @ full)
    h = w * np.einsum("ij,jk,ik->i", full, inverse, full)
    r = (y - p) / np.sqrt(w * (1 - h))
    for row in T.binomial_influence(held, ["a", "b"], "y").collect():
        k = row["id"]
        assert np.allclose([row["fitted"], row["leverage"], row["residual"], row["cooks_distance"]], [p[k], h[k], r[k], r[k] ** 2 * h[k] / (1 - h[k]) / 3], atol=1e-8)
        if k < 15:
            keep = np.arange(120) != k
            change = b - newton(full[keep], y[keep], b)
            assert np.abs(np.array([row["dfbeta_intercept"], row["dfbeta_a"], row["dfbeta_b"]]) - change).max() < 0.1 * np.abs(change).max() + 1e-4
