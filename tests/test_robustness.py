"""Quantiles, bootstrap, pooling, missingness, stationarity, specification, influence and selection against NumPy."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import quantiles
from gritstone.operators import robustness as R


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:, 2] = 0.6 * x[:, 0] + 0.8 * x[:, 2]
    return x, 1 + x @ np.array([2.0, 0.0, -1.0]) + rng.normal(size=400)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    return spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))], "id bigint, a double, b double, c double, y double").persist()


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    points = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    for values in (list(rng.normal(size=777)), [float(v) for v in rng.integers(0, 4, 300)], [3.0], [1.0, 2.0], [5.0] * 50 + [6.0]):
        held = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for ranges in (64, 3):
            assert np.allclose(quantiles.exact_quantiles(held, "v", points, ranges), np.quantile(values, points), atol=1e-12)
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), "v", points) == [None] * len(points)


def test_running_shares(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v), int(n)) for v, n in zip(np.unique(rng.normal(size=200)), rng.integers(0, 9, 200))]
    got = sorted(tuple(r) for r in quantiles.running_shares(spark.createDataFrame(rows, "v double, n bigint"), "v", ["n"], 7).select("v", "n_upto", "n_all").collect())
    upto = np.cumsum([n for _, n in rows])
    assert got == [(v, int(u), int(upto[-1])) for (v, _), u in zip(rows, upto)]
    assert quantiles.running_shares(spark.createDataFrame([], "v double, n bigint"), "v", ["n"]).count() == 0


def test_bootstrap(table, data):
    x, y = data
    w = np.array([[r[k] for k in range(40)] for r in table.orderBy("id").select(*(R.poisson_weight("id", k) for k in range(40))).collect()])
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    means = {r["replicate"]: r for r in R.bootstrap_means(table, "id", {"y": F.col("y")}, 5).collect()}
    for k in range(5):
        assert means[k]["n"] == w[:, k].sum() and math.isclose(means[k]["y"], w[:, k] @ y / w[:, k].sum(), rel_tol=1e-9)
    full = np.column_stack([np.ones(len(y)), x])
    fits = np.array([np.linalg.solve(full.T @ (full * w[:, [k]]), full.T @ (w[:, k] * y)) for k in range(5)])
    for r, b in zip(R.bootstrap_fit(table, "id", ["a", "b", "c"], "y", 5).collect(), fits.T):
        assert np.allclose([r["mean"], r["std"], r["p05"], r["p95"]], [b.mean(), b.std(ddof=1), np.quantile(b, 0.05), np.quantile(b, 0.95)], atol=1e-9)


def test_missing_completely_at_random(spark, data):
    x, _ = data
    gone = np.where(np.random.default_rng(3).random(x.shape) < 0.15, np.nan, x)
    held = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in gone], "a double, b double, c double")
    mean, k = np.nanmean(gone, axis=0), 3
    cov = np.array([[np.cov(gone[~np.isnan(gone[:, [i, j]]).any(axis=1)][:, [i, j]].T)[0, 1] if i != j else np.nanvar(gone[:, i], ddof=1) for j in range(k)] for i in range(k)])
    statistic = terms = 0
    for pattern in {tuple(r) for r in np.isnan(gone)}:
        part = gone[(np.isnan(gone) == pattern).all(axis=1)][:, ~np.array(pattern)]
        if part.shape[1] and len(part) > 1:
            has = np.flatnonzero(~np.array(pattern))
            d = part.mean(axis=0) - mean[has]
            statistic += len(part) * d @ np.linalg.pinv(cov[np.ix_(has, has)]) @ d
            terms += len(has)
    row = R.missing_completely_at_random(held, ["a", "b", "c"]).first()
    assert math.isclose(row["statistic"], statistic, rel_tol=1e-9) and row["degrees"] == terms - 3 and 0 <= row["p_value"] <= 1


def test_specification_and_influence(table, data):
    x, y = data
    full = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(full, y, rcond=None)[0]
    hat = np.einsum("ij,jk,ik->i", full, np.linalg.inv(full.T @ full), full)
    s2 = ((y - full @ b) ** 2).sum() / (len(y) - 4)
    t = (y - full @ b) / np.sqrt(s2 * (1 - hat))
    for r in R.influence(table, ["a", "b", "c"], "y").collect():
        k = r["id"]
        assert np.allclose([r["leverage"], r["studentised"], r["cooks_distance"]], [hat[k], t[k], t[k] ** 2 * hat[k] / (1 - hat[k]) / 4], atol=1e-8)
    fitted = full @ b
    more = np.column_stack([full, fitted**2, fitted**3])
    small, large = ((y - fitted) ** 2).sum(), ((y - more @ np.linalg.lstsq(more, y, rcond=None)[0]) ** 2).sum()
    assert math.isclose(R.ramsey_reset(table, ["a", "b", "c"], "y").first()["statistic"], (small - large) / 2 / (large / (len(y) - 6)), rel_tol=1e-6)


def test_elastic_net_meets_its_optimality_conditions(table, data):
    x, y = data
    for penalty, mix in ((0.1, 1.0), (0.3, 0.5), (5.0, 1.0)):
        b = R.elastic_net(table, ["a", "b", "c"], "y", penalty, mix).coefficients
        rest = y - b[0] - x @ b[1:]
        slope = x.T @ rest / len(y) - penalty * (1 - mix) * b[1:]
        assert abs(rest.mean()) < 1e-9
        for s, v in zip(slope, b[1:]):
            assert abs(s - penalty * mix * np.sign(v)) < 1e-8 if v else abs(s) <= penalty * mix + 1e-9
    assert not b[1:].any()


def test_subset_search(table, data):
    x, y = data
    rows = R.subset_search(table, ["a", "b", "c"], "y", range(1, 4)).collect()
    assert len(rows) == 7 and rows[0]["subset"] == "a,c"
    for chosen in (c for s in (1, 2, 3) for c in combinations(range(3), s)):
        full = np.column_stack([np.ones(len(y)), x[:, chosen]])
        sse = ((y - full @ np.linalg.lstsq(full, y, rcond=None)[0]) ** 2).sum()
        row = next(r for r in rows if r["subset"] == ",".join("abc"[j] for j in chosen))
        assert math.isclose(row["bic"], len(y) * math.log(sse / len(y)) + math.log(len(y)) * (len(chosen) + 1), rel_tol=1e-9)


def test_rank_score(spark):
    held = spark.createDataFrame([("x", 3.0), ("x", 1.0), ("x", 3.0), ("x", None), ("y", 2.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["rank_score"] for r in R.rank_score(held, "v", ["g"]).collect()}
    assert got == {("x", 3.0): 1.0, ("x", 1.0): 0.0, ("x", None): None, ("y", 2.0): 1.0}


def test_routing(spark, table):
    held = table.withColumn("kind", F.when(F.col("id") < 300, "big").when(F.col("id") < 310, "small"))
    whole, models = R.segmented_fits(held, "kind", ["a"], "y")
    assert list(models) == ["big"]
    score, route = R.routed("kind", whole, models)
    for r in held.select("id", "a", score.alias("s"), route.alias("r")).collect():
        own = models["big"] if r["id"] < 300 else whole
        assert r["r"] == ("big" if r["id"] < 300 else "global")
        assert math.isclose(r["s"], own.coefficients[0] + own.coefficients[1] * r["a"], rel_tol=1e-9)


def test_stationarity(spark):
    e = np.random.default_rng(4).normal(size=60).cumsum()
    series = spark.createDataFrame([(k, float(v)) for k, v in enumerate(e)], "t bigint, e double")
    d = e - e.mean()
    variance = d @ d + 2 * sum((1 - k / 4) * (d[k:] @ d[:-k]) for k in (1, 2, 3))
    assert math.isclose(R.kpss(series, "t", "e", 3).first()["statistic"], (d.cumsum() ** 2).sum() / 60 / variance, rel_tol=1e-9)
    x, y = np.column_stack([np.ones(59), e[:-1]]), np.diff(e)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    u = y - x @ b
    error = math.sqrt(u @ u / 57 * np.linalg.inv(x.T @ x)[1, 1])
    g = [u @ u / 59] + [u[k:] @ u[:-k] / 59 for k in (1, 2, 3)]
    long_run = g[0] + 2 * sum((1 - k / 4) * g[k] for k in (1, 2, 3))
    want = math.sqrt(g[0] / long_run) * b[1] / error - 0.5 * (long_run - g[0]) / long_run * 59 * error / math.sqrt(g[0])
    assert math.isclose(R.phillips_perron(series, "t", "e", 3).first()["statistic"], want, rel_tol=1e-8)


def test_bootstrap_hash_is_taken_once(spark):
    """A weight hashes its row once, not once a step; batches of hashed digits give the same weights."""
    assert str(R.poisson_weight("id", 0)).count("sha2") == 1
    table = spark.range(3000).select("id", R.poisson_weight("id", 7).alias("w"), R.hashed_digits("poisson", 7, F.col("id")).alias("digits")).toPandas()
    assert (R._weights(table["digits"].to_numpy()) == table["w"]).all() and table["w"].nunique() > 4
