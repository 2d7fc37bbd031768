"""Shapes of columns, encodings, periods and wide moments against NumPy, odd tables included."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions.distributions import chi2_sf
from gritstone.operators import binning, imputation, metrics, models, shape


def test_normality_p_values_are_uniform_for_normal_columns(spark):
    rng = np.random.default_rng(3)
    held = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(400, 60))], ", ".join(f"c{k} double" for k in range(60)))
    p = np.array([r["p_value"] for r in shape.normality(held, held.columns).collect()])
    assert 0.35 < p.mean() < 0.65 and (p < 0.05).mean() < 0.15
    bent = held.select(F.exp("c0").alias("c"), (F.col("c1") * F.col("c1") * F.col("c1")).alias("d"))
    assert all(r["p_value"] < 1e-6 for r in shape.normality(bent, ["c", "d"]).collect())
    odd = spark.createDataFrame([(1.0, 2.0)] * 9, "a double, b double").withColumn("gone", F.lit(None).cast("double"))
    assert [(r["n"], r["p_value"]) for r in shape.normality(odd, ["a", "gone"]).collect()] == [(9, None), (0, None)]


def test_deviates():
    """Symmetry, and the standard normal's own values for large samples."""
    for n in (20, 500):
        assert shape.skewness_z(0.0, n) == 0 and math.isclose(shape.skewness_z(0.4, n), -shape.skewness_z(-0.4, n))
    assert math.isclose(shape.skewness_z(0.01, 10**6), 0.01 / math.sqrt(6e-6), rel_tol=1e-3)
    assert math.isclose(shape.kurtosis_z(0.01, 10**6), 0.01 / math.sqrt(24e-6), rel_tol=5e-2)


def test_categories(spark):
    rows = [("b", 1), ("a", 1), ("b", None), ("a", 2), (None, 2), ("c", None)]
    held = spark.createDataFrame(rows, "k string, v int").withColumn("gone", F.lit(None).cast("string")).repartition(3)
    got = {r["column"]: (r["n"], r["distinct_values"], r["top"], r["frequency"]) for r in shape.describe_categories(held, ["k", "v", "gone"]).collect()}
    assert got == {"k": (5, 3, "a", 2), "v": (4, 2, "1", 2), "gone": (0, 0, None, 0)}


def test_covariances_and_missing(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    x[rng.random(300) < 0.3, 1] = np.nan
    y = rng.integers(0, 2, 300)
    held = spark.createDataFrame([(float(a), None if math.isnan(b) else float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int").withColumn("full", F.lit(1.0))
    both = ~np.isnan(x[:, 1])
    got = {(r["left"], r["right"]): (r["n"], r["covariance"]) for r in shape.covariances(held, ["a", "b"]).collect()}
    assert got["a", "b"][0] == both.sum() and math.isclose(got["a", "b"][1], np.cov(x[both].T)[0, 1], rel_tol=1e-9)
    assert shape.covariances(held.limit(1), ["a"]).first()["covariance"] is None
    rows = {r["column"]: r for r in shape.missing_association(held, ["b", "full"], "y").collect()}
    t = np.array([[(~both & (y == v)).sum() for v in (1, 0)], [(both & (y == v)).sum() for v in (1, 0)]], float)
    want = np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()
    statistic = (np.maximum(np.abs(t - want) - np.minimum(0.5, np.abs(t - want)), 0) ** 2 / want).sum()
    assert math.isclose(rows["b"]["p_value"], chi2_sf(statistic, 1), rel_tol=1e-6)
    assert math.isclose(rows["b"]["relation"], abs(np.corrcoef(~both, y)[0, 1]), rel_tol=1e-9) and rows["full"]["p_value"] is None


def test_rows_since(spark):
    rows = [(e, k, int((k * 7 + e) % 5 == 0)) for e in range(4) for k in range(12)]
    held = spark.createDataFrame(rows + [(None, 1, 1), (None, 2, 0)], "e int, k int, hit int").withColumn("place__", F.lit("mine")).repartition(3)
    out = shape.rows_since(held, F.col("hit") == 1, ["e"], ["k"], "since")
    assert out.columns == [*held.columns, "since"]
    got = {(r["e"], r["k"]): r["since"] for r in out.collect()}
    for e in range(4):
        last = None
        for _, k, hit in (r for r in rows if r[0] == e):
            last = k if hit else last
            assert got[e, k] == (None if last is None else k - last)
    assert got[None, 2] == 1


def test_encoding_of_numbers_and_unseen_keys(spark):
    train = spark.createDataFrame([(float(k), "uv"[k % 2], int(k > 20)) for k in range(40)] + [(None, None, 1)], "x double, c string, y int")
    new = spark.createDataFrame([(5.0, "u"), (35.0, "new"), (None, None), (1e9, "v")], "x double, c string")
    got = [r["code"] for r in binning.evidence_encoding(new, train, "x", "y", "code", 4).orderBy("x").collect()]
    assert got[0] < 0 < got[1] and got[2] == got[3] < 0  # a gap, then rising values
    rates = {r["c"]: r["code"] for r in binning.evidence_encoding(new, train, "c", "y", "code", value="bad_rate").collect()}
    assert math.isclose(rates["new"], 20 / 41) and rates[None] == 1.0


def test_fill_by_group_falls_back_to_the_whole_statistic(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 10.0)], "g string, v double")
    held = spark.createDataFrame([("a", None), ("b", None), ("c", None), (None, None), ("c", 7.0)], "g string, v double").withColumn("fill__", F.lit(0))
    out = imputation.fill_by_group(held, train, "v", ["g"], "median")
    assert out.columns == held.columns and Counter((r["g"], r["v"]) for r in out.collect()) == Counter([("a", 2.0), ("b", 3.0), ("c", 3.0), (None, 10.0), ("c", 7.0)])


@pytest.mark.parametrize("wide", [20, 3])
def test_wide_moments(spark, monkeypatch, wide):
    monkeypatch.setattr(models, "WIDE", wide)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    y = x @ np.arange(8.0) + rng.normal(size=400)
    w = rng.random(400)
    names = [f"c{k}" for k in range(8)]
    held = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)] + [(None, *[1.0] * 9)], ", ".join(f"{c} double" for c in [*names, "y", "w"])).repartition(3)
    g, v, yy, n = models.gram(held, names, F.col("y"), F.col("w"))
    full = np.column_stack([np.ones(400), x])
    assert n == 400 and np.allclose(g, full.T @ (full * w[:, None])) and np.allclose(v, full.T @ (w * y)) and math.isclose(yy, (w * y) @ y)


def test_a_fit_with_eighty_features(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 80))
    y = x @ rng.normal(size=80)
    names = [f"c{k}" for k in range(80)]
    held = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))
    fit = models.ordinary_least_squares(held, names, "y")
    assert np.allclose(fit.coefficients, np.linalg.lstsq(np.column_stack([np.ones(600), x]), y, rcond=None)[0], atol=1e-8)


def test_separable_classes_are_an_error(spark):
    held = spark.createDataFrame([(float(k), int(k > 50)) for k in range(100)], "x double, y int")
    with pytest.raises((ArithmeticError, np.linalg.LinAlgError)):
        models.iteratively_reweighted(held, ["x"], "y")


def test_joined_scores_and_their_table(spark):
    a = spark.createDataFrame([(k, k % 2, k / 100) for k in range(100)], "id int, y int, s double")
    b = spark.createDataFrame([(k, 0.1 + 0.8 * (k % 2)) for k in range(0, 100, 2)] + [(200, 0.5)] + [(k, 0.9) for k in range(1, 50, 2)], "id int, s double")
    joined = metrics.joined_scores(a, b, ["id"], "y", "s")
    assert joined.count() == 75
    rows = metrics.comparison_table(joined, "y", ["primary", "challenger"], "brier").orderBy("place").collect()
    assert [r["model"] for r in rows] == ["challenger", "primary"] and rows[0]["auc"] == 1.0
