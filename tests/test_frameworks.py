"""Scorecards, calibration and filters against plain Python; empty tables, nulls and ties; streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import frameworks as W
from gritstone.operators import scorecard, transforms
from gritstone.operators.transforms import Transform
from gritstone.plans import paging
from gritstone.streaming import scoring


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1500)
    bad = (rng.random(1500) < 1 / (1 + np.exp(1 - x))).astype(int)
    rows = [(k, float(v) if k % 11 else None, ["a", "b", None][k % 3], int(t), round(float(1 / (1 + math.exp(1 - 0.5 * v))), 2)) for k, (v, t) in enumerate(zip(x, bad))]
    return spark.createDataFrame(rows, "id bigint, x double, kind string, bad int, score double").persist()


def test_merged_bins():
    # the third bin is small and joins the fourth; then the second and the new third are out of order
    assert scorecard.merged_edges([1.0, 2.0, 3.0, 4.0], [100, 100, 2, 100, 100], [10, 30, 1, 20, 50], 0.05) == [1.0, 4.0]
    assert scorecard.merged_edges([1.0], [5, 5], [1, 1], 0.5) == [1.0]
    for seed in range(50):
        rng = np.random.default_rng(seed)
        n = rng.integers(1, 200, 8)
        bad = rng.binomial(n, 0.3)
        kept = scorecard.merged_edges(list(range(1, 8)), n, bad, 0.05)
        cuts = [0, *kept, 8]
        parts = [(n[a:b].sum(), bad[a:b].sum()) for a, b in zip(cuts, cuts[1:])]
        rates = [b / m for m, b in parts]
        assert sum(m for m, _ in parts) == n.sum()
        assert len(parts) == 2 or rates == sorted(rates) or rates == sorted(rates, reverse=True)
        assert len(parts) == 2 or all(m >= 0.05 * n.sum() for m, _ in parts)


def test_scorecard_points_row_by_row(loans):
    features = {"x": scorecard.fit_edges(loans, "x", "bad"), "kind": None}
    fitted = scorecard.fit_scorecard(loans, features, "bad")
    unseen = loans.unionByName(loans.limit(1).withColumn("kind", F.lit("new")))
    for r in fitted.apply(unseen, 1).collect():
        number = None if r["x"] is None else sum(r["x"] > e for e in features["x"])
        labels = {"x": "MISSING" if number is None else str(number), "kind": r["kind"] or "MISSING"}
        factor = 20 / math.log(2)
        points = {f: -factor * b * fitted.weights[f].get(labels[f], fitted.unseen[f]) for f, b in zip(fitted.model.features, fitted.model.coefficients[1:])}
        for f, p in points.items():
            assert math.isclose(r[f"points_{f}"], p, abs_tol=1e-9)
        assert math.isclose(r["score_points"], 600 - factor * math.log(50) - factor * fitted.model.coefficients[0] + sum(points.values()), abs_tol=1e-6)
        assert r["reasons"] == [min(points, key=lambda f: (points[f], f))]


def test_isotonic_and_platt(loans):
    steps = W.isotonic(loans, "bad", "score")
    assert [s for s, _ in steps] == sorted(s for s, _ in steps) and [p for _, p in steps] == sorted(p for _, p in steps)
    rows = loans.select("score", "bad").collect()
    value = lambda s: next(p for low, p in reversed(steps) if s >= low)
    assert math.isclose(sum(value(r["score"]) for r in rows), sum(r["bad"] for r in rows), abs_tol=1e-6)
    a, b, calibrated = W.platt(loans, "bad", "score")
    held = loans.select("bad", calibrated.alias("p"), F.log(F.col("score") / (1 - F.col("score"))).alias("l")).collect()
    assert abs(sum(r["bad"] - r["p"] for r in held)) < 1e-6 and abs(sum((r["bad"] - r["p"]) * r["l"] for r in held)) < 1e-6


def test_correlation_filter():
    matrix = np.array([[1, 0.9, 0.1], [0.9, 1, 0.8], [0.1, 0.8, 1]])
    assert W.correlation_filter(matrix, ["a", "b", "c"], {"a": 0.5, "b": 0.4, "c": 0.4}, 0.75) == [("a", None), ("b", "a"), ("c", None)]


def test_dickey_fuller_with_a_lag(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=80))
    got = W.augmented_dickey_fuller(spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "t int, y double"), "t", "y", 1).first()
    d = np.diff(y)
    x = np.column_stack([np.ones(78), y[1:-1], d[:-1]])
    b, *_ = np.linalg.lstsq(x, d[1:], rcond=None)
    e = d[1:] - x @ b
    want = b[1] / math.sqrt(e @ e / 75 * np.linalg.inv(x.T @ x)[1, 1])
    assert got["n"] == 78 and math.isclose(got["statistic"], want, rel_tol=1e-8)


def test_transforms_of_empty_and_null_training_columns(spark):
    train = spark.createDataFrame([], "split string, x double")
    kinds = ("winsorize", "robust_scale", "min_max_scale", "standard_scale", "center_mean", "log1p", "percentile_rank")
    fitted = transforms.fit(train, [Transform(k, "x", k) for k in kinds])
    rows = transforms.apply(spark.createDataFrame([("test", 1.0), ("test", None)], "split string, x double"), fitted).collect()
    assert len(rows) == 2 and all(rows[0][k] is None for k in ("robust_scale", "min_max_scale", "center_mean", "log1p"))


def test_log1p_needs_a_training_minimum_above_minus_one(spark):
    table = spark.createDataFrame([(-1.0,), (3.0,)], "x double")
    out = transforms.apply(table, transforms.fit(table, [Transform("log1p", "x", "y")])).collect()
    assert [r["y"] for r in out] == [None, None]


def test_filter_names_in_any_case(spark):
    table = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r["x"] for r in paging.filtered(table, [{"column": "x", "op": "EQ", "value": 2}]).collect()] == [2]


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    want = sorted(map(tuple, scoring.windowed(events, "ts", "event_type", "value").collect()), key=str)
    got = run(scoring.windowed(stream(), "ts", "event_type", "value"), "windowed", "complete")
    assert [r[:3] for r in got] == [r[:3] for r in want]
    scored = run(scoring.scored_stream(stream(), {"twice": F.col("value") * 2}).select("event_id", "twice"), "scored", "append")
    assert scored == sorted(map(tuple, events.select("event_id", (F.col("value") * 2).alias("twice")).collect()), key=str)
