"""Interaction screens and draws of a fixed size against brute force."""

import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import resampling as R
from gritstone.operators import screening as S


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(31)
    n, k = 600, 30
    x = rng.normal(size=(n, k)) * rng.uniform(0.1, 50, k) + rng.normal(size=k) * 10
    y = x[:, 0] / x[:, 0].std() * x[:, 1] / x[:, 1].std() + rng.normal(size=n)
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 29] = 4.0  # constant: products with it are still products
    y[:5] = np.nan
    level = rng.choice(["red", "green", None, "blue", "rare"], n, p=[0.4, 0.3, 0.2, 0.07, 0.03])
    return x, y, level


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, level = data
    clean = lambda v: None if math.isnan(v) else float(v)
    rows = [(*map(clean, r), clean(t), v) for r, t, v in zip(x, y, level)]
    return spark.createDataFrame(rows, ", ".join(f"f{j} double" for j in range(30)) + ", y double, colour string").repartition(5).persist()


def r_of(product, y):
    both = ~np.isnan(product) & ~np.isnan(y)
    a, b = product[both], y[both]
    return (abs(np.corrcoef(a, b)[0, 1]), both.sum()) if len(a) >= 10 and np.ptp(a) > 0 else (None, both.sum())


def wanted(data, levels=3):
    x, y, level = data
    out = {}
    for i, j in combinations(range(30), 2):
        out[f"f{i}", f"f{j}", None] = r_of(x[:, i] * x[:, j], y)
    named = np.array(["Missing" if v is None else v for v in level])
    top = sorted(Counter(named.tolist()).items(), key=lambda p: (-p[1], p[0]))[:levels]
    for v, _ in top:
        for i in range(30):
            out[f"f{i}", "colour", v] = r_of((named == v) * x[:, i], y)
    return {k: v for k, v in out.items() if v[0] is not None}


@pytest.mark.parametrize("block", [128, 7])
def test_all_pairs_in_one_tensor(table, data, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    found = S.interaction_screen(table, [f"f{j}" for j in range(30)], ["colour"], "y", most=10, levels=3)
    want = wanted(data)
    assert {(c.source, c.secondary, c.level) for c in found} == want.keys()
    for c in found:
        r, n = want[c.source, c.secondary, c.level]
        assert math.isclose(c.score, r, rel_tol=1e-7, abs_tol=1e-10) and c.rows == n
    assert (found[0].source, found[0].secondary) == ("f0", "f1") and [c.selected for c in found] == [True] * 10 + [False] * (len(found) - 10)
    assert [c.score for c in found] == sorted((c.score for c in found), reverse=True)
    flagged = next(c for c in found if c.level)
    got = table.select(F.corr(flagged.column(), "y")).first()[0]
    assert math.isclose(abs(got), flagged.score, rel_tol=1e-7)


def test_screen_of_odd_tables(spark, table):
    assert S.interaction_screen(table.limit(0), ["f0", "f1"], ["colour"], "y") == []
    assert S.interaction_screen(table.limit(9), ["f0", "f1"], [], "y") == []
    assert S.interaction_screen(table.withColumn("y", F.lit(1.0)), ["f0", "f1"], [], "y") == []
    assert all(c.score >= 0.2 for c in S.interaction_screen(table, ["f0", "f1", "f2"], [], "y", least_score=0.2))


def number(*parts):
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("rows", [None, 7, 250])
def test_bootstrap_draws_exactly(spark, rows):
    held = spark.createDataFrame([(k * k - 50, float(k), "old") for k in range(90)], "id bigint, v double, place string").repartition(4)
    got = R.bootstrap_counts(held, "id", 3, rows, 9).collect()
    n = rows or 90
    want = Counter((k, number(9, k, i) % 90 + 1) for k in range(3) for i in range(n))
    assert {(r["replicate"], r["place"]): r["n"] for r in got} == dict(want)
    assert all(sum(r["n"] for r in got if r["replicate"] == k) == n for k in range(3))
    drawn = R.bootstrap_rows(held.drop("place"), "id", 3, rows, 9).collect()
    place = {k * k - 50: p for p, k in enumerate(sorted(range(90), key=lambda k: k * k), 1)}
    assert Counter({(r["replicate"], place[r["id"]]): r["times"] for r in drawn}) == want
    assert R.bootstrap_rows(held.limit(0).drop("place"), "id", 3, rows, 9).count() == 0


def test_bootstrap_is_even(spark):
    counts = R.bootstrap_counts(spark.range(2000), "id", 30).groupBy("place").agg(F.sum("n").alias("n")).collect()
    n = np.array([r["n"] for r in counts])
    assert abs(n.mean() - 30) < 0.1 and 0.85 < n.var() / 30 < 1.15
    share = R.bootstrap_counts(spark.range(2000), "id", 10).groupBy("replicate").count().agg(F.avg("count")).first()[0] / 2000
    assert abs(share - (1 - math.exp(-1))) < 0.01


def test_positional_sample_shares_places(spark):
    a = spark.createDataFrame([(k, k * 10) for k in range(50)], "id bigint, v bigint").repartition(3)
    b = spark.createDataFrame([(k + 1000, k * 10) for k in range(50)], "id bigint, v bigint").repartition(5)
    got = R.positional_sample({"a": a, "b": b}, "id", 8)
    first = sorted(r["id"] for r in got["a"].collect())
    assert first == sorted(r["id"] - 1000 for r in got["b"].collect()) and len(first) == 8
    assert first == sorted(k - 1 for k in sorted(range(1, 51), key=lambda k: (number(42, k), k))[:8])
    assert R.positional_sample({"a": a}, "id", 50)["a"].count() == 50
    with pytest.raises(ValueError):
        R.positional_sample({"a": a, "b": b.limit(3)}, "id", 2)
