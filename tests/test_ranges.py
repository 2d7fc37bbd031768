"""Ranks and searches over ranges: ties, nulls, odd names, many ranges."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import frameworks, quantiles, ranges, splits


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 100, 1000, 1024])
def test_count_below(spark, n):
    cuts = [float(k) for k in range(n)]
    xs = [-1.0, 0.0, 0.5, n / 2, n - 1.0, n - 0.5, n + 3.0, math.nan]
    held = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    got = [r[0] for r in held.select(ranges.count_below(F.col("x"), cuts)).collect()]
    assert got[:-1] == [n if math.isnan(x) else sum(c < x for c in cuts) for x in xs] and got[-1] == 0


ORDERS = {
    "ties": [(0, k) for k in range(300)] + [(1, k) for k in range(300, 320)],
    "nulls": [(None if k % 3 else k % 5, k) for k in range(200)],
    "distinct": [(k * 7919 % 1009, k) for k in range(500)],
    "one": [(5, 1)],
    "none": [],
}


@pytest.mark.parametrize("which", ORDERS)
@pytest.mark.parametrize("n", [None, 3, 200])
def test_ranks(spark, which, n):
    rows = ORDERS[which]
    held = spark.createDataFrame([(a, k, "x") for a, k in rows], "a int, k int, range__ string").repartition(4)
    got = {r["k"]: (r["place"], r["place_n"], r["range__"]) for r in splits.global_rank(held, ["a", "k"], ranges=n).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {k: (p, len(rows), "x") for p, (_, k) in enumerate(order, 1)}


def test_equal_leading_values_are_dealt_to_many_ranges(spark):
    held = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("a"), "id")
    sizes = [r["count"] for r in ranges.ranged(held, ["a", "id"], "at", 40).groupBy("at").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 4 * 20000 / 40


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string", "double", "decimal(9,2)"])
def test_order_types(spark, kind):
    start = datetime.datetime(2024, 3, 30, 22, 0, 0)
    values = [start + datetime.timedelta(minutes=7 * (k * 37 % 400), microseconds=k) for k in range(400)]
    held = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "t timestamp, k int")
    x = {"string": F.date_format("t", "ss:mm:HH"), "double": F.unix_micros("t") / 7.0, "decimal(9,2)": (F.col("k") * 31 % 97).cast("decimal(9,2)")}.get(kind, F.col("t").cast(kind) if kind.startswith(("time", "date")) else None)
    held = held.select(x.alias("a"), "k").repartition(3)
    ranked = splits.global_rank(held, ["a", "k"], "p", ranges=16)
    assert [r["k"] for r in ranked.orderBy("p").collect()] == [r["k"] for r in held.orderBy("a", "k").collect()]


def test_groups_and_clashes(spark):
    held = spark.createDataFrame([(g, k * 31 % 50, k) for k in range(150) for g in ("a", None)][:200], "g string, v int, k int")
    got = splits.global_rank(held, ["v", "k"], "p", ("g",), 5).collect()
    for g in ("a", None):
        own = [r for r in got if r["g"] == g]
        assert [r["p"] for r in sorted(own, key=lambda r: (r["v"], r["k"]))] == list(range(1, len(own) + 1)) and {r["p_n"] for r in own} == {len(own)}
    with pytest.raises(ValueError):
        splits.global_rank(held.withColumn("place", F.lit(1)), ["k"])
    own = held.where("g = 'a'").withColumns({"place": F.lit("mine"), "mixed": F.lit(1)})
    for out in (splits.chronological(own, ["k"], 0.5, 0.2), splits.stratified(own, "k", "g", 0.5, 0.2)):
        assert out.columns == [*own.columns, "split"] and {r["place"] for r in out.collect()} == {"mine"}
        assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 50, "validation": 20, "test": 30}


def test_several_columns_at_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    x[:, 1] = np.round(x[:, 1])
    x[rng.random(x.shape) < 0.2] = np.nan
    held = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double").withColumn("d", F.lit(None).cast("double"))
    grid = [k / 1000 for k in range(1001)]
    points = {"a": grid, "b": [0.1, 0.5], "c": [0.0, 1 / 3, 1.0], "d": [0.5]}
    for n in (None, 3, 300):
        got = quantiles.quantiles_of(held, {c: F.col(c) for c in "abcd"}, points, n)
        assert got["d"] == [None]
        for k, c in enumerate("abc"):
            assert np.allclose(got[c], np.nanquantile(x[:, k], points[c]), atol=1e-12)
    assert quantiles.quantiles_of(held, {}, {}) == {}


def test_running_shares_by_group(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(g, float(v)) for g, v in zip(rng.choice(list("ab"), 300), rng.integers(0, 150, 300))})
    counts = spark.createDataFrame([(g, v, k) for k, (g, v) in enumerate(rows)], "g string, v double, n bigint").repartition(4)
    got = {(r["g"], r["v"]): (r["n_upto"], r["n_all"]) for r in quantiles.running_shares(counts, "v", ["n"], 9, ("g",)).collect()}
    for g in "ab":
        own = [(v, k) for k, (h, v) in enumerate(rows) if h == g]
        assert [got[g, v] for v, _ in own] == [(int(u), sum(k for _, k in own)) for u in np.cumsum([k for _, k in own])]


def test_isotonic_pools_over_ranges(spark):
    rng = np.random.default_rng(7)
    score = rng.random(3000)
    y = (rng.random(3000) < score**2).astype(int)
    held = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)] + [(None, 1), (0.5, None)], "s double, t int").repartition(5)
    order = np.argsort(score)
    want = [(s, e / n) for s, n, e in frameworks.pooled_steps((float(score[k]), 1.0, float(y[k])) for k in order)]
    got = frameworks.isotonic(held, "t", "s")
    assert [s for s, _ in got] == [s for s, _ in want] and np.allclose([r for _, r in got], [r for _, r in want])
    assert [r for _, r in got] == sorted(r for _, r in got) and len(got) < 100
    assert frameworks.isotonic(held.limit(0), "t", "s") == []
