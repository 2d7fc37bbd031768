"""Nearest-neighbour and chained imputation against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import chained, neighbours
from gritstone.operators.neighbours import knn_impute


def brute_fill(rows, train, k):
    """rows and train: (key, value, x...); the mean over the k nearest by (mean squared difference, key)."""
    donors = [(key, v, x) for key, v, *x in train if v is not None and math.isfinite(v)]
    mean = sum(v for _, v, _ in donors) / len(donors)
    out = {}
    for key, v, *x in rows:
        if v is not None and math.isfinite(v):
            out[key] = v
            continue
        found = []
        for other, w, y in donors:
            both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and math.isfinite(a) and math.isfinite(b)]
            if both:
                total = 0.0
                for a, b in both:
                    total += (a - b) ** 2
                found.append((total / len(both), other, w))
        found = sorted(found)[:k]
        out[key] = sum(w for *_, w in found) / len(found) if found else mean
    return out


def made(seed, n, dims=3, gaps=0.2, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims + 1)) if levels is None else rng.integers(0, levels, (n, dims + 1)).astype(float)
    lost = rng.random(x.shape) < gaps
    return [(int(i), *(None if g else float(v) for v, g in zip(r, ls))) for i, (r, ls) in enumerate(zip(x, lost))]


SCHEMA = "id bigint, v double, a double, b double, c double"


def check(spark, rows, train, k=5, parts=4):
    held, known = (spark.createDataFrame(r, SCHEMA).withColumns({"pattern": F.lit("extra"), "x0": F.lit(1), "fill": F.lit(2)}).repartition(parts) for r in (rows, train))
    got = knn_impute(held, known, "v", ["v", "a", "b", "c"], "id", k)
    assert got.columns == held.columns
    want = brute_fill(rows, train, k)
    found = {r["id"]: r["v"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], rel_tol=1e-12, abs_tol=1e-12) for i in want)


@pytest.mark.parametrize("small", [False, True])
def test_neighbours(spark, monkeypatch, small):
    if small:  # many cells, many blocks
        for name, value in {"CELL_ROWS": 20, "BLOCK_DONORS": 15, "BLOCK_RECEIVERS": 7, "HELD": 100, "SAMPLE": 600}.items():
            monkeypatch.setattr(neighbours, name, value)
    rows = made(1, 2000)
    check(spark, rows, rows)


def test_ties_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 30)
    rows = made(2, 500, levels=3)
    check(spark, rows, rows, 3)


def test_hot_points_and_other_training_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 25)
    hot = [(5000 + k, float(k) if k % 2 else None, 0.5, 0.5, 0.5) for k in range(400)]
    check(spark, made(3, 300) + hot, made(4, 400) + hot, 4)


def test_odd_rows(spark):
    train = [(1, 1.0, 0.0, None, None), (2, 3.0, None, 1.0, None), (3, math.inf, 0.0, 0.0, 0.0), (4, math.nan, 0.0, 0.0, 0.0), (5, None, 0.0, 0.0, 0.0), (6, 8.0, math.nan, math.inf, None)]
    rows = [(10, None, 0.1, None, None), (11, None, None, None, None), (12, None, None, None, 5.0), (13, math.nan, 0.0, 2.0, 1.0), (14, 7.0, None, None, None), (15, None, math.inf, 1.5, None)]
    check(spark, rows, train, 2, 2)
    check(spark, rows, train, 50, 2)
    empty = spark.createDataFrame([], SCHEMA)
    held = spark.createDataFrame(rows, SCHEMA)
    assert knn_impute(empty, held, "v", ["a"], "id").count() == 0
    assert {r["id"]: r["v"] for r in knn_impute(held.where("id = 11"), empty, "v", ["a"], "id").collect()} == {11: None}


def test_rows_with_gaps_search_few_cells(spark, monkeypatch):
    # a row with one column only is near a whole stripe of the cells of two
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    train = made(8, 6000, 2, 0.0)
    rows = [(i, None, a if i % 2 else None, None if i % 2 else b) for i, _, a, b in made(12, 300, 2, 0.0)]
    schema = "id bigint, v double, a double, b double"
    table, known = spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(train, schema).repartition(4)
    searched = neighbours._searched
    asked = []

    def counted(routed, *more):
        asked.append(routed.count())
        return searched(routed, *more)

    monkeypatch.setattr(neighbours, "_searched", counted)
    got = knn_impute(table, known, "v", ["a", "b"], "id", 3)
    assert len(asked) == 2 and sum(asked) < 4 * len(rows)
    want = brute_fill(rows, train, 3)
    assert all(math.isclose(v, want[i], rel_tol=1e-12, abs_tol=1e-12) for i, v in got.select("id", "v").collect())


@pytest.mark.parametrize("projections", [0, 1])
def test_patterns_beyond_the_projections(spark, monkeypatch, projections):
    for name, value in {"PROJECTIONS": projections, "CELL_ROWS": 20, "BLOCK_DONORS": 15, "BLOCK_RECEIVERS": 7}.items():
        monkeypatch.setattr(neighbours, name, value)
    rows = made(9, 900)
    check(spark, rows, rows, 4)
    levels = made(10, 400, levels=3)
    check(spark, levels, levels, 4)


def test_views_cover_what_is_shared():
    laid, asked = neighbours._views([0, 1, 3, 7], {0: 5, 1: 4, 3: 9, 4: 1})
    kept = {view: (pattern, c) for pattern, view, c in laid}
    assert len(kept) == len(laid) and all(c and c & p == c for p, c in kept.values())
    for receiver in (1, 3, 4):
        met = {kept[view][0]: (kept[view][1], c) for p, view, c in asked if p == receiver}
        assert met == {d: (receiver & d, receiver & d) for d in (1, 3, 7) if receiver & d}
    assert not [p for p, *_ in asked if p == 0]


@pytest.mark.parametrize("dims, levels, k", [(1, None, 5), (2, None, 5), (3, 4, 7), (2, 3, 40)])
def test_leaves_of_a_block(monkeypatch, dims, levels, k):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 12)
    monkeypatch.setattr(neighbours, "HELD", 500)
    rng = np.random.default_rng(11)
    others, points = (rng.normal(size=(n, dims)) if levels is None else rng.integers(0, levels, (n, dims)).astype(float) for n in (700, 90))
    others, points = (np.column_stack([x, np.full(len(x), np.nan)]) for x in (others, points))
    held = neighbours.distances(points, others)
    want = np.argsort(held, axis=1, kind="stable")[:, :k]
    reached = np.take_along_axis(held, want, axis=1)
    for limit in (np.full(90, np.inf), reached[:, -1]):
        row, chosen, found = neighbours.nearest(points, others, limit, k)
        assert (row == np.repeat(np.arange(90), k)).all() and (chosen.reshape(90, k) == want).all() and (found.reshape(90, k) == reached).all()
    assert not len(neighbours.nearest(points, others[:0], np.full(90, np.inf), k)[0])


def test_nearest_donors_by_place(spark):
    train = spark.createDataFrame([(3, 1.0, 0.0, 5.0), (1, 2.0, 1.0, None), (2, 4.0, 1.0, None), (4, 8.0, None, 2.0)], "id bigint, v double, a double, b double")
    table = spark.createDataFrame([(9, None, 0.25, None), (10, None, None, 2.5), (11, None, None, None)], "id bigint, v double, a double, b double")
    got = neighbours.nearest_donors(table, train, "v", ["a", "b"], "id", 2).select("x0", "x1", "distance", "key", "value", "place").collect()
    assert {tuple(r) for r in got} == {(0.25, None, 0.0625, 3, 1.0, 1), (0.25, None, 0.5625, 1, 2.0, 2), (None, 2.5, 0.25, 4, 8.0, 1), (None, 2.5, 6.25, 3, 1.0, 2)}


def test_few_boxes_are_opened():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4000, 2))
    tree = neighbours.Tree.learn(points, 50)
    leaf = tree.leaf(points)
    sizes = np.bincount(leaf)
    assert sizes.max() <= 60 and len(sizes) == tree.leaves
    low, high = (np.array([f(points[leaf == k], axis=0) for k in range(tree.leaves)]) for f in (np.min, np.max))
    cells = neighbours.Cells(low, high, sizes, np.zeros(tree.leaves, int), np.arange(tree.leaves))
    near, far = cells.bounds(points[:200])
    true = np.sort(neighbours.distances(points[:200], points), axis=1)[:, 4]
    assert (cells.promised(far, 5) >= true).all()
    assert (near <= true[:, None]).sum(axis=1).mean() < 6


def test_auxiliary_columns(spark):
    held = spark.createDataFrame([(1.0, None, 2.0, None), (1.0, 1.0, None, None)], "d double, b double, a double, c double")
    assert neighbours.auxiliary_columns(held, "c", ["a", "b", "c", "d"], 3) == ["c", "d", "a"]


# chained
def reference_chain(x, rounds, tolerance=1e-3):
    gaps = np.isnan(x)
    means = np.nanmean(x, axis=0)
    limit = tolerance * np.nanmax(np.abs(x))
    held = np.where(gaps, means, x)
    order = [j for j in sorted(range(x.shape[1]), key=lambda j: (gaps[:, j].sum(), "abcd"[j])) if gaps[:, j].any()]
    for _ in range(rounds):
        before = held.copy()
        for j in order:
            others = [i for i in range(x.shape[1]) if i != j]
            known = ~gaps[:, j]
            a, y = held[known][:, others], held[known, j]
            ac, yc = a - a.mean(axis=0), y - y.mean()
            b = chained.bayesian_ridge(ac.T @ ac, ac.T @ yc, yc @ yc, len(y))
            held[~known, j] = y.mean() + (held[~known][:, others] - a.mean(axis=0)) @ b
        if np.abs(held - before).max() < limit:
            return held, True
    return held, False


def correlated(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 10 * rng.normal(size=4)
    x[rng.random(x.shape) < np.array([0.3, 0.1, 0.2, 0.0])] = np.nan
    return x


def test_chained_rounds_equal_numpy(spark):
    x = correlated(6, 700)
    rows = [(k, *(None if math.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)]
    table = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double").repartition(5)
    for rounds in (1, 3, 40):
        want, settled = reference_chain(x, rounds)
        imputer = chained.chained_imputer(table, list("abcd"), rounds)
        assert imputer.converged == settled and len(imputer.rounds) <= rounds
        got = np.array([r[1:] for r in imputer.transform(table).orderBy("id").collect()])
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    assert imputer.converged and imputer.moved[-1] < imputer.moved[0]


def test_bayesian_ridge_recovers_a_line():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 3))
    y = x @ np.array([1.0, -2.0, 0.0]) + 0.1 * rng.normal(size=5000)
    x, y = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(chained.bayesian_ridge(x.T @ x, x.T @ y, y @ y, 5000), [1, -2, 0], atol=0.01)


def test_chained_odd_tables(spark):
    schema = "id bigint, a double, b double, note string"
    table = spark.createDataFrame([(1, 1.0, 2.0, "x"), (2, None, 4.0, None), (3, 3.0, 6.0, "y"), (4, math.nan, math.inf, "z"), (5, 5.0, 10.0, "w"), (6, 2.0, 4.0, "v")], schema)
    imputer = chained.chained_imputer(table, ["a", "b"])
    got = {r["id"]: (r["a"], r["b"], r["note"]) for r in imputer.transform(table).collect()}
    assert got[1] == (1.0, 2.0, "x") and abs(got[2][0] - 2) < 0.01 and all(math.isfinite(v) for v in got[4][:2])
    assert imputer.transform(spark.createDataFrame([], schema)).count() == 0
    whole = table.where("id in (1, 3)")
    assert chained.chained_imputer(whole, ["a", "b"]).transform(whole).orderBy("id").collect() == whole.orderBy("id").collect()
    with pytest.raises(ValueError):
        chained.chained_imputer(table.where("id = 4"), ["a", "b"])
