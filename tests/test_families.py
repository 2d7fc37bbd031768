"""Multinomial, penalised, additive, grouped and tree models against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import additive_boosting as B
from gritstone.operators import extra_trees as E
from gritstone.operators import grouped_models as G
from gritstone.operators import penalised as P
from gritstone.operators import splines as S

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    n = 900
    x = rng.normal(size=(n, 3)) * [1, 20, 0.1] + [0, 100, 3]
    z = (x - [0, 100, 3]) / [1, 20, 0.1]
    group = np.where(np.arange(n) < n // 2, 0, rng.integers(1, 60, n))
    lift = rng.normal(size=60)
    eta = np.column_stack([np.zeros(n), 0.5 + z[:, 0] - z[:, 1], -0.5 + 0.7 * z[:, 2]])
    chance = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
    kind = np.array([rng.choice(3, p=p) for p in chance])
    binary = (rng.random(n) < 1 / (1 + np.exp(-(z[:, 0] - 0.5 * z[:, 1] + lift[group])))).astype(float)
    number = 2 + z[:, 0] + np.sin(2 * z[:, 1]) + 0.8 * lift[group] + 0.5 * rng.normal(size=n)
    return {"x": x, "group": group, "kind": kind, "binary": binary, "number": number}


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(k, *map(float, data["x"][k]), int(data["group"][k]) or None, "klm"[data["kind"][k]], float(data["binary"][k]), float(data["number"][k])) for k in range(len(data["x"]))]
    odd = [(-1, None, 1.0, 1.0, 1, "k", 1.0, 1.0), (-2, math.nan, 1.0, 1.0, 1, "k", 1.0, 1.0), (-3, 1.0, 1.0, math.inf, None, "l", 0.0, 1.0)]
    return spark.createDataFrame(rows + odd, "id bigint, a double, b double, c double, grp int, kind string, y double, v double").repartition(6).persist()


def ones(x):
    return np.column_stack([np.ones(len(x)), x])


def values(table, column):
    return np.array([r["p"] for r in table.where("id >= 0").orderBy("id").select(column.alias("p")).collect()])


# multinomial
def test_multinomial_meets_its_score_equations(table, data):
    model = P.multinomial_logistic(table, FEATURES, "kind")
    assert model.classes == ["k", "l", "m"] and not model.coefficients[0].any()
    x, y = ones(data["x"]), np.eye(3)[data["kind"]]
    score = x @ model.coefficients.T
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    assert np.abs((y - p).T @ x).max() < 1e-6
    assert math.isclose(model.log_likelihood, np.log(p[np.arange(len(p)), data["kind"]]).sum(), rel_tol=1e-10)
    information = np.block([[(x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x for b in (1, 2)] for a in (1, 2)])
    assert np.allclose(model.covariance, np.linalg.inv(information), rtol=1e-5)
    got = np.column_stack([values(table, c) for c in model.probabilities()])
    assert np.allclose(got, p, atol=1e-12)
    assert (values(table, model.predict()) == np.array(list("klm"))[p.argmax(axis=1)]).all()


def test_multinomial_ridge(table, data):
    ridge = 5.0
    model = P.multinomial_logistic(table, FEATURES, "kind", ridge)
    mean, spread = data["x"].mean(axis=0), data["x"].std(axis=0)
    x, y = ones((data["x"] - mean) / spread), np.eye(3)[data["kind"]]
    slopes = model.coefficients[:, 1:] * spread
    at = np.column_stack([model.coefficients[:, 0] + model.coefficients[:, 1:] @ mean, slopes])
    score = x @ at.T
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    gradient = (y - p).T @ x
    gradient[:, 1:] -= ridge * slopes
    assert np.abs(gradient).max() < 1e-6 and np.abs(at.sum(axis=0)).max() < 1e-7


def test_multinomial_refuses(table):
    with pytest.raises(ValueError):
        P.multinomial_logistic(table.where("kind = 'k'"), FEATURES, "kind")
    with pytest.raises((ArithmeticError, np.linalg.LinAlgError)):
        P.multinomial_logistic(table.withColumn("kind", F.col("a") > 0), ["a"], "kind")


# elastic net
@pytest.mark.parametrize("mix", [1.0, 0.5, 0.0])
def test_elastic_net_logistic_meets_its_optimality_conditions(table, data, mix):
    path = P.elastic_net_logistic(table, FEATURES, "y", mix, steps=4) if mix else P.elastic_net_logistic(table, FEATURES, "y", mix, [0.1, 0.01])
    mean, spread = data["x"].mean(axis=0), data["x"].std(axis=0)
    z, y = (data["x"] - mean) / spread, data["binary"]
    for penalty, model in zip(path.penalties, path.models):
        p = 1 / (1 + np.exp(-ones(data["x"]) @ model.coefficients))
        b = model.coefficients[1:] * spread
        pull = z.T @ (p - y) / len(y) + penalty * (1 - mix) * b
        assert abs((p - y).mean()) < 1e-9
        for g, v in zip(pull, b):
            assert abs(g + penalty * mix * np.sign(v)) < 1e-8 if v else abs(g) <= penalty * mix + 1e-9
    if mix:
        assert not path.models[0].coefficients[1:].any() and np.count_nonzero(path.models[-1].coefficients[1:]) >= 2
        assert math.isclose(path.largest, np.abs(z.T @ (y.mean() - y) / len(y)).max() / mix, rel_tol=1e-9)
    assert path.losses == sorted(path.losses, reverse=True)
    assert 0 <= path.chosen() < len(path.models)


# splines
def test_b_splines_sum_to_one_and_are_smooth(spark):
    basis = S.b_splines(-1.0, 3.0, 5, 3)
    x = np.linspace(-2, 4, 601)
    got = basis.values(x)
    assert got.shape[1] == 7 and np.allclose(got.sum(axis=1), 1) and (got > -1e-12).all()
    inner = (x > -1) & (x < 3)
    assert np.abs(np.diff(got[inner], 3, axis=0)).max() < 2e-5
    assert np.allclose(got[0], basis.values(np.array([-1.0]))[0]) and np.allclose(got[-1], basis.values(np.array([3.0]))[0])
    knots = -1 + np.arange(-3, 8)  # the recursion by its definition
    def direct(j, d, t):
        if d == 0:
            return ((knots[j] <= t) & (t < knots[j + 1])).astype(float)
        return (t - knots[j]) / (knots[j + d] - knots[j]) * direct(j, d - 1, t) + (knots[j + d + 1] - t) / (knots[j + d + 1] - knots[j + 1]) * direct(j + 1, d - 1, t)
    assert np.allclose(got[inner], np.column_stack([direct(j, 3, x[inner]) for j in range(7)]))
    held = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    columns = held.select("x", *(c.alias(f"f{k}") for k, c in enumerate(basis.columns(F.col("x"))))).collect()
    assert np.allclose(np.array([r[1:] for r in columns[:-1]]), got, atol=1e-12) and columns[-1][1] is None


def test_natural_splines_interpolate(spark):
    knots = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    basis = S.natural_splines(knots)
    assert np.allclose(basis.values(knots), np.eye(5), atol=1e-12)
    x = np.linspace(-3, 10, 1301)
    got = basis.values(x)
    assert np.allclose(got.sum(axis=1), 1) and np.allclose(got @ knots, x)  # constants and lines are kept
    outer = got[(x < 0) | (x > 7)]
    assert np.abs(np.diff(got[x < 0], 2, axis=0)).max() < 1e-9 and np.abs(np.diff(got[x > 7], 2, axis=0)).max() < 1e-9 and len(outer)
    bend = np.diff(got, 2, axis=0) / 0.01**2
    assert np.abs(np.diff(bend, axis=0)).max() < 0.05  # no jump of the second derivative
    held = spark.createDataFrame([(float(v),) for v in range(9)], "x double")
    fitted = S.natural_spline(held, "x")
    assert np.allclose(fitted.breaks, [0, 8 / 3, 16 / 3, 8])
    with pytest.raises(ValueError):
        S.natural_spline(held.limit(5), "x")


def dense_basis(data, knots=5, degree=3):
    parts = []
    for j in range(3):
        x = data["x"][:, j]
        parts.append(S.b_splines(x.min(), x.max(), knots, degree).values(x)[:, :-1])
    raw = np.column_stack(parts)
    return raw, (raw - raw.mean(axis=0)) / raw.std(axis=0)


def test_additive_regression_equals_a_dense_fit(table, data):
    _, z = dense_basis(data)
    y, n = data["number"], len(data["number"])
    found = []
    for penalty in [10.0**k for k in range(-3, 6)]:
        inverse = np.linalg.inv(z.T @ z + penalty * np.eye(z.shape[1]))
        b = inverse @ z.T @ (y - y.mean())
        used = 1 + np.trace(z @ inverse @ z.T)
        found.append((n * ((y - y.mean() - z @ b) ** 2).sum() / (n - used) ** 2, penalty, b, used))
    _, penalty, b, used = min(found, key=lambda f: f[0])
    model = S.additive_splines(table, FEATURES, "v")
    assert model.penalty == penalty and math.isclose(model.used, used, rel_tol=1e-6)
    assert np.allclose(values(table, model.predict()), y.mean() + z @ b, atol=1e-7)
    fixed = S.additive_splines(table, FEATURES, "v", penalties=[100.0])
    b = np.linalg.solve(z.T @ z + 100 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(values(table, fixed.predict()), y.mean() + z @ b, atol=1e-7)


def test_additive_logistic_equals_a_dense_fit(table, data):
    raw, _ = dense_basis(data)
    y, spread = data["binary"], raw.std(axis=0)
    model = S.additive_splines(table, FEATURES, "y", binary=True, penalties=[3.0])
    p = values(table, model.predict())
    # the penalised score equations at the fitted probabilities, for weights of basis functions with unit deviation
    assert abs((y - p).mean()) < 1e-8
    assert np.abs((raw / spread).T @ (y - p) - 3.0 * model.weights).max() < 1e-5
    chosen = S.additive_splines(table, FEATURES, "y", binary=True)
    assert chosen.penalty in [10.0**k for k in range(-3, 6)]


# groups
def dense_likelihood(x, y, group, ratio, restricted):
    n, p = x.shape
    v = np.eye(n) + ratio * (group[:, None] == group)
    inverse = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    r = y - x @ b
    free = n - p if restricted else n
    s2 = r @ inverse @ r / free
    value = -0.5 * (free * math.log(2 * math.pi * s2) + free + np.linalg.slogdet(v)[1])
    return (value - 0.5 * np.linalg.slogdet(x.T @ inverse @ x)[1] if restricted else value), b, s2, np.linalg.inv(x.T @ inverse @ x) * s2


@pytest.mark.parametrize("restricted", [False, True])
def test_mixed_effects_equal_a_dense_likelihood(table, data, restricted):
    model = G.mixed_effects(table, FEATURES, "v", "grp", restricted)
    x, y, group = ones((data["x"] - data["x"].mean(axis=0)) / data["x"].std(axis=0)), data["number"], data["group"]
    ratio = model.group_variance / model.residual_variance
    value, b, s2, _ = dense_likelihood(x, y, group, ratio, restricted)
    assert math.isclose(model.residual_variance, s2, rel_tol=1e-8) and math.isclose(model.log_likelihood, value, rel_tol=1e-9)
    step = 1e-3  # the maximum: the slope's root by parabola through dense values
    up, down = (dense_likelihood(x, y, group, ratio * math.exp(d), restricted)[0] for d in (step, -step))
    assert abs((up - down) / (up - 2 * value + down) * step / 2) < 1e-5
    _, raw, _, covariance = dense_likelihood(ones(data["x"]), y, group, ratio, restricted)
    assert np.allclose(model.coefficients, raw, rtol=1e-7) and np.allclose(model.covariance, covariance, rtol=1e-6)
    got = {r["group"]: (r["n"], r["effect"]) for r in model.effects().collect()}
    r = y - ones(data["x"]) @ raw
    for g in np.unique(group):
        own = r[group == g]
        n, effect = got[int(g) or None]
        assert n == len(own) and math.isclose(effect, ratio * own.sum() / (1 + ratio * len(own)), rel_tol=1e-6, abs_tol=1e-9)
    assert np.allclose(values(table, model.predict()), ones(data["x"]) @ raw, rtol=1e-8)


def test_mixed_effects_without_any(table):
    model = G.mixed_effects(table.withColumn("grp", F.col("id") % 7), FEATURES, "v", "grp")
    assert model.group_variance < 0.1
    alone = G.mixed_effects(table.withColumn("grp", F.lit(1)), FEATURES, "v", "grp")
    assert alone.group_variance == 0


def dense_equations(x, y, group, exchangeable, rounds=200):
    n, p = x.shape
    b, alpha = np.zeros(p), 0.0
    sizes = np.unique(group, return_counts=True)[1]
    pairs = (sizes * (sizes - 1) / 2).sum()
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-x @ b))
        d = np.sqrt(mu * (1 - mu))
        r, inside, score, outer = (y - mu) / d, np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for g in np.unique(group):
            own = group == g
            m = own.sum()
            inverse = np.linalg.inv((1 - alpha) * np.eye(m) + alpha)
            zi = x[own] * d[own][:, None]
            u = zi.T @ inverse @ r[own]
            inside, score, outer = inside + zi.T @ inverse @ zi, score + u, outer + np.outer(u, u)
        scale = (r @ r) / (n - p)
        products = sum((r[group == g].sum() ** 2 - (r[group == g] ** 2).sum()) / 2 for g in np.unique(group))
        move = np.linalg.solve(inside, score)
        if np.abs(move).max() < 1e-11:
            break
        b, alpha = b + move, products / scale / (pairs - p) if exchangeable else 0.0
    inverse = np.linalg.inv(inside)
    return b, inverse @ outer @ inverse, inverse * scale, alpha


@pytest.mark.parametrize("exchangeable", [False, True])
def test_estimating_equations_equal_dense_ones(table, data, exchangeable):
    model = G.estimating_equations(table, FEATURES, "y", "grp", exchangeable)
    b, robust, naive, alpha = dense_equations(ones(data["x"]), data["binary"], data["group"], exchangeable)
    assert np.allclose(model.coefficients, b, rtol=1e-6) and math.isclose(model.correlation, alpha, rel_tol=1e-6, abs_tol=1e-9)
    assert np.allclose(model.covariance, robust, rtol=1e-5) and np.allclose(model.naive, naive, rtol=1e-5)
    assert model.groups == len(np.unique(data["group"])) and (alpha > 0.02 if exchangeable else alpha == 0)


def test_independent_equations_equal_the_logistic_fit(table):
    from gritstone.operators.models import iteratively_reweighted

    whole = table.where("id >= 0")
    assert np.allclose(G.estimating_equations(whole, FEATURES, "y", "grp", False).coefficients, iteratively_reweighted(whole, FEATURES, "y").coefficients, rtol=1e-6)


# additive boosting
def places(x, cuts):
    return np.where(np.isnan(x), 0, np.searchsorted(cuts, x, side="left") + 1)


def row_boosting(x, y, shapes, cycles, rate):
    """A pass over the rows per step."""
    own = [places(x[:, j], s.cuts) for j, s in enumerate(shapes)]
    effect = [np.zeros(len(s.values)) for s in shapes]
    score = np.full(len(y), y.mean())
    for _ in range(cycles):
        for j, place in enumerate(own):
            count = np.bincount(place, minlength=len(effect[j]))
            step = np.bincount(place, y - score, len(effect[j])) / np.maximum(count, 1)
            step = rate * (step - step @ count / count.sum())
            effect[j] += step
            score += step[place]
    return effect, score


def test_boosting_on_histograms_equals_boosting_on_rows(table, data):
    model = B.additive_boosting(table.where("id >= 0 or id = -1"), FEATURES, "v", bins=8, cycles=30)
    x, y = np.vstack([data["x"], [np.nan, 1.0, 1.0]]), np.append(data["number"], 1.0)
    effect, score = row_boosting(x, y, model.shapes, 30, 0.1)
    assert all(np.allclose(s.values, e - e @ s.rows / s.rows.sum(), atol=1e-9) for s, e in zip(model.shapes, effect))
    assert np.allclose(values(table, model.predict()), score[:-1], atol=1e-9)
    assert model.shapes[0].rows[0] == 1 and all(len(s.cuts) == 7 for s in model.shapes)
    shown = model.table(table).where("feature = 'a'").orderBy("bin").collect()
    assert [r["n"] for r in shown] == model.shapes[0].rows.tolist() and shown[1]["low"] is None and shown[-1]["high"] is None
    assert {r["feature"] for r in model.importance(table).where("importance > 0.2").collect()} >= {"a", "b"}


def test_binary_boosting_lowers_the_loss(table, data):
    y = data["binary"]
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    few, many = (values(table, B.additive_boosting(table.where("id >= 0"), FEATURES, "y", True, 8, cycles, 0.2, 10).predict()) for cycles in (10, 100))
    assert loss(many) < loss(few) < loss(np.full(len(y), y.mean()))
    # at convergence every bin's mean prediction is its mean target
    model = B.additive_boosting(table.where("id >= 0"), FEATURES, "y", True, 4, 4000, 0.5, 20)
    p = values(table, model.predict())
    for j, s in enumerate(model.shapes):
        place = places(data["x"][:, j], s.cuts)
        assert np.abs(np.bincount(place, y - p)).max() < 1e-3


# extra trees
def grown(x, y, t, depth, tried, seed):
    """A tree by the definition, on rows in memory."""
    out = {}

    def grow(k, own, level):
        node = (len(own), y[own].sum())
        out[k] = (*node, None, None)
        if level == depth or len(own) < 2 or y[own].var() * len(own) <= 1e-12 * max((y[own] ** 2).sum(), 1e-300):
            return
        low, high = x[own].min(axis=0), x[own].max(axis=0)
        best = None
        for j, cut in E.drawn(seed, t, k, x.shape[1], tried, low, high):
            left = x[own, j] <= cut
            if 0 < left.sum() < len(own):
                gain = y[own][left].sum() ** 2 / left.sum() + y[own][~left].sum() ** 2 / (~left).sum()
                if best is None or gain > best[0] + 1e-9:
                    best = gain, j, cut
        if best:
            out[k] = (*node, best[1], best[2])
            left = x[own, best[1]] <= best[2]
            grow(2 * k, own[left], level + 1)
            grow(2 * k + 1, own[~left], level + 1)

    grow(1, np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("target, tried", [("v", None), ("y", 1)])
def test_extra_trees_split_as_in_memory(table, data, target, tried):
    y = data["number"] if target == "v" else data["binary"]
    forest = E.extra_trees(table, FEATURES, target, trees=4, depth=3, tried=tried, seed=5)
    score = np.zeros(len(y))
    for t, tree in enumerate(forest.trees):
        want = grown(data["x"], y, t, 3, tried or 3, 5)
        assert tree.keys() == want.keys()
        for k, node in tree.items():
            n, total, feature, cut = want[k]
            assert node.n == n and math.isclose(node.total, total, rel_tol=1e-9, abs_tol=1e-9)
            assert (node.feature if node.feature >= 0 else None) == feature and (feature is None or node.threshold == cut)
        at = E._descended(tree, data["x"])
        score += np.array([tree[k].total / tree[k].n for k in at.tolist()])
    assert np.allclose(values(table, forest.predict()), score / 4, atol=1e-12)
    assert values(table.withColumn("a", F.lit(None).cast("double")), forest.predict()).tolist() == [None] * len(y)
    assert abs(sum(r["importance"] for r in forest.importance(table).collect()) - 1) < 1e-9


def test_estimating_equations_shuffle_once(spark, monkeypatch):
    """Groups kept whole are summed where they lie; groups too large for that are kept apart and change nothing."""
    rng = np.random.default_rng(3)
    rows = [(k % 7 if k < 600 else 99, float(x), float(rng.random() < 0.4)) for k, x in enumerate(rng.normal(size=900))]
    table = spark.createDataFrame([*rows, (None, 0.3, 1.0), (None, -0.2, 0.0)], "entity int, x double, y double")
    whole = G.estimating_equations(table, ["x"], "y", "entity")
    held, = G._by_group(table.select(F.struct("entity").alias("g"), "x"), None, 902)
    summed = held.groupBy("g").agg(F.sum("x"))
    summed.collect()
    assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    held.unpersist()
    monkeypatch.setattr(G, "TOGETHER", 200)
    apart = G.estimating_equations(table, ["x"], "y", "entity")
    assert np.allclose(whole.coefficients, apart.coefficients, rtol=1e-9) and np.allclose(whole.covariance, apart.covariance, rtol=1e-9) and whole.groups == apart.groups == 9
