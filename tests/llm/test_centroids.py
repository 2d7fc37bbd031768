import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import centroids as C


def brute(rows, k=8, rounds=10, dims=64):
    """Every distance by Python's integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))

    for _ in range(rounds):
        own = [[] for _ in centre]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centre = [tuple(sum(x) // len(m) for x in zip(*m)) if m else c for m, c in zip(own, centre)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centre))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=str)


def run(spark, rows, kind="double"):
    held = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({c: F.lit(c) for c in ("id", "vector", "cluster", "distance")}).repartition(3)
    return sorted((tuple(r) for r in C.op12(held).collect()), key=str)


def vectors(seed, n, spread=1.0, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)) * spread if levels is None else rng.integers(0, levels, (n, 64)) / 1024
    return [(int(i), [float(e) for e in v]) for i, v in enumerate(x)]


def test_brute_force(spark):
    rows = vectors(1, 120)
    assert run(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = vectors(2, 30, levels=2) * 3 + [(7, [0.0] * 64)] * 5
    assert run(spark, rows) == brute(rows)
    same = [(k, [0.5] * 64) for k in range(20)]  # all centroids equal: the smallest number takes all
    assert run(spark, same) == brute(same)


def test_what_is_left_out(spark):
    rows = vectors(3, 40) + [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [math.nan] + [1.0] * 63), (106, [math.inf] * 64), (107, [-math.inf] * 64), (None, [0.25] * 64), (None, [-0.25] * 64)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    assert run(spark, vectors(4, n)) == brute(vectors(4, n))


def test_large_components_stay_exact(spark):
    rows = vectors(5, 40, spread=3e4)
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9] * 64)])


def test_float_components(spark):
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in vectors(6, 50)]
    assert run(spark, rows, "float") == brute(rows)


def test_scan_stops_strictly_beyond_twice_the_distance():
    centre = np.array([[0, 0], [4, 0], [40, 0]])
    order, between = C.neighbour_order(centre)
    assert order.tolist() == [[1, 2], [0, 2], [1, 0]]
    # from centroid 1 at distance 2 centroid 0 is exactly twice as far: it is looked at, ties, and has the smaller number
    chosen, distance, taken = C.nearest(np.array([[2, 0]]), np.array([1]), centre, order, between)
    assert (chosen.tolist(), distance.tolist(), taken) == ([0], [4], 2)
    chosen, distance, taken = C.nearest(np.array([[3, 0], [39, 1]]), np.array([1, 1]), centre, order, between)
    assert (chosen.tolist(), distance.tolist()) == ([1, 2], [1, 2]) and taken == 4
    x, c = np.random.default_rng(0).integers(-50, 50, (500, 2)), np.random.default_rng(1).integers(-50, 50, (20, 2))
    every = ((x[:, None] - c) ** 2).sum(axis=2)
    chosen, distance, taken = C.nearest(x, every.argmin(axis=1), c, *C.neighbour_order(c))
    assert (chosen == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and taken < 0.5 * every.size


def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, C.op12(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()))
    assert got == sorted(c.execute(C.op12_sql()).fetchall())
