"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math

import duckdb
import pytest

from gritstone.plans import everything

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = everything.queries(), everything.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None, round(x, 6) if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    if name not in SQL:
        assert got
        return
    held = duck.execute(SQL[name])
    names = [d[0] for d in held.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[k] for k in order) for r in held.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12), (sorted(names), a, b)


def test_every_row_has_a_curve(spark, sf):
    ids = {r[0] for r in QUERIES["individual_curves_every_row"](spark, sf).select("id").collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
