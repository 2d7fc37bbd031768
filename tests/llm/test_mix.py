import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from gritstone.llm import source_mix as M
from tests.llm.fixtures import SCHEMA, clashing, empty_documents, odd_documents


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, cap=3):
    """Deals the excess anew until no source is above its cap, in fractions."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        share = Fraction(total - sum(fixed.values()), sum(weights[s] for s in free) or 1)
        above = [s for s in free if weights[s] * share > cap * sizes[s]]
        if not above:
            return {s: float(fixed.get(s, weights[s] * share)) for s in sizes}
        fixed.update({s: cap * sizes[s] for s in above})


def brute(rows, seed=11):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = brute_targets(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    out = []
    for key, text, source in rows:
        rate = aims[source] / sizes[source] if sizes[source] else 0.0
        u = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (u < rate - math.floor(rate))
        out.append((key, words(text), sizes[source], round(aims[source], 6), copies))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in M.mix_plan(df, **options).collect()), key=str)


def table(spark, rows):
    return clashing(spark.createDataFrame([(k, t, None, s, None) for k, t, s in rows], SCHEMA))


def test_sources_of_all_sizes(spark):
    rng = random.Random(3)
    for sizes in ([40, 1, 1, 1, 300, 7, 0], [5, 50, 500], [1] * 12, [3], [0, 0], [2 ** min(k, 9) for k in range(14)]):
        names = [None, "", "ä", "Z", "a", "\U0001f600", "aa", "0", "1", "￿", "B", "b", "c", "d"][: len(sizes)]
        rows, key = [], 0
        for name, n in zip(names, sizes):
            while n > 0:
                here = min(n, rng.randint(1, 20))
                rows.append((key, "wört \t" * here, name))
                key, n = key + 1, n - here
            rows += [(key, None, name), (key + 1, " \n", name)]
            key += 2
        assert run(table(spark, rows).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "x y", None), (None, "x y", None), (2, "one two\x0bthree", "b"), (2, "one two\x0bthree", "b"), (3, "", "b"), (4, "x" * 40000 + " y" * 30000, "b")]
    assert run(table(spark, rows)) == brute(rows)
    odd = [(r[0], r[1], r[3]) for r in odd_documents(spark).collect()]
    assert run(clashing(odd_documents(spark))) == brute(odd)
    assert run(empty_documents(spark)) == [] and M.mixed(empty_documents(spark)).count() == 0


def test_words(spark):
    texts = ["", " ", "\t\n\x0b\f\r ", "a", " a", "a ", " a b ", "a b   c", "\x1c\x1d \x85", "\x00 x"]
    held = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["n"] for r in held.orderBy("k").select(M.word_count(F.col("t")).alias("n")).collect()] == [words(t) for t in texts]


def test_the_mix_comes_near_its_targets(spark):
    held = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 9).cast("string")).alias("source"), F.col("id").alias("copy"))
    plan = M.mix_plan(held).persist()
    for r in plan.groupBy(F.col("id") % 9, "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.06
    assert plan.agg(F.max("copies")).first()[0] <= 3
    got = M.mixed(held)
    assert got.columns == [*held.columns, "copy_"]
    emitted = {(r["doc_id"], r["n"], r["top"]) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_").alias("top")).collect()}
    assert emitted == {(r["id"], r["copies"], r["copies"] - 1) for r in plan.collect() if r["copies"]}


def test_given_weights(spark):
    rows = [(k, "w " * 10, "abc"[k % 3]) for k in range(30)]
    weights = spark.createDataFrame([("a", 3), ("b", 1), ("nobody", 5)], "source string, weight int")
    got = {r["id"]: r["target"] for r in M.mix_plan(table(spark, rows), weights=weights).collect()}
    assert [got[k] for k in range(3)] == [225.0, 75.0, 0.0]
    assert M.mixed(table(spark, rows), weights=weights).where("source = 'c'").count() == 0


def test_many_sources_over_many_ranges(spark):
    rows = [(k, "w " * (k % 5), f"s{k * 7919 % 400}") for k in range(1200)]
    assert run(table(spark, rows).repartition(7)) == brute(rows)


def test_main_path_is_native(spark, sf):
    plan = M.op11(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("cuts", [1, 4])
def test_sql(spark, sf, cuts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(cuts)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, M.op11(docs).collect())) == sorted(c.execute(M.OP11_SQL).fetchall())
