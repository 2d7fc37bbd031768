"""Queries of the bootstrap, pooling, stationarity tests, influence, elastic net, subset search and routed models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import robustness as R
from gritstone.plans.catalogue import r
from gritstone.plans.evidence import monthly
from gritstone.plans.frameworks import MONTHS
from gritstone.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

REPLICATES = 20


def poisson_steps() -> list[float]:
    """The first twelve values of the Poisson(1) distribution function."""
    out, upto, p = [], 0.0, math.exp(-1)
    for k in range(12):
        upto += p
        out.append(upto)
        p /= k + 1
    return out


DRAW = "('0x' || sha256('poisson:' || k || ':' || id)[1:13])::BIGINT"
WEIGHT = " + ".join(f"CASE WHEN u > {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in poisson_steps())
add(
    "bootstrap_means",
    f"""
    , u AS (SELECT k, ({DRAW} + 0.5::DOUBLE) / 4503599627370496 AS u, target, score, sparse FROM book, (SELECT unnest(range(0, {REPLICATES})) AS k)),
      w AS (SELECT *, {WEIGHT} AS w FROM u)
    SELECT CAST(k AS INTEGER) AS replicate, CAST(sum(w) AS BIGINT) AS n, {r('sum(w * CAST(target AS DOUBLE)) / sum(w)')} AS rate, {r('sum(w * score) / sum(w)')} AS score,
           {r('sum(w * sparse) / sum(CASE WHEN sparse IS NOT NULL THEN w END)', 4)} AS sparse FROM w GROUP BY k""",
    lambda b: R.bootstrap_means(b, "id", {"rate": F.col("target"), "score": F.col("score"), "sparse": F.col("sparse")}, REPLICATES).select(
        "replicate", "n", rounded("rate").alias("rate"), rounded("score").alias("score"), rounded("sparse", 4).alias("sparse")
    ),
    digits=None,
)

add("bootstrap_fit", None, lambda b: R.bootstrap_fit(b.select("id", (F.col("amount") / 1e5).alias("amount"), (F.col("balance") / 1e4).alias("balance"), "target"), "id", ["amount", "balance"], "target", 10))

add(
    "pooled_estimates",
    f"""
    , e AS (SELECT segment AS term, avg(score) AS estimate, stddev_samp(score) / sqrt(count(*)) AS se FROM book GROUP BY segment, split),
      p AS (SELECT term, count(*) AS m, avg(estimate) AS q, avg(se * se) AS u, var_samp(estimate) AS b FROM e GROUP BY term),
      t AS (SELECT *, u + (1 + 1.0::DOUBLE / m) * b AS v FROM p)
    SELECT term, m, {r('q')} AS estimate, {r('u', 9)} AS within, {r('b', 9)} AS between, {r('v', 9)} AS total, {r('sqrt(v)')} AS std_error, {r('(1 + 1.0::DOUBLE / m) * b / v')} AS missing_fraction FROM t""",
    lambda b: R.pooled(b.groupBy(F.col("segment").alias("term"), "split").agg(F.avg("score").alias("estimate"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("std_error"))).select(
        "term", "m", *(rounded(c).alias(c) for c in ("estimate", "std_error", "missing_fraction")), *(rounded(c, 9).alias(c) for c in ("within", "between", "total"))
    ),
    digits=None,
)

add("missing_completely_at_random", None, lambda b: R.missing_completely_at_random(b.withColumn("other", F.when(F.col("id") % 7 != 0, F.col("balance"))), ["sparse", "other", "score"]))

LAGS = 3
add(
    "kpss",
    MONTHS
    + f"""
    , d AS (SELECT month, e - avg(e) OVER () AS e FROM m),
      l AS (SELECT e, sum(e) OVER (ORDER BY month) AS s, {', '.join(f'lag(e, {k}) OVER (ORDER BY month) AS e{k}' for k in range(1, LAGS + 1))} FROM d)
    SELECT count(*) AS n, {r('sum(s * s) / (count(*) * (sum(e * e) + 2 * (' + ' + '.join(f'(1 - {k} / {LAGS + 1}.0) * sum(e * e{k})' for k in range(1, LAGS + 1)) + ')))')} AS statistic FROM l""",
    lambda b: R.kpss(monthly(b), "month", "e", LAGS),
)

add(
    "phillips_perron",
    MONTHS
    + f"""
    , d AS (SELECT month, e - lag(e) OVER (ORDER BY month) AS y, lag(e) OVER (ORDER BY month) AS x FROM m),
      f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM d WHERE x IS NOT NULL),
      u AS (SELECT month, y - a - b * x AS u, n, b, se FROM d, f WHERE x IS NOT NULL),
      l AS (SELECT *, {', '.join(f'lag(u, {k}) OVER (ORDER BY month) AS u{k}' for k in range(1, LAGS + 1))} FROM u),
      g AS (SELECT any_value(n) AS n, any_value(b) AS b, any_value(se) AS se, sum(u * u) / any_value(n) AS g0, (sum(u * u) + 2 * ({' + '.join(f'(1 - {k} / {LAGS + 1}.0) * sum(u * u{k})' for k in range(1, LAGS + 1))})) / any_value(n) AS lr FROM l)
    SELECT n, {r('sqrt(g0 / lr) * b / se - 0.5 * (lr - g0) / lr * n * se / sqrt(g0)', 4)} AS statistic FROM g""",
    lambda b: R.phillips_perron(monthly(b), "month", "e", LAGS),
    digits=4,
)

add(
    "influence",
    f"""
    , t AS (SELECT count(*) AS n, avg(score) AS m, var_pop(score) * count(*) AS sxx, regr_slope(target, score) AS b, regr_intercept(target, score) AS a,
                   (regr_syy(target, score) - regr_sxy(target, score) ** 2 / regr_sxx(target, score)) / (count(*) - 2) AS v FROM book),
      h AS (SELECT id, a + b * score AS f, 1.0::DOUBLE / n + (score - m) ** 2 / sxx AS h, target, v FROM book, t),
      s AS (SELECT *, (target - f) / sqrt(v * (1 - h)) AS s FROM h)
    SELECT id, {r('f')} AS fitted, {r('h', 8)} AS leverage, {r('s')} AS studentised, {r('s * s * h / (1 - h) / 2', 8)} AS cooks_distance FROM s""",
    lambda b: R.influence(b.select("id", "score", "target"), ["score"], "target").select("id", rounded("fitted").alias("fitted"), rounded("leverage", 8).alias("leverage"), rounded("studentised").alias("studentised"), rounded("cooks_distance", 8).alias("cooks_distance")),
    digits=None,
)

add(
    "rank_score",
    f"""
    , k AS (SELECT segment, state, avg(target::DOUBLE) AS rate FROM book GROUP BY segment, state)
    SELECT segment, state, {r('rate')} AS rate, {r('1 - (rank() OVER (PARTITION BY segment ORDER BY rate) - 1) / (count(*) OVER (PARTITION BY segment) - 1)::DOUBLE')} AS rank_score FROM k""",
    lambda b: R.rank_score(b.groupBy("segment", "state").agg(F.avg(F.col("target").cast("double")).alias("rate")), "rate", ["segment"], False),
)

SCALED = ("amount", 1e5), ("balance", 1e4), ("score", 1.0)


def scaled(b):
    return b.select("id", "segment", "target", *((F.col(c) / s).alias(c) for c, s in SCALED))


def elastic(b):
    held = scaled(b)
    return R.elastic_net(held, [c for c, _ in SCALED], "target", 0.01, 0.5).table(held).select("name", "coefficient")


def segmented(b):
    held = scaled(b)
    score, route = R.routed("segment", *R.segmented_fits(held, "segment", ["amount"], "target"))
    return held.select("id", route.alias("model"), score.alias("score"))


add(
    "segment_fit_table",
    f"""
    , s AS (SELECT segment, count(*) AS n, regr_slope(target, amount / 1e5) AS b, regr_intercept(target, amount / 1e5) AS a, corr(target, amount) ** 2 AS r2 FROM book GROUP BY segment HAVING count(*) >= 50)
    SELECT segment, n, unnest(['intercept', 'amount']) AS term, unnest([{r('a')}, {r('b')}]) AS coefficient, {r('r2', 8)} AS r2 FROM s""",
    lambda b: R.segment_fit_table(scaled(b), "segment", ["amount"], "target").select("segment", "n", "term", rounded("coefficient").alias("coefficient"), rounded("r2", 8).alias("r2")),
    digits=None,
)
add("ramsey_reset", None, lambda b: R.ramsey_reset(scaled(b), ["amount", "balance"], "target"))
add("elastic_net", None, elastic)
add("subset_search", None, lambda b: R.subset_search(scaled(b), [c for c, _ in SCALED], "target", range(1, 4)))
add(
    "segmented_scores",
    f"""
    , s AS (SELECT segment, regr_slope(target, amount / 1e5) AS b, regr_intercept(target, amount / 1e5) AS a FROM book GROUP BY segment)
    SELECT id, segment AS model, {r('a + b * amount / 1e5')} AS score FROM book JOIN s USING (segment)""",
    segmented,
)
