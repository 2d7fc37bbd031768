"""Queries of the diagnostic frameworks and of scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import frameworks as W
from gritstone.operators import scorecard
from gritstone.plans.catalogue import fixed_score, r
from gritstone.plans.evidence import COLUMNS, fixed_score_sql, monthly
from gritstone.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

add(
    "top_per_group",
    """
    SELECT segment, id, amount, rank FROM (SELECT segment, id, amount, CAST(row_number() OVER (PARTITION BY segment ORDER BY amount DESC, id) AS INTEGER) AS rank FROM book)
    WHERE rank <= 5""",
    lambda b: W.top_per_group(b.select("segment", "id", "amount"), ["segment"], [F.desc("amount"), F.col("id")], 5),
    digits=None,
)

add(
    "pivot_states",
    """
    SELECT segment, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test
    FROM book GROUP BY segment""",
    lambda b: W.pivoted(b, "segment", "split", ["train", "validation", "test"], F.count(F.lit(1))),
    digits=None,
)

add("rows_with_target", " SELECT id, sparse FROM book WHERE sparse IS NOT NULL", lambda b: W.with_target(b.select("id", "sparse"), "sparse"), digits=None)

add(
    "fence_flags",
    """
    , q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM book)
    SELECT id, amount AS value, CASE WHEN amount < a - 0.3 * (b - a) THEN 'low' ELSE 'high' END AS side FROM book, q WHERE amount < a - 0.3 * (b - a) OR amount > b + 0.3 * (b - a)""",
    lambda b: W.fence_flags(b, "id", "amount", 0.3),
    digits=None,
)

add(
    "missing_correlations",
    f"""
    SELECT 'sparse' AS "left", 'sparse_segment' AS "right", {r('corr(CASE WHEN sparse IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN sparse_segment IS NULL THEN 1.0 ELSE 0.0 END)')} AS r FROM book""",
    lambda b: W.missing_correlations(b, ["sparse", "sparse_segment"]),
)

COUNTS = """
    , c AS (SELECT score, CAST(sum(target) AS DOUBLE) AS pos, CAST(sum(1 - target) AS DOUBLE) AS neg FROM book GROUP BY score),
      u AS (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM c WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))"""
add("ks_curve", COUNTS + f" SELECT score, {r('pu / pa')} AS events, {r('nu / na')} AS others, {r('abs(pu / pa - nu / na)')} AS gap FROM u", lambda b: W.ks_curve(b, "target", "score"))
add(
    "precision_recall_curve",
    COUNTS + f" SELECT score AS threshold, {r('(pa - pu + pos) / (pa - pu + pos + na - nu + neg)')} AS precision, {r('(pa - pu + pos) / pa')} AS recall FROM u",
    lambda b: W.precision_recall_curve(b, "target", "score"),
)


def measured(score: str) -> str:
    return f"""(SELECT split, auc, ks, ap, brier, log_loss FROM (
        SELECT split, sum(pos * (nu - neg / 2)) / (any_value(pa) * any_value(na)) AS auc, max(abs(pu / pa - nu / na)) AS ks, sum(pos / pa * (pa - pu + pos) / (pa - pu + pos + na - nu + neg)) AS ap
        FROM (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER (PARTITION BY split) AS pa, sum(neg) OVER (PARTITION BY split) AS na
              FROM (SELECT split, {score} AS s, CAST(sum(target) AS DOUBLE) AS pos, CAST(sum(1 - target) AS DOUBLE) AS neg FROM book GROUP BY 1, 2)
              WINDOW w AS (PARTITION BY split ORDER BY s ROWS UNBOUNDED PRECEDING)) GROUP BY split)
        JOIN (SELECT split, avg(power({score} - target, 2)) AS brier, avg(-(target * ln({score}) + (1 - target) * ln(1 - {score}))) AS log_loss FROM book GROUP BY split) USING (split))"""


METRICS = {"auc": "auc", "ks": "ks", "average_precision": "ap", "brier": "brier", "log_loss": "log_loss"}
add(
    "challenger_comparison",
    " "
    + " UNION ALL ".join(
        f"SELECT a.split, '{name}' AS metric, {r(f'a.{c}')} AS \"primary\", {r(f'b.{c}')} AS challenger, {r(f'b.{c} - a.{c}')} AS difference FROM {measured('score')} a JOIN {measured('challenger')} b USING (split)"
        for name, c in METRICS.items()
    ),
    lambda b: W.challenger_comparison(b, "target", "score", "challenger", "split"),
)

POINTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
add(
    "quantile_summary",
    " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS quantile, {r(f'quantile_cont({c}, {p})', 4)} AS value FROM book" for c in ("sparse", "balance") for p in POINTS),
    lambda b: W.quantile_summary(b, ["sparse", "balance"], POINTS),
    digits=4,
)

add(
    "rolling_residuals",
    f"""
    , m AS (SELECT strftime(date, '%Y-%m') AS period, count(*) AS n, avg(target - score) AS residual FROM book GROUP BY 1)
    SELECT period, n, {r('residual')} AS residual, {r('avg(residual) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling FROM m""",
    lambda b: W.rolling_residuals(b, F.date_format("date", "yyyy-MM"), "target", "score"),
)

add(
    "stratified_folds",
    " SELECT id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY (id * 7919) % 1000003, id) - 1) % 5 AS INTEGER) AS fold FROM book",
    lambda b: W.stratified_folds(b, "id", "target", 5).select("id", "target", "fold"),
    digits=None,
)

add(
    "expanding_folds",
    """
    , o AS (SELECT id, row_number() OVER (ORDER BY date, id) - 1 AS p, count(*) OVER () AS n FROM book)
    SELECT id, CAST(p * 5 // n AS INTEGER) AS block FROM o""",
    lambda b: W.expanding_folds(b, ["date", "id"], 4).select("id", "block"),
    digits=None,
)

HALF = "1.96 * stddev_samp(s) / sqrt(count(*))"
CURVE = f", c AS (SELECT g AS value, {fixed_score_sql('g')} AS s FROM book, (SELECT unnest([5e4, 1e5, 2e5, 4e5]) AS g))"
GRID = [5e4, 1e5, 2e5, 4e5]
add(
    "dependence_bands",
    CURVE + f" SELECT value, {r('avg(s)')} AS mean_score, {r(f'avg(s) - {HALF}')} AS low, {r(f'avg(s) + {HALF}')} AS high FROM c GROUP BY value",
    lambda b: W.banded_dependence(b, COLUMNS, "amount", GRID, fixed_score),
)
add(
    "monotonicity",
    CURVE
    + """
    , m AS (SELECT value, avg(s) AS s FROM c GROUP BY value), d AS (SELECT s - lag(s) OVER (ORDER BY value) AS d FROM m),
      k AS (SELECT count(d) AS steps, count(*) FILTER (WHERE d > 0) AS rises, count(*) FILTER (WHERE d < 0) AS falls FROM d)
    SELECT steps, rises, falls, CASE WHEN falls = 0 THEN 'increasing' WHEN rises = 0 THEN 'decreasing' ELSE 'mixed' END AS direction FROM k""",
    lambda b: W.monotonicity(W.banded_dependence(b, COLUMNS, "amount", GRID, fixed_score)),
    digits=None,
)

MONTHS = ", m AS (SELECT strftime(date, '%Y-%m') AS month, avg(CAST(target AS DOUBLE)) - avg(score) AS e FROM book GROUP BY 1)"
add(
    "cusum",
    MONTHS + f", t AS (SELECT avg(e) AS m, stddev_samp(e) AS s, count(*) AS n FROM m) SELECT any_value(n) AS n, {r('max(d) / any_value(s * sqrt(n))')} AS statistic FROM (SELECT abs(sum(e - m) OVER (ORDER BY month)) AS d, s, n FROM m, t)",
    lambda b: W.cusum(monthly(b), "month", "e"),
)
add(
    "dickey_fuller",
    MONTHS
    + f"""
    , d AS (SELECT e - lag(e) OVER (ORDER BY month) AS y, lag(e) OVER (ORDER BY month) AS x FROM m),
      s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x) AS v FROM d WHERE x IS NOT NULL)
    SELECT n, {r('b')} AS coefficient, {r('b / sqrt(v)', 4)} AS statistic FROM s""",
    lambda b: W.augmented_dickey_fuller(monthly(b), "month", "e", 0).withColumn("coefficient", rounded("coefficient")).withColumn("statistic", rounded("statistic", 4)),
    digits=None,
)

LABELS = """
    , x AS (SELECT target, unnest([{'f': 'sparse', 'b': coalesce(CASE WHEN sparse <= 100000 THEN '0' WHEN sparse <= 250000 THEN '1' WHEN sparse IS NOT NULL THEN '2' END, 'MISSING')},
                                   {'f': 'sparse_segment', 'b': coalesce(sparse_segment, 'MISSING')}]) AS u FROM book WHERE split = 'train'),
      g AS (SELECT u.f AS feature, u.b AS bucket, count(*) AS total, CAST(sum(target) AS BIGINT) AS bad FROM x GROUP BY 1, 2),
      p AS (SELECT *, total - bad AS good, (bad + 0.5) / (sum(bad) OVER w + 0.5 * count(*) OVER w) AS bp, (total - bad + 0.5) / (sum(total - bad) OVER w + 0.5 * count(*) OVER w) AS gp FROM g WINDOW w AS (PARTITION BY feature))"""
add(
    "scorecard_bins",
    LABELS + f" SELECT feature, bucket, total, bad, good, {r('ln(gp / bp)')} AS woe, {r('(gp - bp) * ln(gp / bp)', 6)} AS iv FROM p",
    lambda b: scorecard.evidence(b.where("split = 'train'"), {"sparse": [1e5, 2.5e5], "sparse_segment": None}, "target"),
)


def _points(b):
    train = b.where("split = 'train'")
    features = {"sparse": scorecard.fit_edges(train, "sparse", "target"), "sparse_segment": None}
    held = scorecard.fit_scorecard(train, features, "target").apply(b, 1)
    return held.select("id", "points_sparse", "points_sparse_segment", "score_points", F.array_join("reasons", ",").alias("reason"))


add("scorecard_with_bins", None, _points)
