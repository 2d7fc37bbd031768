"""Queries of the tests of time series and of rows behind a least-squares model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import frameworks, robustness
from gritstone.operators import series_tests as T
from gritstone.plans import frameworks as frameworks_plans
from gritstone.plans import robustness as robustness_plans
from gritstone.plans.catalogue import book, r
from gritstone.plans.evidence import integral, monthly, two_sided_normal
from gritstone.plans.families import SCALED_SQL, scaled
from gritstone.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

MONTHS = ", m AS (SELECT strftime(date, '%Y-%m') AS month, avg(target::DOUBLE) AS y, avg(score) AS x, avg(target::DOUBLE) - avg(score) AS e FROM book GROUP BY 1)"


def months(b: DataFrame) -> DataFrame:
    y, x = F.avg(F.col("target").cast("double")), F.avg("score")
    return b.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(y.alias("y"), x.alias("x"), (y - x).alias("e"))


def neat(test: DataFrame) -> DataFrame:
    return test.select("test", "n", rounded("statistic", 4).alias("statistic"), rounded("p_value", 4).alias("p_value"))


def r2(y: str, a: str, b: str) -> str:
    """Of y on a and b."""
    return f"((corr({y}, {a}) ** 2 + corr({y}, {b}) ** 2 - 2 * corr({y}, {a}) * corr({y}, {b}) * corr({a}, {b})) / (1 - corr({a}, {b}) ** 2))"


def chi2_one(x: str) -> str:
    return two_sided_normal(f"sqrt({x})")


def below(z: str) -> str:
    """The normal distribution function."""
    return f"(0.5 + 0.3989422804014327 * sign({z}) * {integral('exp(-{x} * {x} / 2)', f'least(abs({z}), 9.0)')})"


def unit_root(t: str, series: int) -> str:
    s = T.SURFACES[series]
    polynomial = lambda name: " + ".join(f"{c} * pow({t}, {k})" for k, c in enumerate(s[name]))
    return f"CASE WHEN {t} <= {s['least']} THEN 0 WHEN {t} >= {s['most']} THEN 1 ELSE {below(f'''(CASE WHEN {t} <= {s['turn']} THEN {polynomial('low')} ELSE {polynomial('high')} END)''')} END"


KPSS = " ".join(f"WHEN s <= {b} THEN {p} + ({q} - {p}) * (s - {a}) / ({b} - {a})" for (a, p), (b, q) in zip(T.KPSS_POINTS, T.KPSS_POINTS[1:]))
ROOTS = {"adf": frameworks_plans.REGISTRY.sql["dickey_fuller"], "phillips_perron": robustness_plans.REGISTRY.sql["phillips_perron"], "kpss": robustness_plans.REGISTRY.sql["kpss"]}


def stationarity(b: DataFrame) -> DataFrame:
    held = monthly(b)
    adf = frameworks.augmented_dickey_fuller(held, "month", "e", 0)
    tests = {"adf": adf, "phillips_perron": robustness.phillips_perron(held, "month", "e", robustness_plans.LAGS), "kpss": robustness.kpss(held, "month", "e", robustness_plans.LAGS)}
    found = [T.with_p_value(t.select("n", "statistic"), name) for name, t in tests.items()]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("test", "n", rounded("statistic", 3).alias("statistic"), rounded("p_value", 3).alias("p_value"))


REGISTRY.queries["stationarity_tests"] = lambda spark, sf: stationarity(book(spark, sf))
REGISTRY.sql["stationarity_tests"] = " UNION ALL ".join(
    f"SELECT '{name}' AS test, n, {r('s', 3)} AS statistic, {r(f'CASE WHEN s <= {T.KPSS_POINTS[0][0]} THEN {T.KPSS_POINTS[0][1]} {KPSS} ELSE {T.KPSS_POINTS[-1][1]} END' if name == 'kpss' else unit_root('s', 1), 3)} AS p_value FROM (SELECT n, statistic AS s FROM ({sql}))"
    for name, sql in ROOTS.items()
)


add(
    "breusch_godfrey",
    MONTHS
    + f"""
    , f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m), u AS (SELECT month, x, y - a - b * x AS u FROM m, f),
      l AS (SELECT x, u, coalesce(lag(u) OVER (ORDER BY month), 0) AS v FROM u), s AS (SELECT count(*) AS n, count(*) * {r2('u', 'x', 'v')} AS s FROM l)
    SELECT 'breusch_godfrey' AS test, n, {r('s', 4)} AS statistic, {r(chi2_one('s'), 4)} AS p_value FROM s""",
    lambda b: neat(T.breusch_godfrey(months(b), "month", ["x"], "y", 1)),
    digits=None,
)

add(
    "arch_lm",
    MONTHS
    + f"""
    , l AS (SELECT e * e AS s, lag(e * e) OVER (ORDER BY month) AS t FROM m), s AS (SELECT count(*) AS n, count(*) * corr(s, t) ** 2 AS s FROM l WHERE t IS NOT NULL)
    SELECT 'arch_lm' AS test, n, {r('s', 4)} AS statistic, {r(chi2_one('s'), 4)} AS p_value FROM s""",
    lambda b: neat(T.arch_lm(months(b), "month", "e", 1)),
    digits=None,
)

add(
    "granger_causality",
    MONTHS
    + f"""
    , l AS (SELECT y, lag(y) OVER (ORDER BY month) AS y1, lag(x) OVER (ORDER BY month) AS x1 FROM m),
      s AS (SELECT count(*) AS n, (1 - corr(y, y1) ** 2) AS alone, 1 - {r2('y', 'y1', 'x1')} AS wide FROM l WHERE y1 IS NOT NULL),
      f AS (SELECT n, (alone - wide) / (wide / (n - 3)) AS f FROM s)
    SELECT 1 AS lags, n, {r('f', 4)} AS statistic FROM f""",
    lambda b: T.granger(months(b), "month", "x", "y", 1).select("lags", "n", rounded("statistic", 4).alias("statistic")),
    digits=None,
)

add(
    "cointegration",
    MONTHS
    + f"""
    , f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m), u AS (SELECT month, y - a - b * x AS u FROM m, f),
      l AS (SELECT u - lag(u) OVER (ORDER BY month) AS d, lag(u) OVER (ORDER BY month) AS v FROM u),
      c AS (SELECT count(*) AS n, sum(d * v) / sum(v * v) AS c, sum(v * v) AS vv, sum(d * d) AS dd, sum(d * v) AS dv FROM l WHERE v IS NOT NULL),
      s AS (SELECT n, c / sqrt((dd - c * dv) / (n - 1) / vv) AS t FROM c)
    SELECT 'cointegration' AS test, n, {r('t', 4)} AS statistic, {r(unit_root('t', 2), 4)} AS p_value FROM s""",
    lambda b: neat(T.engle_granger(months(b), "month", "y", "x", 0)),
    digits=None,
)

add(
    "seasonality",
    MONTHS
    + f"""
    , p AS (SELECT e, (row_number() OVER (ORDER BY month) - 1) % 12 AS bucket FROM m), b AS (SELECT bucket, count(*) AS n, avg(e) AS mean FROM p GROUP BY bucket)
    SELECT bucket::INTEGER AS bucket, n, {r('mean')} AS mean, {r('var_pop(mean) OVER () / (SELECT var_pop(e) FROM p)')} AS strength FROM b""",
    lambda b: T.seasonality(months(b), "month", "e", 12).withColumn("bucket", F.col("bucket").cast("int")),
)

add(
    "lag_autocorrelation",
    MONTHS + f", l AS (SELECT e, lag(e) OVER (ORDER BY month) AS f FROM m) SELECT count(*) AS n, {r('corr(e, f)')} AS r FROM l WHERE f IS NOT NULL",
    lambda b: T.autocorrelation(months(b), "month", "e"),
)

ROWS = f", s AS (SELECT id, target::DOUBLE AS y, {SCALED_SQL} FROM book), f AS (SELECT regr_slope(y, amount) AS b, regr_intercept(y, amount) AS a, count(*) AS n, avg(amount) AS m, regr_sxx(y, amount) AS sxx FROM s)"
add(
    "white_test",
    ROWS
    + f"""
    , u AS (SELECT pow(y - a - b * amount, 2) AS u, amount AS x, amount * amount AS xx FROM s, f), t AS (SELECT count(*) AS n, count(*) * {r2('u', 'x', 'xx')} AS t FROM u)
    SELECT 'white' AS test, n, {r('t', 4)} AS statistic, {r('exp(-t / 2)', 4)} AS p_value FROM t""",
    lambda b: neat(T.white(scaled(b, "target"), ["amount"], "target")),
    digits=None,
)

add(
    "deletion_influence",
    ROWS
    + f"""
    , u AS (SELECT id, amount - m AS d, y - a - b * amount AS e, 1.0::DOUBLE / n + (amount - m) ** 2 / sxx AS h, n, sxx, m, (SELECT sum((y - a - b * amount) ** 2) FROM s, f) AS rss FROM s, f),
      v AS (SELECT *, sqrt((rss - e * e / (1 - h)) / (n - 3)) AS sd FROM u)
    SELECT id, {r('e / sd / sqrt(1 - h) * sqrt(h / (1 - h))', 8)} AS dffits, {r('d / sxx * e / (1 - h) / (sd / sqrt(sxx))', 8)} AS dfbeta_amount,
           {r('(1.0::DOUBLE / n - m * d / sxx) * e / (1 - h) / (sd * sqrt(1.0::DOUBLE / n + m * m / sxx))', 8)} AS dfbeta_intercept, 'amount' AS driver
    FROM v""",
    lambda b: T.deletion_influence(scaled(b, "target"), ["amount"], "target").select("id", "driver", *(rounded(c, 8).alias(c) for c in ("dffits", "dfbeta_amount", "dfbeta_intercept"))),
    digits=None,
)
add("link_test", None, lambda b: T.link_test(scaled(b, "target"), ["amount", "balance"], "target"))
add("box_tidwell", None, lambda b: T.box_tidwell(scaled(b, "target"), ["amount"], "target"))


def binomial(b: DataFrame) -> DataFrame:
    """Leverages sum to the number of coefficients, fitted values to the events, and the rows' score terms to nothing."""
    held = T.binomial_influence(scaled(b, "target"), ["amount", "balance"], "target")
    return held.agg(F.count("*").alias("n"), rounded(F.sum("leverage"), 5).alias("leverage"), rounded(F.avg("fitted")).alias("fitted"), (F.min("cooks_distance") >= 0).alias("distances_hold"))


add("binomial_influence", f" SELECT count(*) AS n, 3.0::DOUBLE AS leverage, {r('avg(target::DOUBLE)')} AS fitted, TRUE AS distances_hold FROM book", binomial, digits=None)
