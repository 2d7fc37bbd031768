"""Queries whose SQL is long: statistical tests with their p-values, effects, permutation, fits with their errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import binning, diagnostics, explain, hypothesis_tests, models
from gritstone.plans.catalogue import BOOK_SQL, LINES_SQL, _normal_sql, book, fixed_score, lines, r
from gritstone.plans.registry import Registry

REGISTRY = Registry()
COLUMNS = ["amount", "balance"]


def fixed_score_sql(amount: str = "amount", balance: str = "balance") -> str:
    return f"1 / (1 + exp(-(-0.5 + {amount} / 4e5 - {balance} / 2e4)))"


def integral(density: str, upper: str, steps: int = 2000) -> str:
    """Simpson's rule from 0 to `upper`; the density names its argument as {x}."""
    point = f"(({upper}) * k / {steps}.0)"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({upper}) / {steps}.0 / 3 * list_sum(list_transform(range(0, {steps} + 1), lambda k: {weight} * {density.format(x=point)})))"


def two_sided_normal(z: str) -> str:
    return f"greatest(0, 1 - 2 * {integral('exp(-{x} * {x} / 2)', f'least(abs({z}), 9.0)')} * 0.3989422804014327)"


def two_sided_t(t: str, df: str) -> str:
    """gamma_ratio is a column: gamma((df + 1) / 2) / gamma(df / 2)."""
    density = f"power(1 + {{x}} * {{x}} / ({df}), -(({df}) + 1) / 2.0)"
    return f"greatest(0, 1 - 2 * {integral(density, f'abs({t})')} * gamma_ratio / sqrt({df} * pi()))"


REGISTRY.add(
    "individual_curves",
    f"""
    SELECT id, g AS value, {r(fixed_score_sql('g'))} AS score, {r(fixed_score_sql('g') + ' - ' + fixed_score_sql('5e4'))} AS centred
    FROM book, (SELECT unnest([5e4, 2e5]) AS g)""",
    lambda b: explain.individual_curves(b, COLUMNS, "id", "amount", [5e4, 2e5], fixed_score),
)

REGISTRY.add(
    "mcnemar",
    f"""
    , d AS (SELECT (score >= 0.5) = (target = 1) AS a, (challenger >= 0.5) = (target = 1) AS b FROM book),
      k AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE b AND NOT a) AS y FROM d),
      s AS (SELECT x, y, (abs(x - y) - 1) ** 2 / (x + y) AS chi FROM k)
    SELECT x AS first_only, y AS second_only, {r('chi')} AS statistic, {r(two_sided_normal('sqrt(chi)'))} AS p_value FROM s""",
    lambda b: hypothesis_tests.mcnemar(b, (F.col("score") >= 0.5) == (F.col("target") == 1), (F.col("challenger") >= 0.5) == (F.col("target") == 1)),
)

REGISTRY.add(
    "two_sample_ks",
    f"""
    , h AS (SELECT amount, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split <> 'train') AS b FROM book GROUP BY amount),
      g AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d, sum(a) OVER () AS n, sum(b) OVER () AS m
            FROM h WINDOW w AS (ORDER BY amount ROWS UNBOUNDED PRECEDING)),
      s AS (SELECT max(d) AS d, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM g),
      x AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS x FROM s)
    SELECT {r('d')} AS statistic, n, m,
           {r('CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: power(-1, k - 1) * exp(-2 * k * k * x * x))))) END')} AS p_value
    FROM x""",
    lambda b: hypothesis_tests.kolmogorov_smirnov(b, "amount", F.col("split") == "train"),
)


def placed(score: str, name: str) -> str:
    return f"""{name} AS (
        SELECT s, (sum(q) OVER w - q / 2) / sum(q) OVER () AS below, 1 - (sum(p) OVER w - p / 2) / sum(p) OVER () AS above
        FROM (SELECT {score} AS s, CAST(sum(target) AS DOUBLE) AS p, CAST(sum(1 - target) AS DOUBLE) AS q FROM book GROUP BY 1)
        WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING))"""


REGISTRY.add(
    "delong",
    f"""
    , {placed('score', 'pa')}, {placed('challenger', 'pb')},
      v AS (SELECT target, CASE WHEN target = 1 THEN pa.below ELSE pa.above END AS a, CASE WHEN target = 1 THEN pb.below ELSE pb.above END AS b
            FROM book JOIN pa ON score = pa.s JOIN pb ON challenger = pb.s),
      g AS (SELECT target, count(*) AS n, avg(a) AS a, avg(b) AS b, var_samp(a) + var_samp(b) - 2 * covar_samp(a, b) AS v FROM v GROUP BY target),
      t AS (SELECT max(a) FILTER (WHERE target = 1) AS a, max(b) FILTER (WHERE target = 1) AS b, sum(v / n) AS variance FROM g)
    SELECT {r('a')} AS auc_a, {r('b')} AS auc_b, {r('variance', 12)} AS variance, {r('(a - b) / sqrt(variance)', 4)} AS z,
           {r(two_sided_normal('((a - b) / sqrt(variance))'))} AS p_value
    FROM t""",
    lambda b: hypothesis_tests.delong(b, "target", "score", "challenger").select(
        rounded("auc_a").alias("auc_a"), rounded("auc_b").alias("auc_b"), rounded("variance", 12).alias("variance"), rounded("z", 4).alias("z"), rounded("p_value").alias("p_value")
    ),
    digits=None,
)

MONTHS = ", m AS (SELECT strftime(date, '%Y-%m') AS month, avg(CAST(target AS DOUBLE)) - avg(score) AS e, avg(power(score - target, 2) - power(challenger - target, 2)) AS d FROM book GROUP BY 1)"


def monthly(b):
    loss = lambda c: (F.col(c) - F.col("target")) ** 2
    return b.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg((F.avg(F.col("target").cast("double")) - F.avg("score")).alias("e"), F.avg(loss("score") - loss("challenger")).alias("d"))


def lagged(k: int) -> str:
    return f"(sum(e * e{k}) / sum(e * e)) ** 2 / (count(*) - {k})"


REGISTRY.add(
    "ljung_box",
    MONTHS
    + f"""
    , c AS (SELECT e - avg(e) OVER () AS e, month FROM m),
      l AS (SELECT e, {', '.join(f'lag(e, {k}) OVER (ORDER BY month) AS e{k}' for k in range(1, 5))} FROM c),
      s AS (SELECT count(*) AS n, count(*) * (count(*) + 2) * ({' + '.join(map(lagged, range(1, 5)))}) AS q FROM l)
    SELECT n, {r('q')} AS statistic, {r('exp(-q / 2) * (1 + q / 2)')} AS p_value FROM s""",
    lambda b: hypothesis_tests.ljung_box(monthly(b), "month", "e"),
)

REGISTRY.add(
    "diebold_mariano",
    MONTHS
    + f"""
    , c AS (SELECT d - avg(d) OVER () AS d, avg(d) OVER () AS mean, month FROM m),
      l AS (SELECT d, mean, {', '.join(f'lag(d, {k}) OVER (ORDER BY month) AS d{k}' for k in range(1, 4))} FROM c),
      s AS (SELECT count(*) AS n, any_value(mean) AS mean, (sum(d * d) + 2 * ({' + '.join(f'(1 - {k} / 4.0) * sum(d * d{k})' for k in range(1, 4))})) / count(*) AS v FROM l),
      z AS (SELECT n, mean, mean / sqrt(v / n) AS z, exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) AS gamma_ratio FROM s)
    SELECT n, {r('mean', 8)} AS mean_difference, {r('z', 4)} AS statistic, {r(two_sided_t('z', '(n - 1)'))} AS p_value FROM z""",
    lambda b: hypothesis_tests.diebold_mariano(monthly(b), ["month"], "d").select(
        "n", rounded("mean_difference", 8).alias("mean_difference"), rounded("statistic", 4).alias("statistic"), rounded("p_value").alias("p_value")
    ),
    digits=None,
)

SSE = "(regr_syy(score, amount) - regr_sxy(score, amount) ** 2 / regr_sxx(score, amount))"
REGISTRY.add(
    "chow_break",
    f"""
    , a AS (SELECT count(*) AS n, {SSE} AS s FROM book), p AS (SELECT sum(s) AS s FROM (SELECT {SSE} AS s FROM book GROUP BY split = 'train')),
      f AS (SELECT n, ((a.s - p.s) / 2) / (p.s / (n - 4)) AS f FROM a, p)
    SELECT n, {r('f', 4)} AS statistic, {r('power(1 + 2 * f / (n - 4), -(n - 4) / 2.0)')} AS p_value FROM f""",
    lambda b: hypothesis_tests.chow(b, ["amount"], "score", F.col("split") == "train").select("n", rounded("statistic", 4).alias("statistic"), rounded("p_value").alias("p_value")),
    digits=None,
)

REGISTRY.add(
    "breusch_pagan",
    f"""
    , e AS (SELECT amount, balance, power(target - score, 2) AS e2 FROM book),
      c AS (SELECT count(*) AS n, corr(e2, amount) AS a, corr(e2, balance) AS b, corr(amount, balance) AS ab FROM e),
      l AS (SELECT n, n * (a * a + b * b - 2 * a * b * ab) / (1 - ab * ab) AS lm FROM c)
    SELECT n, {r('lm', 4)} AS statistic, {r('exp(-lm / 2)')} AS p_value FROM l""",
    lambda b: hypothesis_tests.breusch_pagan(b.withColumn("e2", (F.col("target") - F.col("score")) ** 2), ["amount", "balance"], "e2").select("n", rounded("statistic", 4).alias("statistic"), rounded("p_value").alias("p_value")),
    digits=None,
)

REGISTRY.add(
    "qq_residuals",
    f"""
    , o AS (SELECT row_number() OVER (ORDER BY target - score, id) AS place, count(*) OVER () AS n, target - score AS residual FROM book),
      q AS (SELECT place, residual, place / (n + 1.0::DOUBLE) AS p FROM o)
    SELECT place, {r('residual')} AS residual, {r(_normal_sql('p'))} AS normal_quantile FROM q""",
    lambda b: diagnostics.qq(b.withColumn("residual", F.col("target") - F.col("score")), "id", "residual").withColumn("place", F.col("place").cast("bigint")),
)

QUARTILES = ", ".join(f"{r(f'quantile_cont(e, {q / 100})', 4)} AS p{q}" for q in (25, 50, 75))
REGISTRY.add(
    "residual_summary",
    f"""
    SELECT 'residual' AS "column", count(e) AS n, {r('avg(e)', 4)} AS mean, {r('stddev_samp(e)', 4)} AS std, {r('min(e)', 4)} AS min, {QUARTILES}, {r('max(e)', 4)} AS max
    FROM (SELECT target - score AS e FROM book)""",
    lambda b: diagnostics.residual_summary(b, "target", "score"),
    digits=4,
)

EDGES = "list_concat([min(amount)], quantile_cont(amount, [0.2, 0.4, 0.6, 0.8]), [max(amount)])"
REGISTRY.add(
    "accumulated_effects",
    f"""
    , e AS (SELECT {EDGES} AS q FROM book),
      k AS (SELECT balance, q, least(greatest(len(list_filter(q, lambda v: v < amount)), 1), len(q) - 1) AS bin FROM book, e),
      g AS (SELECT bin, count(*) AS n, avg({fixed_score_sql('q[bin + 1]')} - {fixed_score_sql('q[bin]')}) AS effect FROM k GROUP BY bin)
    SELECT CAST(bin AS INTEGER) AS bin, n, {r('effect')} AS effect, {r('sum(effect) OVER (ORDER BY bin)')} AS accumulated FROM g""",
    lambda b: explain.accumulated_effects(b, COLUMNS, "amount", 5, fixed_score),
)

RANKED = """SELECT split, {k}, sum(pos * (nu - neg / 2)) / (any_value(pa) * any_value(na)) AS auc, max(abs(pu / pa - nu / na)) AS ks,
        sum(pos / pa * (pa - pu + pos) / (pa - pu + pos + na - nu + neg)) AS ap
    FROM (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER (PARTITION BY split) AS pa, sum(neg) OVER (PARTITION BY split) AS na
          FROM (SELECT split, {s} AS s, CAST(sum(target) AS DOUBLE) AS pos, CAST(sum(1 - target) AS DOUBLE) AS neg FROM {t} GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY split ORDER BY s ROWS UNBOUNDED PRECEDING))
    GROUP BY split"""


def neat_score(x):
    return rounded(fixed_score(x))


def dealt(feature: str) -> str:
    return f"""(SELECT o.* REPLACE (v.{feature} AS {feature})
        FROM (SELECT *, row_number() OVER (ORDER BY (id * 7919) % 1000003, id) AS place FROM book) o
        JOIN (SELECT {feature}, row_number() OVER (ORDER BY id) AS place FROM book) v USING (place))"""


REGISTRY.add(
    "permutation_importance",
    f"""
    , base AS ({RANKED.format(k="'base' AS feature", s=r(fixed_score_sql()), t='book')}),
      moved AS ({' UNION ALL '.join(RANKED.format(k=f"'{f}' AS feature", s=r(fixed_score_sql()), t=dealt(f)) for f in COLUMNS)})
    SELECT m.split, m.feature, {r('b.auc - m.auc')} AS auc, {r('b.ks - m.ks')} AS ks, {r('b.ap - m.ap')} AS average_precision
    FROM moved m JOIN base b USING (split)""",
    lambda b: explain.permutation_importance(b, COLUMNS, COLUMNS, "id", "target", neat_score, ("split",)),
)

# fits
REGISTRY.add(
    "panel_fit",
    f"""
    , d AS (SELECT amount - avg(amount) OVER w AS x, score - avg(score) OVER w AS y, entity FROM book WINDOW w AS (PARTITION BY entity)),
      s AS (SELECT count(*) AS n, count(DISTINCT entity) AS k, sum(x * y) / sum(x * x) AS b, sum(y * y) AS yy, sum(x * y) AS xy, sum(x * x) AS xx FROM d),
      e AS (SELECT b, sqrt((yy - b * xy) / (n - k - 1) / xx) AS se FROM s)
    SELECT 'amount' AS name, {r('b', 10)} AS coefficient, {r('se', 14)} AS std_error, {r('b / se', 3)} AS z, {r(two_sided_normal('(b / se)'))} AS p_value FROM e""",
    lambda b: models.within_entity(b, ["amount"], "score", "entity").table(b).select(
        "name", rounded("coefficient", 10).alias("coefficient"), rounded("std_error", 14).alias("std_error"), rounded("z", 3).alias("z"), rounded("p_value").alias("p_value")
    ),
    digits=None,
)

REGISTRY.add(
    "survival_fit",
    f"""
    , x AS (SELECT lgd AS x, ln(quantity) AS y FROM lines WHERE quantity > 0),
      s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, regr_sxx(y, x) AS xx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS v FROM x),
      t AS (SELECT 'intercept' AS name, a AS c, sqrt(v * (1.0 / n + m * m / xx)) AS se FROM s UNION ALL SELECT 'lgd', b, sqrt(v / xx) FROM s)
    SELECT name, {r('c')} AS coefficient, {r('se')} AS std_error, {r('c / se', 3)} AS z, {r(two_sided_normal('(c / se)'), 4)} AS p_value FROM t""",
    lambda d: models.accelerated_failure_time(d, ["lgd"], "quantity").table(d).select("name", rounded("coefficient").alias("coefficient"), rounded("std_error").alias("std_error"), rounded("z", 3).alias("z"), rounded("p_value", 4).alias("p_value")),
    digits=None,
    source=lines,
    base=LINES_SQL,
)
