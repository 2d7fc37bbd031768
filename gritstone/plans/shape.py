"""Queries of columns' shapes, encodings of numbers, fills and periods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import binning, hypothesis_tests, imputation, metrics, models, schema, shape, transforms
from gritstone.operators.transforms import Transform
from gritstone.plans.catalogue import r
from gritstone.plans.evidence import two_sided_normal
from gritstone.plans.registry import Registry
from gritstone.sources import tables

REGISTRY = Registry()
add = REGISTRY.add


def deviates(s: str, k: str, n: str) -> tuple[str, str]:
    """The deviates of skewness and kurtosis, with n as a double column."""
    y = f"({s} * sqrt(({n} + 1) * ({n} + 3) / (6 * ({n} - 2))))"
    b = f"(3 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w = f"(sqrt(2 * ({b} - 1)) - 1)"
    skew = f"(asinh({y} / sqrt(2 / ({w} - 1))) / sqrt(0.5 * ln({w})))"
    x = f"(({k} + 3 - 3 * ({n} - 1) / ({n} + 1)) / sqrt(24 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5))))"
    root = f"(6 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt(6 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))"
    a = f"(6 + 8 / {root} * (2 / {root} + sqrt(1 + 4 / ({root} * {root}))))"
    inner = f"((1 - 2 / {a}) / (1 + {x} * sqrt(2 / ({a} - 4))))"
    return skew, f"((1 - 2 / (9 * {a}) - sign({inner}) * pow(abs({inner}), 1 / 3.0::DOUBLE)) / sqrt(2 / (9 * {a})))"


def normal_row(c: str) -> str:
    """Population skewness and kurtosis from central moments."""
    skew, kurtosis = deviates("s", "k", "n")
    return f"""SELECT '{c}' AS "column", n::BIGINT AS n, {r('s', 4)} AS skewness, {r('k', 4)} AS kurtosis, {r(f'(pow({skew}, 2) + pow({kurtosis}, 2)) / n', 4)} AS statistic_per_row
        FROM (SELECT count(v)::DOUBLE AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS s, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS k
              FROM (SELECT {c} AS v, avg({c}) OVER () AS m FROM book WHERE {c} IS NOT NULL))"""


add(
    "normality",
    " " + " UNION ALL ".join(map(normal_row, ("sparse", "balance", "score"))),
    lambda b: shape.normality(b, ["sparse", "balance", "score"]).select("column", "n", "skewness", "kurtosis", (F.col("statistic") / F.col("n")).alias("statistic_per_row")),
    digits=4,
)


def described(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS distinct_values, (SELECT {c} FROM book WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
        (SELECT count(*) FROM book WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS frequency FROM book"""


add("describe_categories", " " + " UNION ALL ".join(map(described, ("segment", "sparse_segment", "state"))), lambda b: shape.describe_categories(b, ["segment", "sparse_segment", "state"]), digits=None)

PAIRS = [("sparse", "sparse"), ("sparse", "balance"), ("sparse", "score"), ("balance", "balance"), ("balance", "score"), ("score", "score")]
add(
    "covariances",
    " " + " UNION ALL ".join(f"""SELECT '{a}' AS "left", '{c}' AS "right", count(*) FILTER (WHERE {a} IS NOT NULL AND {c} IS NOT NULL) AS n, {r(f'covar_samp({a}, {c}) / 1e6', 4)} AS covariance FROM book""" for a, c in PAIRS),
    lambda b: shape.covariances(b, ["sparse", "balance", "score"]).withColumn("covariance", F.col("covariance") / 1e6),
    digits=4,
)


def associated(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {r('a / (a + b)')} AS rate_missing, {r('d / (d + e)')} AS rate_present, {r('a / (a + b) - d / (d + e)')} AS difference, {r('abs(a * e - b * d) / sqrt(p)')} AS relation,
        {r(two_sided_normal('sqrt(n * pow(greatest(abs(a * e - b * d) - n / 2, 0), 2) / p)'), 4)} AS p_value
        FROM (SELECT *, a + b + d + e AS n, (a + b) * (d + e) * (a + d) * (b + e) AS p FROM (
            SELECT sum(target) FILTER (WHERE {c} IS NULL)::DOUBLE AS a, sum(1 - target) FILTER (WHERE {c} IS NULL)::DOUBLE AS b, sum(target) FILTER (WHERE {c} IS NOT NULL)::DOUBLE AS d, sum(1 - target) FILTER (WHERE {c} IS NOT NULL)::DOUBLE AS e FROM book))"""


add(
    "missing_association",
    " " + " UNION ALL ".join(map(associated, ("sparse", "sparse_segment"))),
    lambda b: shape.missing_association(b, ["sparse", "sparse_segment"], "target").select(
        "column", *(rounded(c).alias(c) for c in ("rate_missing", "rate_present", "difference", "relation")), rounded("p_value", 4).alias("p_value")
    ),
    digits=None,
)


add(
    "segment_bias",
    f"""
    , e AS (SELECT coalesce(sparse_segment, 'Missing') AS segment, target - score AS e FROM book)
    SELECT segment, count(*) AS n, {r('avg(e)')} AS bias, {r('stddev_samp(e) / sqrt(count(*))')} AS std_error, {r('avg(e) / (stddev_samp(e) / sqrt(count(*)))', 4)} AS z FROM e GROUP BY segment""",
    lambda b: shape.segment_bias(b, "sparse_segment", "target", "score").select("segment", "n", rounded("bias").alias("bias"), rounded("std_error").alias("std_error"), rounded("z", 4).alias("z")),
    digits=None,
)


def residual_tests(b: DataFrame) -> DataFrame:
    """Spread and shape of the residuals in one table."""
    held = b.withColumn("e", F.col("target") - F.col("score")).withColumn("e2", F.col("e") * F.col("e"))
    spread = hypothesis_tests.breusch_pagan(held, ["amount", "balance"], "e2").select(F.lit("breusch_pagan").alias("test"), rounded("statistic", 3).alias("statistic"))
    return spread.unionByName(shape.normality(held, ["e"]).select(F.lit("normality_per_row").alias("test"), rounded(F.col("statistic") / F.col("n"), 3).alias("statistic")))


SKEW, KURTOSIS = deviates("s", "k", "n")
add(
    "residual_tests",
    f"""
    , e AS (SELECT amount, balance, target - score AS v, pow(target - score, 2) AS e2, avg(target - score) OVER () AS m FROM book),
      c AS (SELECT count(*) AS n, corr(e2, amount) AS a, corr(e2, balance) AS b, corr(amount, balance) AS ab FROM e),
      q AS (SELECT count(v)::DOUBLE AS n, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS s, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS k FROM e)
    SELECT 'breusch_pagan' AS test, {r('n * (a * a + b * b - 2 * a * b * ab) / (1 - ab * ab)', 3)} AS statistic FROM c
    UNION ALL SELECT 'normality_per_row', {r(f'(pow({SKEW}, 2) + pow({KURTOSIS}, 2)) / n', 3)} FROM q""",
    residual_tests,
    digits=None,
)

KEYED = """, q AS (SELECT list_distinct(quantile_cont(sparse, [0.25, 0.5, 0.75])) AS q FROM book WHERE split = 'train'),
      k AS (SELECT id, split, target, CASE WHEN sparse IS NULL THEN 'Missing' ELSE len(list_filter(q, lambda e: sparse > e))::VARCHAR END AS key FROM book, q),
      g AS (SELECT key, count(*) AS n, sum(target) AS events FROM k WHERE split = 'train' GROUP BY key)"""
add(
    "woe_encoding_numeric",
    KEYED
    + f"""
    , w AS (SELECT key, (events + 0.5) / (sum(events) OVER () + 0.5 * count(*) OVER ()) AS bad, (n - events + 0.5) / (sum(n - events) OVER () + 0.5 * count(*) OVER ()) AS good FROM g)
    SELECT id, {r('coalesce(ln(good / bad), 0)')} AS code FROM k LEFT JOIN w USING (key)""",
    lambda b: binning.evidence_encoding(b, b.where("split = 'train'"), "sparse", "target", "code", 4).select("id", "code"),
)
add(
    "bad_rate_encoding_numeric",
    KEYED + f" SELECT id, {r('coalesce(events / n, (SELECT sum(events) / sum(n) FROM g))')} AS code FROM k LEFT JOIN g USING (key)",
    lambda b: binning.evidence_encoding(b, b.where("split = 'train'"), "sparse", "target", "code", 4, "bad_rate").select("id", "code"),
)

add(
    "date_parts",
    " SELECT id, year(date)::INTEGER AS date_year, month(date)::INTEGER AS date_month, quarter(date)::INTEGER AS date_quarter, day(date)::INTEGER AS date_day, (isodow(date) - 1)::INTEGER AS date_dayofweek FROM book",
    lambda b: b.select("id", *(x.alias(n) for n, x in shape.date_parts("date").items())),
    digits=None,
)

add(
    "period_terms",
    """
    , p AS (SELECT id, row_number() OVER (PARTITION BY entity ORDER BY date, id)::DOUBLE AS period FROM book) SELECT id, period, period * period AS period_squared FROM p""",
    lambda b: b.select("id", *(x.alias(n) for n, x in shape.period_terms(["entity"], ["date", "id"]).items())),
)

add(
    "rows_since_event",
    """
    , p AS (SELECT id, target, entity, date, row_number() OVER w AS place FROM book WINDOW w AS (PARTITION BY entity ORDER BY date, id))
    SELECT id, (place - last_value(CASE WHEN target = 1 THEN place END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date, id ROWS UNBOUNDED PRECEDING))::INTEGER AS since FROM p""",
    lambda b: shape.rows_since(b, F.col("target") == 1, ["entity"], ["date", "id"], "since").select("id", F.col("since").cast("int").alias("since")),
    digits=None,
)

add(
    "impute_mean_constant",
    f"""
    , t AS (SELECT avg(sparse) AS m FROM book WHERE split = 'train')
    SELECT id, {r('coalesce(sparse, m)', 3)} AS sparse, coalesce(sparse_segment, 'none') AS sparse_segment FROM book, t""",
    lambda b: imputation.fill(b, imputation.fit_fills(b.where("split = 'train'"), {"sparse": ("mean", None), "sparse_segment": ("constant", "none")}), False).select("id", "sparse", "sparse_segment"),
    digits=3,
)

add(
    "impute_group_median",
    f"""
    , t AS (SELECT state AS g, quantile_cont(sparse, 0.5) AS m FROM book WHERE split = 'train' AND state <> '5-LOW' GROUP BY 1), a AS (SELECT quantile_cont(sparse, 0.5) AS m FROM book WHERE split = 'train' AND state <> '5-LOW')
    SELECT id, {r('coalesce(sparse, t.m, a.m)', 3)} AS sparse FROM book CROSS JOIN a LEFT JOIN t ON state = g""",
    lambda b: imputation.fill_by_group(b, b.where("split = 'train' AND state <> '5-LOW'"), "sparse", ["state"], "median").select("id", "sparse"),
    digits=3,
)


def compared(b: DataFrame) -> DataFrame:
    joined = metrics.joined_scores(b.select("id", "target", "score"), b.select("id", F.col("challenger").alias("score")).where("id % 17 <> 0"), ["id"], "target", "score")
    return metrics.comparison_table(joined, "target", ["primary", "challenger"]).withColumn("place", F.col("place").cast("int"))


def measured(model: str) -> str:
    return f"""SELECT '{model}' AS model, * FROM (SELECT sum(pos * (nu - neg / 2)) / any_value(p) / any_value(q) AS auc, max(abs(pu / p - nu / q)) AS ks, sum(pos / p * (p - pu + pos) / (p - pu + pos + q - nu + neg)) AS average_precision
        FROM (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER () AS p, sum(neg) OVER () AS q
              FROM (SELECT {model} AS s, sum(target)::DOUBLE AS pos, sum(1 - target)::DOUBLE AS neg FROM j GROUP BY 1) WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING))),
        (SELECT avg(({model} - target) ** 2) AS brier, avg(-(target * ln({model}) + (1 - target) * ln(1 - {model}))) AS log_loss FROM j)"""


add(
    "model_comparison_table",
    f"""
    , j AS (SELECT id, target, score AS primary, challenger FROM book WHERE id % 17 <> 0), m AS ({measured('"primary"')} UNION ALL {measured('challenger')})
    SELECT replace(model, '"', '') AS model, {', '.join(f'{r(c)} AS {c}' for c in ('auc', 'ks', 'average_precision', 'brier', 'log_loss'))}, row_number() OVER (ORDER BY auc DESC, model)::INTEGER AS place FROM m""".replace("score AS primary", 'score AS "primary"'),
    compared,
)

TREES = {"maxDepth": 3}


def tree_scores(kind: str):
    def build(b: DataFrame) -> DataFrame:
        held = b.select("id", "split", "amount", "balance", "target")
        more = {"numTrees": 10} if kind == "random_forest" else {"maxIter": 10} if kind != "decision_tree" else {}
        depth = {} if kind == "shallow_boosted" else TREES
        scored = models.tree_model(held.where("split = 'train'"), ["amount", "balance"], "target", kind, **depth, **more).transform(held)
        return scored.groupBy("split", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))

    return build


for _kind in ("random_forest", "boosted", "shallow_boosted"):
    add(f"{_kind}_classes", None, tree_scores(_kind), digits=None)


def power_fit(b: DataFrame) -> DataFrame:
    """No neighbour of the fitted exponent, a hundredth away, is likelier."""
    held = b.select((F.col("amount") / 1e5).alias("x"))
    fitted = transforms.fit(held, [Transform("box_cox", "x")])[0].params["lambda"]
    points = [fitted - 0.01, fitted, fitted + 0.01]
    row = held.agg(F.sum(F.log("x")).alias("j"), F.count("*").alias("n"), *(F.var_pop((F.pow(F.col("x"), F.lit(p)) - 1) / p).alias(f"v{k}") for k, p in enumerate(points))).first()
    value = [-row["n"] / 2 * math.log(row[f"v{k}"]) + (p - 1) * row["j"] for k, p in enumerate(points)]
    return b.sparkSession.createDataFrame([(row["n"], max(value) == value[1], 0 < fitted < 2)], "n bigint, likeliest boolean, between boolean")


add("box_cox_fit", " SELECT count(*) AS n, TRUE AS likeliest, TRUE AS between FROM book", power_fit, digits=None)


def kept_columns(b: DataFrame) -> DataFrame:
    held = schema.drop_empty_columns(b.withColumns({"gone": F.lit(None).cast("double"), "spared": F.lit(None).cast("string")}), ("spared",))
    return b.sparkSession.createDataFrame([(c,) for c in held.columns], "`column` string")


add(
    "drop_empty_columns",
    """ SELECT unnest(['id', 'entity', 'date', 'segment', 'state', 'amount', 'balance', 'sparse', 'sparse_segment', 'target', 'score', 'challenger', 'split', 'spared']) AS "column" """,
    kept_columns,
    digits=None,
)

add("preview", " SELECT count(*) AS n FROM (SELECT id, amount FROM book LIMIT 25)", lambda b: tables.preview(b, 25, ["id", "amount"]).agg(F.count("*").alias("n")), digits=None)


def service_ratio(b: DataFrame) -> DataFrame:
    fitted = transforms.fit(b, [Transform("debt_service_ratio", "amount", "ratio", second="balance")])[0]
    return b.select("id", rounded(transforms.column(fitted), 4).alias("ratio"))


add("debt_service_ratio", f" SELECT id, {r('CASE WHEN abs(balance) > 1e-12 THEN amount / balance END', 4)} AS ratio FROM book", service_ratio, digits=None)
