"""Queries of feature screens and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators import selection
from gritstone.plans.catalogue import r
from gritstone.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

NUMERIC, CATEGORICAL = ["amount", "balance", "challenger", "sparse"], ["segment", "sparse_segment"]
TRAIN = ", t AS (SELECT * FROM book WHERE split = 'train')"

#: Every feature's value as the score sees it: gaps at the median, categories as their rate.
ENCODED = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, target, coalesce({c}, median({c}) OVER ()) AS v FROM t" for c in NUMERIC]
    + [f"SELECT '{c}', target, avg(target::DOUBLE) OVER (PARTITION BY coalesce({c}, 'Missing')) FROM t" for c in CATEGORICAL]
)
SCORES = f"""
    , e AS ({ENCODED}),
      k AS (SELECT feature, v, sum(target)::DOUBLE AS pos, sum(1 - target)::DOUBLE AS neg FROM e GROUP BY 1, 2),
      a AS (SELECT feature, pos, neg, sum(neg) OVER w AS upto, sum(pos) OVER (PARTITION BY feature) AS p, sum(neg) OVER (PARTITION BY feature) AS q FROM k WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
      s AS (SELECT feature, abs(sum(pos * (upto - neg / 2)) / any_value(p) / any_value(q) - 0.5) * 2 AS score FROM a GROUP BY feature)"""

RULES = selection.Rules(least_score=0.0, most_correlation=0.7, most_features=4, include=["challenger"], exclude=["segment"])


def table(b: DataFrame) -> DataFrame:
    train = b.where("split = 'train'")
    return selection.choice_table(b, selection.select_features(train, NUMERIC, CATEGORICAL, "target", RULES))


FILLED = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in NUMERIC)
NEAR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, abs(corr({a}, {c})) AS r FROM f" for a in NUMERIC for c in NUMERIC if a != c)
add(
    "feature_selection",
    TRAIN
    + SCORES
    + f""",
      f AS (SELECT {FILLED} FROM t), n AS (SELECT a, coalesce(list(b) FILTER (WHERE r >= 0.7), []) AS rivals FROM ({NEAR}) GROUP BY a),
      o AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS place, rivals FROM s JOIN n ON a = feature),
      g AS (
        WITH RECURSIVE g AS (
            SELECT 0::BIGINT AS place, NULL::VARCHAR AS feature, NULL::VARCHAR AS rival, []::VARCHAR[] AS kept
            UNION ALL
            SELECT o.place, o.feature, CASE WHEN o.feature <> 'challenger' THEN list_filter(kept, lambda k: list_contains(rivals, k))[1] END,
                   CASE WHEN o.feature = 'challenger' OR len(list_intersect(kept, rivals)) = 0 THEN list_append(kept, o.feature) ELSE kept END
            FROM g JOIN o ON o.place = g.place + 1)
        SELECT * FROM g),
      d AS (SELECT s.feature, score, CASE WHEN s.feature IN ('segment', 'sparse_segment') THEN 'categorical' ELSE 'numeric' END AS type,
                   CASE WHEN s.feature = 'segment' THEN 'locked_exclude' WHEN g.rival IS NOT NULL THEN 'correlated_with:' || g.rival END AS gone
            FROM s LEFT JOIN g USING (feature)),
      m AS (SELECT *, CASE WHEN gone IS NULL AND feature <> 'challenger' THEN row_number() OVER (PARTITION BY gone IS NULL AND feature <> 'challenger' ORDER BY score DESC, feature) END AS place FROM d)
    SELECT feature, type, {r('score')} AS score, gone IS NULL AND coalesce(place <= 3, TRUE) AS selected,
           coalesce(gone, CASE WHEN feature = 'challenger' THEN 'locked_include' WHEN place > 3 THEN 'max_feature_cap' ELSE 'screen_passed' END) AS reason
    FROM m""",
    table,
)


def screen(b: DataFrame) -> DataFrame:
    held = b.withColumn("flat", F.lit(1.0))
    return selection.prescreen(held, ["balance", "sparse", "flat"], ["segment", "sparse_segment"], "target", F.col("split") == "train")


def iv(c: str, numeric: bool) -> str:
    source = f"(SELECT quantile_cont({c}, [{', '.join(f'{k / 10}::DOUBLE' for k in range(1, 10))}]) AS q FROM t)"
    key = f"len(list_filter(list_distinct(q), lambda e: {c} > e))::VARCHAR" if numeric else f"coalesce({c}, 'Missing')"
    where = f"WHERE {c} IS NOT NULL" if numeric else ""
    return f"""(SELECT sum((b - g) * ln(b / g)) FROM (SELECT bad / sum(bad) OVER () AS b, good / sum(good) OVER () AS g FROM (
        SELECT sum(target) + 0.5::DOUBLE AS bad, sum(1 - target) + 0.5::DOUBLE AS good FROM t{', ' + source if numeric else ''} {where} GROUP BY {key})))"""


def psi(c: str, numeric: bool) -> str:
    source = f", (SELECT quantile_cont({c}, [{', '.join(f'{k / 10}::DOUBLE' for k in range(11))}]) AS q FROM t)" if numeric else ""
    key = f"CASE WHEN {c} BETWEEN q[1] AND q[11] THEN len(list_filter(list_distinct(q[2:10]), lambda e: {c} > e))::VARCHAR ELSE 'outside' END" if numeric else f"coalesce({c}, 'Missing')"
    return f"""(SELECT sum((a - e) * ln(a / e)) FROM (SELECT greatest(e / sum(e) OVER (), 0.0001) AS e, greatest(a / sum(a) OVER (), 0.0001) AS a FROM (
        SELECT count(*) FILTER (WHERE split = 'train') AS e, count(*) FILTER (WHERE split <> 'train') AS a FROM book{source} GROUP BY {key})))"""


def screened(c: str, numeric: bool) -> str:
    return f"""SELECT '{c}' AS feature, '{'numeric' if numeric else 'categorical'}' AS type, count(*) AS n, {r(f'1 - count({c}) / count(*)')} AS missing, count(DISTINCT {c}) AS distinct_values,
        {r(f'var_samp({c})', 2) if numeric else 'NULL::DOUBLE'} AS variance, {r(f"(SELECT score FROM s WHERE feature = '{c}')")} AS score, {r(iv(c, numeric))} AS iv, {r(psi(c, numeric))} AS psi, 'retain' AS action, 'screen_passed' AS reason FROM t"""


add(
    "feature_prescreen",
    TRAIN
    + SCORES
    + " "
    + " UNION ALL ".join(screened(c, n) for c, n in (("balance", True), ("sparse", True), ("segment", False), ("sparse_segment", False)))
    + " UNION ALL SELECT 'flat', 'numeric', count(*), 0.0, 1, 0.0, 0.0, 0.0, NULL, 'exclude', 'low_variance' FROM t",
    lambda b: screen(b).select("feature", "type", "n", "missing", "distinct_values", F.expr("floor(variance * 1e2 + 0.5) / 1e2").alias("variance"), "score", "iv", "psi", "action", "reason"),
)
