"""Queries of effects, checks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import category, rounded
from gritstone.operators import binning, checks, diagnostics, effects, explain, metrics, selection
from gritstone.plans.catalogue import banded, fixed_score, r
from gritstone.plans.evidence import COLUMNS, EDGES, fixed_score_sql
from gritstone.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add
S = fixed_score_sql

add(
    "ale_centred",
    f"""
    , e AS (SELECT {EDGES} AS q FROM book),
      k AS (SELECT balance, q, least(greatest(len(list_filter(q, lambda v: v < amount)), 1), len(q) - 1) AS bin FROM book, e),
      g AS (SELECT bin, count(*) AS n, avg({S('q[bin + 1]')} - {S('q[bin]')}) AS effect FROM k GROUP BY bin),
      a AS (SELECT *, sum(effect) OVER (ORDER BY bin) AS a FROM g)
    SELECT CAST(bin AS INTEGER) AS bin, n, {r('effect')} AS effect, {r('a - avg(a) OVER ()')} AS centred FROM a""",
    lambda b: effects.centred_effects(b, COLUMNS, "amount", 5, fixed_score),
)

GRIDS = {"amount": [5e4, 2e5, 4e5], "balance": [0.0, 5e3]}
add(
    "interaction_strength",
    f"""
    , g AS (SELECT a, b FROM (SELECT unnest([5e4, 2e5, 4e5]) AS a), (SELECT unnest([0.0::DOUBLE, 5e3]) AS b)),
      c AS (SELECT a, b, avg({S('a', 'b')}) - avg({S('a', 'balance')}) - avg({S('amount', 'b')}) + avg({S()}) AS d FROM book, g GROUP BY a, b)
    SELECT 'amount' AS a, 'balance' AS b, {r('avg(abs(d))')} AS mean_absolute, {r('max(abs(d))')} AS largest_absolute, {r('avg(d)')} AS mean_signed, count(*)::INTEGER AS cells FROM c""",
    lambda b: effects.interaction_strength(b, COLUMNS, [("amount", "balance")], GRIDS, fixed_score),
)

add(
    "effect_stability",
    f"""
    , g AS (SELECT split, v, avg({S('v')}) AS m FROM book, (SELECT unnest([5e4, 2e5, 4e5]) AS v) GROUP BY 1, 2)
    SELECT split, v AS value, {r('m')} AS mean_score, {r('max(m) OVER (PARTITION BY v) - min(m) OVER (PARTITION BY v)')} AS spread FROM g""",
    lambda b: effects.effect_stability(b, COLUMNS, "amount", GRIDS["amount"], fixed_score),
)

REPLICATES = 20
add(
    "resampled_bands",
    f"""
    , o AS (SELECT balance, row_number() OVER (ORDER BY id) AS place FROM book), n AS (SELECT count(*) AS n FROM book),
      d AS (SELECT k, ('0x' || sha256('42:' || k || ':' || i)[1:13])::BIGINT % n + 1 AS place FROM n, (SELECT unnest(range(0, {REPLICATES})) AS k), (SELECT unnest(range(0, (SELECT n FROM n))) AS i)),
      m AS (SELECT k, v, avg({S('v')}) AS m FROM d JOIN o USING (place), (SELECT unnest([5e4, 2e5, 4e5]) AS v) GROUP BY k, v)
    SELECT v AS value, {r(f'(SELECT avg({S("v")}) FROM o)')} AS mean_score, {r('quantile_cont(m, 0.05)')} AS low, {r('quantile_cont(m, 0.95)')} AS high FROM m GROUP BY v""",
    lambda b: effects.resampled_bands(b, COLUMNS, "id", "amount", GRIDS["amount"], fixed_score, REPLICATES),
)

DECILES = f"[{', '.join(f'{k / 10}::DOUBLE' for k in range(1, 10))}]"
add(
    "effect_calibration",
    f"""
    , q AS (SELECT list_distinct(quantile_cont(sparse, {DECILES})) AS q FROM book),
      t AS (SELECT coalesce(sparse_segment, 'Missing') AS level FROM book GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
      c AS (SELECT 'sparse' AS feature, CASE WHEN sparse IS NULL THEN 'Missing' ELSE len(list_filter(q, lambda e: sparse > e))::VARCHAR END AS bucket, score, target FROM book, q
            UNION ALL SELECT 'sparse_segment', coalesce(level, 'Other'), score, target FROM book LEFT JOIN t ON coalesce(sparse_segment, 'Missing') = level)
    SELECT feature, bucket, count(*) AS n, {r('avg(score)')} AS mean_score, {r('avg(target::DOUBLE)')} AS mean_target, {r('avg(target::DOUBLE) - avg(score)')} AS gap FROM c GROUP BY 1, 2""",
    lambda b: effects.effect_calibration(b, ["sparse", "sparse_segment"], "target", "score", 10, 3),
)

add(
    "deviation_shocks",
    f"""
    , s AS (SELECT 1.5 * stddev_pop(amount) AS a, 1.5 * stddev_pop(balance) AS b FROM book),
      m AS (SELECT any_value(a) AS a, any_value(b) AS b, avg({S()}) AS base, avg({S('(amount + a)')}) AS sa, avg({S('amount', '(balance + b)')}) AS sb FROM book, s),
      u AS (SELECT 'amount' AS feature, a AS shock, base, sa AS shocked FROM m UNION ALL SELECT 'balance', b, base, sb FROM m)
    SELECT feature, {r('shock', 4)} AS shock, {r('base')} AS base, {r('shocked')} AS shocked, {r('shocked - base')} AS change FROM u""",
    lambda b: effects.deviation_shocks(b, COLUMNS, COLUMNS, fixed_score, 1.5).select("feature", rounded("shock", 4).alias("shock"), *(rounded(c).alias(c) for c in ("base", "shocked", "change"))),
    digits=None,
)

FILLS = {"median": 150000.0, "zero": 0.0, "high": 400000.0}


def fills(b: DataFrame) -> DataFrame:
    score = lambda x: fixed_score({"amount": x["sparse"], "balance": x["balance"]})
    out = effects.imputation_sensitivity(b, ["sparse", "balance"], "sparse", FILLS, "median", "target", score)
    return out.select("policy", "fill", *(rounded(c).alias(c) for c in ("mean_change", "mean_absolute", "largest_absolute", "auc_change")))


def filled_auc(v: float) -> str:
    return f"""(SELECT sum(pos * (upto - neg / 2)) / sum(pos) / sum(neg) FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto
        FROM (SELECT {S(f'coalesce(sparse, {v})')} AS s, sum(target)::DOUBLE AS pos, sum(1 - target)::DOUBLE AS neg FROM book GROUP BY 1)))"""


add(
    "imputation_sensitivity",
    f"""
    , d AS (SELECT p AS policy, v AS fill, {S('coalesce(sparse, v)')} - {S('coalesce(sparse, 150000.0)')} AS d FROM book, (VALUES ('zero', 0.0::DOUBLE), ('high', 400000.0::DOUBLE)) AS x(p, v))
    SELECT policy, fill, {r('avg(d)')} AS mean_change, {r('avg(abs(d))')} AS mean_absolute, {r('max(abs(d))')} AS largest_absolute,
           {r(f"CASE policy WHEN 'zero' THEN {filled_auc(0.0)} ELSE {filled_auc(400000.0)} END - {filled_auc(150000.0)}")} AS auc_change
    FROM d GROUP BY policy, fill""",
    fills,
    digits=None,
)

# metrics
F1 = """, c AS (SELECT state, CASE WHEN amount < 150000 THEN state WHEN balance < 0 THEN '1-URGENT' ELSE '5-LOW' END AS guess FROM book),
      k AS (SELECT coalesce(a.state, b.guess) AS class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hit, 0) AS hit
            FROM (SELECT state, count(*) AS support, count(*) FILTER (WHERE state = guess) AS hit FROM c GROUP BY state) a
            FULL JOIN (SELECT guess, count(*) AS predicted FROM c GROUP BY guess) b ON a.state = b.guess)"""
add(
    "multiclass_summary",
    F1
    + f""" SELECT (SELECT count(*) FROM c) AS n, count(*) AS classes, {r('(SELECT avg((state = guess)::INT) FROM c)')} AS accuracy,
        {r('avg(2 * hit / (support + predicted))')} AS macro_f1, {r('sum(2 * hit / (support + predicted) * support) / sum(support)')} AS weighted_f1,
        {r('(SELECT avg(-ln(CASE WHEN state = guess THEN 0.8::DOUBLE ELSE 0.05 END)) FROM c)')} AS log_loss FROM k""",
    lambda b: metrics.multiclass_summary(
        b.withColumn("guess", F.when(F.col("amount") < 150000, F.col("state")).when(F.col("balance") < 0, "1-URGENT").otherwise("5-LOW")),
        "state",
        "guess",
        F.when(F.col("state") == F.col("guess"), 0.8).otherwise(0.05),
    ),
)

add(
    "woe_floored",
    f"""
    , k AS (SELECT coalesce(sparse_segment, 'Missing') AS key, count(*) AS n, sum(target)::BIGINT AS events FROM book GROUP BY 1),
      w AS (SELECT *, greatest(events::DOUBLE, 0.5) / greatest(sum(events) OVER (), 1) AS bad, greatest((n - events)::DOUBLE, 0.5) / greatest(sum(n - events) OVER (), 1) AS good FROM k)
    SELECT key, n, events, {r('ln(good / bad)')} AS woe, {r('(good - bad) * ln(good / bad)', 8)} AS iv FROM w""",
    lambda b: binning.floored_woe_table(b, category("sparse_segment"), "target").select("key", "n", "events", rounded("woe").alias("woe"), rounded("iv", 8).alias("iv")),
    digits=None,
)

add(
    "stability_by_feature",
    f"""
    , t AS (SELECT * FROM book WHERE split = 'train'), q AS (SELECT quantile_cont(amount, [{', '.join(f'{k / 10}::DOUBLE' for k in range(11))}]) AS q FROM t),
      c AS (SELECT 'amount' AS feature, CASE WHEN amount BETWEEN q[1] AND q[11] THEN len(list_filter(list_distinct(q[2:10]), lambda e: amount > e))::VARCHAR ELSE 'outside' END AS bin, split FROM book, q
            UNION ALL SELECT 'state', state, split FROM book),
      n AS (SELECT feature, bin, count(*) FILTER (WHERE split = 'train') AS e, count(*) FILTER (WHERE split <> 'train') AS a FROM c GROUP BY 1, 2),
      s AS (SELECT feature, greatest(e / sum(e) OVER w, 0.0001) AS e, greatest(a / sum(a) OVER w, 0.0001) AS a FROM n WINDOW w AS (PARTITION BY feature))
    SELECT feature, {r('sum((a - e) * ln(a / e))')} AS psi FROM s GROUP BY feature""",
    lambda b: b.sparkSession.createDataFrame(list(selection.stability(b, F.col("split") == "train", ["amount"], ["state"]).items()), "feature string, psi double"),
)



def calibration(b: DataFrame) -> DataFrame:
    """Bands and slope on the score; the intercept's and slope's equations stand for themselves."""
    out = metrics.calibration_fit(b, banded(b), "target", "score")
    return out.select(*(rounded(c).alias(c) for c in ("ece", "mce")), rounded("hosmer_lemeshow", 4).alias("hosmer_lemeshow"), "degrees", rounded("p_value").alias("p_value"))


BANDS = """, ranked AS (SELECT *, row_number() OVER (ORDER BY score, id) AS rn, greatest(count(*) OVER () - 1, 1) AS m FROM book),
      banded AS (SELECT *, CAST(greatest(1, ((rn - 1) * 10 + m - 1) // m) AS INTEGER) AS band FROM ranked),
      c AS (SELECT count(*) AS n, avg(score) AS e, avg(target::DOUBLE) AS o FROM banded GROUP BY band),
      h AS (SELECT sum(n * abs(o - e)) / sum(n) AS ece, max(abs(o - e)) AS mce, sum(n * (o - e) * (o - e) / (e * (1 - e))) AS hl FROM c)"""
add(
    "calibration_fit",
    BANDS + f" SELECT {r('ece')} AS ece, {r('mce')} AS mce, {r('hl', 4)} AS hosmer_lemeshow, 8 AS degrees, {r('exp(-hl / 2) * (1 + hl / 2 + hl * hl / 8 + hl * hl * hl / 48)')} AS p_value FROM h",
    calibration,
    digits=None,
)

# checks
EXPECTED = checks.Expected(mode="binary", model="beta_regression", structure="panel", date="date", entity="nobody", segments=["segment", "state"], most_segments=20, most_missing=0.08)
BOOK_COLUMNS = ["id", "entity", "date", "segment", "state", "amount", "balance", "sparse", "sparse_segment", "target", "score", "challenger", "split"]


def missing_rows() -> str:
    one = "SELECT 'missing', '{c}', printf('%.6f', 1 - count({c}) / count(*)), 'at most 0.08', 1 - count({c}) / count(*) <= 0.08 FROM book"
    return " UNION ALL ".join(one.format(c=c) for c in BOOK_COLUMNS)


add(
    "dataset_checks",
    f"""
    SELECT 'target_values' AS "check", 'target' AS subject, count(DISTINCT target)::VARCHAR AS observed, '2' AS expected, count(DISTINCT target) = 2 AS passed FROM book
    UNION ALL SELECT 'target_bounds', 'target', min(target)::DOUBLE::VARCHAR || ' to ' || max(target)::DOUBLE::VARCHAR, '0.0 to 1.0', min(target) >= 0 AND max(target) <= 1 FROM book
    UNION ALL SELECT 'date_column', 'date', 'present', 'present', TRUE UNION ALL SELECT 'entity_column', 'nobody', 'missing', 'present', FALSE
    UNION ALL SELECT 'segment_column', 'segment', 'present', 'present', TRUE UNION ALL SELECT 'segment_column', 'state', 'present', 'present', TRUE
    UNION ALL SELECT 'segments', 'segment,state', count(*)::VARCHAR, 'at most 20', count(*) <= 20 FROM (SELECT DISTINCT segment, state FROM book)
    UNION ALL {missing_rows()}""",
    lambda b: checks.dataset_checks(b, "target", EXPECTED),
    digits=None,
)

POLICY = checks.Policy(required=["amount", "tenure"], excluded=["state"], most_missing=0.05, most_vif=1.5, least_iv=0.0001, signs={"amount": "positive", "balance": "positive", "tenure": "negative"}, monotone={"amount": "increasing", "balance": "increasing"})


def policies(b: DataFrame) -> DataFrame:
    names = ["amount", "balance", "sparse"]
    row = b.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names)).first().asDict()
    vif = {r["column"]: r["vif"] for r in diagnostics.vif(b, ["amount", "balance"]).collect()}
    curves = {c: [r["mean_score"] for r in explain.partial_dependence(b, COLUMNS, c, GRIDS[c], fixed_score).orderBy("value").collect()] for c in COLUMNS}
    iv = selection.information_values(b, ["balance"], [], "target")
    return checks.policy_checks(b, names, POLICY, row, vif, iv, {"amount": 1 / 4e5, "balance": -1 / 2e4}, curves).select("check", "subject", "expected", "passed")


add(
    "feature_policy_checks",
    """
    , v AS (SELECT 1 / (1 - corr(amount, balance) ** 2) AS v, 1 - count(sparse) / count(*) AS m FROM book)
    SELECT 'required_feature' AS "check", 'amount' AS subject, 'present' AS expected, TRUE AS passed UNION ALL SELECT 'required_feature', 'tenure', 'present', FALSE
    UNION ALL SELECT 'excluded_feature', 'state', 'missing', TRUE UNION ALL SELECT 'most_missing', 'amount', '0.05', TRUE UNION ALL SELECT 'most_missing', 'balance', '0.05', TRUE
    UNION ALL SELECT 'most_missing', 'sparse', '0.05', m <= 0.05 FROM v UNION ALL SELECT 'most_vif', 'amount', '1.5', v <= 1.5 FROM v UNION ALL SELECT 'most_vif', 'balance', '1.5', v <= 1.5 FROM v
    UNION ALL SELECT 'least_iv', 'balance', '0.0001', TRUE UNION ALL SELECT 'expected_sign', 'amount', 'positive', TRUE UNION ALL SELECT 'expected_sign', 'balance', 'positive', FALSE
    UNION ALL SELECT 'expected_sign', 'tenure', 'negative', FALSE UNION ALL SELECT 'monotone', 'amount', 'increasing', TRUE UNION ALL SELECT 'monotone', 'balance', 'increasing', FALSE""",
    policies,
    digits=None,
)


def constructed(b: DataFrame) -> DataFrame:
    held = b.withColumns({"crossed": F.col("amount") * F.col("balance") / 1e8, "sparse_missing": F.col("sparse").isNull().cast("int"), "share": F.col("sparse") / F.col("amount")})
    return checks.workbench(held, {"crossed": ("interaction", ["amount", "balance"]), "sparse_missing": ("missing_indicator", ["sparse"]), "share": ("ratio", ["sparse", "amount"])}, "target")


def worked(name: str, kind: str, sources: str, x: str) -> str:
    return f"""SELECT '{name}' AS feature, '{kind}' AS kind, '{sources}' AS sources, {r(f'count({x}) / count(*)')} AS known, count(DISTINCT {x}) AS distinct_values, {r(f'avg({x})', 4)} AS mean,
        {r(f'stddev_pop({x})', 4)} AS std, CASE WHEN stddev_pop({x}) > 0 THEN {r(f'abs(corr({x}, target))', 4)} END AS relation FROM book"""


add(
    "feature_workbench",
    " " + " UNION ALL ".join([worked("crossed", "interaction", "amount,balance", "(amount * balance / 1e8)"), worked("sparse_missing", "missing_indicator", "sparse", "(CASE WHEN sparse IS NULL THEN 1 ELSE 0 END)"), worked("share", "ratio", "sparse,amount", "(sparse / amount)")]),
    lambda b: constructed(b).select("feature", "kind", "sources", rounded("known").alias("known"), "distinct_values", *(rounded(c, 4).alias(c) for c in ("mean", "std", "relation"))),
    digits=None,
)

add(
    "quality_summary",
    f"""
    , n AS (SELECT count(*) AS n, {' + '.join(f'count({c})' for c in BOOK_COLUMNS)} AS known FROM book)
    SELECT 'rows' AS fact, n AS value FROM n UNION ALL SELECT 'columns', {len(BOOK_COLUMNS)} UNION ALL SELECT 'repeated_keys', n - (SELECT count(*) FROM (SELECT DISTINCT entity, date FROM book)) FROM n
    UNION ALL SELECT 'rows_without_target', 0 UNION ALL SELECT 'missing_cells', n * {len(BOOK_COLUMNS)} - known FROM n UNION ALL SELECT 'empty_columns', 0""",
    lambda b: checks.quality_summary(b, ["entity", "date"], "target"),
    digits=None,
)
