"""Queries of kept models, files, candidate tables and a user's own functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import candidates, hypothesis_tests, models, robustness, scorecard, scoring, splits
from gritstone.operators.models import Linear
from gritstone.plans import evidence, frameworks
from gritstone.plans.catalogue import book, neat, r
from gritstone.plans.families import scaled
from gritstone.plans.registry import Registry
from gritstone.sources import tables
from gritstone.sources.scratch import scratch_path

REGISTRY = Registry()
add = REGISTRY.add

MODEL = Linear(["amount", "balance"], np.array([-0.5, 2.5e-6, -5e-5]), None, "logit")
P = "1 / (1 + exp(-(-0.5 + amount * 2.5e-6 + balance * -5e-5)))"


def existing(b: DataFrame) -> DataFrame:
    """A model saved, loaded and applied to every split."""
    spark, path = b.sparkSession, scratch_path(b.sparkSession, "model")
    scoring.kept(MODEL, b, 0.4).save(spark, path)
    held = scoring.Kept.load(spark, path)
    return scoring.score_binary(b, held, "target").select("id", "split", "probability", "predicted_class", "residual")


add(
    "score_existing_model",
    f" SELECT id, split, {r(P)} AS probability, ({P} >= 0.4)::INTEGER AS predicted_class, {r(f'target - {P}')} AS residual FROM book",
    existing,
)


def whole_file(b: DataFrame) -> DataFrame:
    """Cleaning, a filled gap, a derived feature and the score as one replay; then compact columns of 500 rows, written and read."""
    steps = [
        ("clean", lambda t: t.where(F.col("balance").isNotNull())),
        ("fill", lambda t: t.withColumn("sparse", F.coalesce("sparse", F.lit(150000.0)))),
        ("derive", lambda t: t.withColumn("amount", F.col("sparse"))),
        ("score", lambda t: scoring.score_binary(t, scoring.kept(MODEL, t))),
    ]
    scored = scoring.replayed(b, steps)
    path = scratch_path(b.sparkSession, "predictions")
    tables.export(scoring.compact(scored, ["id"], ["split", "probability"], 500), path, "parquet", ("split",))
    return b.sparkSession.read.parquet(path).select("id", F.col("split").cast("string").alias("split"), "probability")


add(
    "prediction_export",
    f"""
    , s AS (SELECT id, split, {P.replace('amount', 'coalesce(sparse, 150000.0::DOUBLE)')} AS p FROM book WHERE balance IS NOT NULL)
    SELECT id, split, {r('p')} AS probability FROM s ORDER BY ('0x' || sha256('42:' || id)[1:13])::BIGINT, id LIMIT 500""",
    whole_file,
)

add(
    "table_facts",
    " SELECT position::INTEGER AS position, name AS \"column\", (SELECT count(*) FROM book) AS rows FROM (SELECT unnest(['id', 'segment', 'amount']) AS name, unnest([1, 2, 3]) AS position)",
    lambda b: tables.table_facts(tables.projected(b, ["id", "segment", "amount"], scratch_path(b.sparkSession, "projected"))).select("position", "column", "rows"),
    digits=None,
)

add(
    "portable_fingerprint",
    " SELECT count(*) AS rows, sum(('0x' || sha256(concat_ws(':', id, coalesce(sparse_segment, 'null'), target))[1:13])::HUGEINT)::VARCHAR AS checksum FROM book",
    lambda b: tables.portable_fingerprint(b, ["id", "sparse_segment", "target"]),
    digits=None,
)


def odds(b: DataFrame) -> DataFrame:
    """The fit's table agrees with itself: odds ratios and the order by size."""
    held = scaled(b, "target")
    out = scoring.importance_table(held, models.iteratively_reweighted(held, ["amount", "balance"], "target"))
    return out.select("feature", (F.abs(F.log("odds_ratio") - F.col("coefficient")) < 1e-9).alias("odds_agree"), (F.abs("coefficient") == F.col("importance")).alias("size_agrees"), (F.col("p_value").between(0, 1)).alias("p_in_range"))


add("importance_table", " SELECT unnest(['amount', 'balance']) AS feature, TRUE AS odds_agree, TRUE AS size_agrees, TRUE AS p_in_range", odds, digits=None)

# candidates
PAIR = "(corr(target, {a}) ** 2 + corr(target, {b}) ** 2 - 2 * corr(target, {a}) * corr(target, {b}) * corr({a}, {b})) / (1 - corr({a}, {b}) ** 2)"
NAMES = ["amount", "balance", "challenger"]
SUBSETS = [((a,), f"corr(target, {a}) ** 2") for a in NAMES] + [((a, b), PAIR.format(a=a, b=b)) for k, a in enumerate(NAMES) for b in NAMES[k + 1 :]]
SEARCH = f"""
    , s AS (SELECT target, amount / 1e5 AS amount, balance / 1e4 AS balance, challenger FROM book),
      c AS ({' UNION ALL '.join(f"SELECT '{','.join(names)}' AS subset, {len(names)} AS size, count(*) AS n, {q} AS r2, regr_syy(target, amount) AS syy FROM s" for names, q in SUBSETS)}),
      v AS (SELECT subset, size::INTEGER AS size, n, r2, n * ln(syy * (1 - r2) / n) + ln(n) * (size + 1) AS bic FROM c),
      k AS (SELECT *, row_number() OVER (ORDER BY bic, subset) AS rank FROM v)"""


def searched(b: DataFrame) -> DataFrame:
    return robustness.subset_search(scaled(b, "target", "challenger"), NAMES, "target", range(1, 3))


add("subset_frontier", SEARCH + f" SELECT subset, size, {r('r2', 8)} AS r2, {r('bic', 4)} AS bic FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY bic, subset) AS p FROM k) WHERE p = 1",
    lambda b: candidates.frontier(searched(b)).select("subset", "size", rounded("r2", 8).alias("r2"), rounded("bic", 4).alias("bic")), digits=None)

add("subset_frequency", SEARCH + f" SELECT feature, count(*) AS selected, {r('count(*) / 4.0')} AS share FROM (SELECT unnest(string_split(subset, ',')) AS feature FROM k WHERE rank <= 4) GROUP BY feature",
    lambda b: candidates.feature_frequency(searched(b), 4))

add(
    "subset_redundancy",
    SEARCH
    + f""", p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT corr({a}, {b}) FROM s) AS r" for k, a in enumerate(NAMES) for b in NAMES[k + 1 :])})
    SELECT a AS "left", b AS "right", {r('r')} AS r, count(*)::INTEGER AS together, CASE WHEN abs(r) >= 0.85 THEN 'high' ELSE 'moderate' END AS risk
    FROM p JOIN k ON rank <= 6 AND list_contains(string_split(subset, ','), a) AND list_contains(string_split(subset, ','), b) WHERE abs(r) >= 0.7 GROUP BY a, b, r""",
    lambda b: candidates.redundancy(scaled(b, "target", "challenger"), searched(b), NAMES, 6),
)

add(
    "fold_consistency",
    f"""
    , f AS (SELECT ((id * 7919) % 1000003) % 5 AS fold, target, amount / 1e5 AS x FROM book),
      c AS (SELECT k, regr_slope(target, x) AS b, regr_intercept(target, x) AS a FROM f, (SELECT unnest(range(0, 5)) AS k) WHERE fold <> k GROUP BY k),
      t AS (SELECT 'amount' AS term, b FROM c UNION ALL SELECT 'intercept', a FROM c)
    SELECT term, count(*) AS folds, {r('avg(b)')} AS mean, {r('stddev_samp(b)')} AS std, {r('avg(abs(b))')} AS mean_absolute,
           {r('greatest(count(*) FILTER (WHERE b > 0), count(*) FILTER (WHERE b < 0)) / count(*) FILTER (WHERE b <> 0)')} AS sign_share FROM t GROUP BY term""",
    lambda b: candidates.consistency(candidates.fold_fits(scaled(b, "target").withColumn("fold", splits.fold("id", 5)), ["amount"], "target", "fold")),
)

EVENTS = "sum(target)::DOUBLE / count(*)"


def stable(b: DataFrame) -> DataFrame:
    rate = F.avg(F.col("target").cast("double"))
    base = b.groupBy("segment").agg(rate.alias("rate"))
    flags = b.groupBy("segment", "split").agg(rate.alias("rate"), F.count("*").alias("n"))
    risks = flags.where("rate < 0.32").select("segment", F.concat(F.lit("low_"), "split").alias("risk")).unionByName(flags.where("n < 200").select("segment", F.concat(F.lit("few_"), "split").alias("risk")))
    return candidates.with_risk_counts(candidates.candidate_stability(base, flags, "segment", "rate"), risks, "segment")


add(
    "candidate_stability",
    f"""
    , g AS (SELECT segment, split, {EVENTS} AS rate, count(*) AS n FROM book GROUP BY 1, 2), b AS (SELECT segment, {EVENTS} AS rate FROM book GROUP BY 1),
      k AS (SELECT segment, 'low_' || split AS risk FROM g WHERE rate < 0.32 UNION ALL SELECT segment, 'few_' || split FROM g WHERE n < 200),
      j AS (SELECT segment, count(*) AS risks, array_to_string(list_sort(list(DISTINCT risk)), ',') AS names FROM k GROUP BY segment)
    SELECT b.segment, {r('any_value(b.rate)')} AS rate, count(*) AS groups, {r('min(g.rate)')} AS least, {r('max(g.rate)')} AS greatest, {r('stddev_pop(g.rate)')} AS spread,
           coalesce(any_value(risks), 0) AS risks, coalesce(any_value(names), '') AS risk_names
    FROM b JOIN g USING (segment) LEFT JOIN j USING (segment) GROUP BY b.segment""",
    stable,
)

CARD = {"sparse": [1e5, 2.5e5], "sparse_segment": None}


def workbench(b: DataFrame) -> DataFrame:
    return candidates.scorecard_summary(neat(scorecard.evidence(b.where("split = 'train'"), CARD, "target")), CARD)


REGISTRY.queries["scorecard_workbench"] = lambda spark, sf: _neat(workbench(book(spark, sf)))
REGISTRY.sql["scorecard_workbench"] = f"""
    WITH e AS ({frameworks.REGISTRY.sql["scorecard_bins"]}),
         s AS (SELECT *, CASE WHEN feature = 'sparse' THEN TRY_CAST(bucket AS INTEGER) END AS place FROM e),
         d AS (SELECT *, CASE WHEN place IS NOT NULL AND lag(place) OVER w IS NOT NULL THEN woe - lag(woe) OVER w END AS step FROM s WINDOW w AS (PARTITION BY feature ORDER BY place NULLS FIRST, bucket))
    SELECT feature, count(*) AS bins, {r('sum(iv)', 4)} AS iv, {r('max(total) / sum(total)', 4)} AS largest_share, {r('max(woe) - min(woe)', 4)} AS woe_span,
           CASE WHEN count(step) = 0 THEN 'none' WHEN count(*) FILTER (WHERE step < 0) = 0 THEN 'increasing' WHEN count(*) FILTER (WHERE step > 0) = 0 THEN 'decreasing' ELSE 'mixed' END AS trend
    FROM d GROUP BY feature"""


def _neat(df: DataFrame) -> DataFrame:
    return df.select("feature", "bins", *(rounded(c, 4).alias(c) for c in ("iv", "largest_share", "woe_span")), "trend")


def compared(b: DataFrame) -> DataFrame:
    """Both tests of the score against its challenger in one table."""
    first, second = ((F.col(c) >= 0.5) == (F.col("target") == 1) for c in ("score", "challenger"))
    m = hypothesis_tests.mcnemar(b, first, second).select(F.lit("mcnemar").alias("test"), rounded("statistic", 4).alias("statistic"), rounded("p_value", 4).alias("p_value"))
    d = hypothesis_tests.delong(b, "target", "score", "challenger").select(F.lit("delong").alias("test"), rounded("z", 4).alias("statistic"), rounded("p_value", 4).alias("p_value"))
    return m.unionByName(d)


REGISTRY.queries["model_comparison_tests"] = lambda spark, sf: compared(book(spark, sf))
REGISTRY.sql["model_comparison_tests"] = f"""
    SELECT 'mcnemar' AS test, {r('statistic', 4)} AS statistic, {r('p_value', 4)} AS p_value FROM ({evidence.REGISTRY.sql['mcnemar']})
    UNION ALL SELECT 'delong', z, {r('p_value', 4)} FROM ({evidence.REGISTRY.sql['delong']})"""

# a user's own functions
add(
    "user_row_function",
    f" SELECT id, {r('amount / 1e5 + balance / 1e4')} AS mixed FROM book",
    lambda b: scoring.with_row_function(b, "mixed", _mixed, ["amount", "balance"], "double").select("id", "mixed"),
)


def _mixed(amount, balance):
    return amount / 1e5 + balance / 1e4


add(
    "user_group_function",
    f" SELECT entity, {r('max(amount) - min(amount)', 2)} AS reach FROM book GROUP BY entity",
    lambda b: scoring.with_group_function(b, ["entity"], {"reach": (lambda x: float(x.max() - x.min()), ["amount"], "double")}),
    digits=2,
)
