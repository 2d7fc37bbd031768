"""Queries of a model review: metrics, diagnostics, credit tables, fits, explanations and tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import credit, diagnostics, explain, hypothesis_tests, metrics, models
from gritstone.plans.catalogue import BANDS, BOOK_SQL, LIFT, LINES_SQL, banded, book, fixed_score, lines, neat, r
from gritstone.sources import tables
from gritstone.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None, build: Callable[[DataFrame], DataFrame], digits: int | None = 6, source=book, base: str = BOOK_SQL) -> None:
    QUERIES[name] = lambda spark, sf: neat(build(source(spark, sf)), digits) if digits is not None else build(source(spark, sf))
    if sql is not None:
        SQL[name] = base + sql


def on_lines(name: str, sql: str | None, build, digits: int | None = 6) -> None:
    register(name, sql, build, digits, lines, LINES_SQL)


big = lambda x: f"CAST({x} AS BIGINT)"
PERFORMANCE = f"count(*) AS n, {r('avg(score)', 12)} AS mean_score, {r('avg(CAST(target AS DOUBLE))', 12)} AS observed_rate"

# metrics
CURVE = ", c AS (SELECT split, score, sum(target) AS pos, sum(1 - target) AS neg FROM book GROUP BY 1, 2), u AS (SELECT *, sum(pos) OVER w AS pu, sum(neg) OVER w AS nu, sum(pos) OVER (PARTITION BY split) AS pa, sum(neg) OVER (PARTITION BY split) AS na FROM c WINDOW w AS (PARTITION BY split ORDER BY score ROWS UNBOUNDED PRECEDING))"
register("rank_metrics", CURVE + f" SELECT split, {r('sum(pos * (nu - neg / 2)) / (any_value(pa) * any_value(na))')} AS auc, {r('max(abs(pu / pa - nu / na))')} AS ks, {r('sum(pos / pa * (pa - pu + pos) / (pa - pu + pos + na - nu + neg))')} AS average_precision FROM u GROUP BY split", lambda b: metrics.rank_metrics(b, "target", "score", ("split",)))
CELLS = "sum(CASE WHEN target = 1 AND {p} THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN target = 0 AND {p} THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN target = 0 AND NOT {p} THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN target = 1 AND NOT {p} THEN 1 ELSE 0 END) AS fn"
RATES = f"{big('tp')} AS tp, {big('fp')} AS fp, {big('tn')} AS tn, {big('fn')} AS fn, {r('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy, {r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS precision, {r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall, {r('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1, {r('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc"
AS_DOUBLES = "(SELECT {k} CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn FROM ({q}))"
register("confusion_rates", f" SELECT split, {RATES} FROM " + AS_DOUBLES.format(k="split,", q=f"SELECT split, {CELLS.format(p='score >= 0.5')} FROM book GROUP BY split"), lambda b: metrics.rates(b.groupBy("split").agg(*metrics.confusion(F.col("target"), (F.col("score") >= 0.5).cast("int")))))
register("threshold_sweep", f" SELECT threshold, {RATES} FROM " + AS_DOUBLES.format(k="threshold,", q=f"SELECT t / 20.0::DOUBLE AS threshold, {CELLS.format(p='score >= t / 20.0::DOUBLE')} FROM book, range(1, 20) g(t) GROUP BY t"), lambda b: metrics.threshold_sweep(b, "target", "score", [k / 20 for k in range(1, 20)]))
register("probability_losses", f" SELECT split, {r('avg((score - target) * (score - target))')} AS brier, {r('avg(-(target * ln(score) + (1 - target) * ln(1 - score)))')} AS log_loss FROM book GROUP BY split", lambda b: b.groupBy("split").agg(*metrics.probability_losses(F.col("target"), F.col("score"))))
on_lines("regression_metrics", f" SELECT segment, count(*) AS n, {r('sqrt(avg((lgd - predicted) ** 2))')} AS rmse, {r('avg(abs(lgd - predicted))')} AS mae, {r('1 - avg((lgd - predicted) ** 2) / var_pop(lgd)')} AS r2, {r('1 - var_pop(lgd - predicted) / var_pop(lgd)')} AS explained_variance FROM lines GROUP BY segment", lambda d: metrics.regression_metrics(d, "lgd", "predicted", ("segment",)))
on_lines("multiclass_metrics", ", p AS (SELECT segment, CASE WHEN quantity < 20 THEN 'A' WHEN quantity < 40 THEN 'N' ELSE 'R' END AS guess FROM lines), k AS (SELECT unnest(['A', 'N', 'R']) AS class), m AS (SELECT class, count(*) FILTER (WHERE segment = class) AS support, count(*) FILTER (WHERE guess = class) AS predicted, count(*) FILTER (WHERE guess = class AND segment = class) AS hit FROM p, k GROUP BY class)" + f" SELECT class, support, {r('hit / predicted')} AS precision, {r('hit / support')} AS recall, {r('2.0 * hit / (support + predicted)')} AS f1 FROM m", lambda d: metrics.multiclass_metrics(d.withColumn("guess", F.when(F.col("quantity") < 20, "A").when(F.col("quantity") < 40, "N").otherwise("R")), "segment", "guess"))
register("lift_table", LIFT + f", h AS (SELECT band, count(*) AS n, CAST(sum(target) AS BIGINT) AS events, avg(score) AS ms FROM banded GROUP BY band) SELECT band, n, events, {r('ms')} AS mean_score, {r('events / n')} AS rate, {r('events / sum(events) OVER ()')} AS capture, {r('sum(events) OVER (ORDER BY band ROWS UNBOUNDED PRECEDING) / sum(events) OVER ()')} AS cumulative_capture, {r('events / n / (sum(events) OVER () / sum(n) OVER ())')} AS lift FROM h", lambda b: metrics.lift_table(banded(b, descending=True), "target", "score"))
CALIBRATION = BANDS + ", h AS (SELECT band, count(*) AS n, avg(score) AS e, avg(CAST(target AS DOUBLE)) AS o FROM banded GROUP BY band)"
register("calibration_table", CALIBRATION + f" SELECT band, n, {r('e')} AS expected, {r('o')} AS observed, {r('o - e')} AS gap FROM h", lambda b: metrics.calibration_table(banded(b), "target", "score"))
register("calibration_summary", CALIBRATION + f" SELECT {r('sum(n * abs(o - e)) / sum(n)')} AS ece, {r('max(abs(o - e))')} AS mce, {r('sum(n * (o - e) * (o - e) / (e * (1 - e)))', 4)} AS hl, count(*) AS bands FROM h", lambda b: metrics.calibration_summary(metrics.calibration_table(banded(b), "target", "score")).select(rounded("ece").alias("ece"), rounded("mce").alias("mce"), rounded("hl", 4).alias("hl"), "bands"), None)

# credit tables
register("segment_performance", f" SELECT split, segment, {PERFORMANCE} FROM book GROUP BY 1, 2", lambda b: credit.group_performance(b, ["split", "segment"], "target", "score"), 12)
register("vintage", f" SELECT split, strftime(date, '%Y-%m') AS vintage, {PERFORMANCE} FROM book GROUP BY 1, 2", lambda b: credit.vintage(b, "date", "target", "score"), 12)
register("cohort", f" SELECT split, cohort, {PERFORMANCE} FROM (SELECT *, strftime(min(date) OVER (PARTITION BY entity), '%Y-%m') AS cohort FROM book) GROUP BY 1, 2", lambda b: credit.cohort(b, "entity", "date", "target", "score"), 12)
MOVES = ", l AS (SELECT split, state AS from_state, lead(state) OVER (PARTITION BY split, entity ORDER BY date, id) AS to_state FROM book), g AS (SELECT split, from_state, to_state, count(*) AS n FROM l WHERE to_state IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, n / sum(n) OVER (PARTITION BY split, from_state) AS rate FROM g)"
register("migration_matrix", MOVES + f" SELECT split, from_state, to_state, n, {r('rate')} AS rate FROM m", lambda b: credit.migration(b, "entity", ["date", "id"], "state"))
register("roll_rates", MOVES + f" SELECT split, CASE WHEN left(to_state, 1) > left(from_state, 1) THEN 'improving' WHEN left(to_state, 1) < left(from_state, 1) THEN 'worsening' ELSE 'stable' END AS direction, {big('sum(n)')} AS n, {r('sum(rate)')} AS rate FROM m GROUP BY 1, 2", lambda b: credit.roll_rates(credit.migration(b, "entity", ["date", "id"], "state")))
register("lifetime_curve", f", p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, id) AS period FROM book), h AS (SELECT period, count(*) AS n, avg(score) AS hz, avg(CAST(target AS DOUBLE)) AS o FROM p GROUP BY period), s AS (SELECT *, product(1 - hz) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS sv FROM h) SELECT CAST(period AS INTEGER) AS period, n, {r('hz')} AS hazard, {r('o')} AS observed, {r('sv')} AS survival, {r('1 - sv')} AS cumulative_pd FROM s", lambda b: credit.lifetime_curve(b.withColumn("period", credit.period_index("entity", ["date", "id"])), "period", "target", "score"))
on_lines("severity_by_segment", f" SELECT segment, count(*) AS n, {r('avg(lgd)')} AS lgd, {r('avg(predicted)')} AS predicted_lgd, {r('1 - avg(lgd)')} AS recovery FROM lines GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 10", lambda d: credit.severity_by_segment(d, "segment", "lgd", "predicted"))

# diagnostics
described = lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS p25, {r(f'quantile_cont({c}, 0.5)', 4)} AS p50, {r(f'quantile_cont({c}, 0.75)', 4)} AS p75, {r(f'max({c})', 4)} AS max FROM book"
register("describe", " " + " UNION ALL ".join(map(described, ("sparse", "balance", "score"))), lambda b: diagnostics.describe(b, ["sparse", "balance", "score"]), 4)
moment = lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_pop({c})', 4)} AS std, {r(f'skewness({c})', 4)} AS skewness, {r(f'kurtosis({c})', 4)} AS kurtosis FROM book"
register("moments", " " + " UNION ALL ".join(map(moment, ("sparse", "score"))), lambda b: diagnostics.moments(b, ["sparse", "score"]), 4)
missing = lambda c: f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, {r(f'avg(CASE WHEN {c} IS NULL THEN CAST(target AS DOUBLE) END)')} AS rate_missing, {r(f'avg(CASE WHEN {c} IS NOT NULL THEN CAST(target AS DOUBLE) END)')} AS rate_present, {r(f'(count(*) - count({c})) / count(*)')} AS share FROM book"
register("missingness_target", " " + " UNION ALL ".join(map(missing, ("sparse", "sparse_segment"))), lambda b: diagnostics.missingness(b, ["sparse", "sparse_segment"], "target"))
register("correlations", " " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{c}' AS \"right\", {r(f'corr({a}, {c})')} AS r FROM book" for a, c in (("sparse", "balance"), ("sparse", "target"), ("balance", "target"))), lambda b: diagnostics.correlations(b, ["sparse", "balance", "target"]))
register("vif", f", c AS (SELECT corr(amount, balance) AS r FROM book) SELECT unnest(['amount', 'balance']) AS \"column\", {r('1 / (1 - r * r)')} AS vif FROM c", lambda b: diagnostics.vif(b, ["amount", "balance"]))
register("dependency", None, lambda b: diagnostics.dependency(b, ["amount", "balance", "score", "challenger"]))
register("outliers", f", t AS (SELECT avg(balance) AS m, stddev_pop(balance) AS s FROM book) SELECT id, balance, {r('(balance - m) / s')} AS z FROM book, t WHERE abs((balance - m) / s) >= 1.6", lambda b: diagnostics.outliers(b, "id", "balance", 1.6))
register("duplicate_keys", f" SELECT count(*) AS keys, {big('sum(n - 1)')} AS duplicates, max(n) AS largest FROM (SELECT count(*) AS n FROM book GROUP BY entity, date)", lambda b: diagnostics.duplicate_keys(b, ["entity", "date"]), None)
register("date_gaps", " SELECT entity, count(*) AS n, CAST(max(g) AS INTEGER) AS max_gap FROM (SELECT entity, date_diff('day', CAST(lag(date) OVER (PARTITION BY entity ORDER BY date, id) AS DATE), CAST(date AS DATE)) AS g FROM book) GROUP BY entity", lambda b: diagnostics.gaps(b, "entity", "date", "id"), None)
register("suitability", f" SELECT count(*) AS n, {big('sum(target)')} AS events, {r('sum(target) / count(*)')} AS rate, {r('sum(target) / 4')} AS events_per_feature FROM book", lambda b: diagnostics.suitability(b, "target", 4))
register("cardinality", " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS \"distinct\", count(DISTINCT {c}) > 500 AND count(DISTINCT {c}) / count(*) > 0.2 AS too_many FROM book" for c in ("segment", "id")), lambda b: diagnostics.cardinality(b, ["segment", "id"]), None)
register("screening", " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing, {r(f'var_samp({c})', 2)} AS variance, {r(f'abs(corr({c}, CAST(target AS DOUBLE)))')} AS relation, 'keep' AS status FROM book" for c in ("sparse", "balance")), lambda b: diagnostics.screening(b, ["sparse", "balance"], "target").select("column", rounded("missing").alias("missing"), rounded("variance", 2).alias("variance"), rounded("relation").alias("relation"), "status"), None)
register("fingerprint", None, lambda b: tables.fingerprint(b).select("rows", F.col("checksum").cast("string").alias("checksum")), None)

# models
on_lines("least_squares", f" SELECT unnest(['intercept', 'quantity']) AS name, unnest([{r('regr_intercept(lgd, quantity)')}, {r('regr_slope(lgd, quantity)', 8)}]) AS coefficient FROM lines", lambda d: models.ordinary_least_squares(d, ["quantity"], "lgd").table(d).select("name", F.when(F.col("name") == "intercept", rounded("coefficient")).otherwise(rounded("coefficient", 8)).alias("coefficient")), None)
register("segment_fits", f" SELECT segment, count(*) AS n, {r('regr_intercept(balance, amount)', 3)} AS intercept, {r('regr_slope(balance, amount)', 9)} AS slope FROM book GROUP BY segment HAVING count(*) >= 30", lambda b: models.fit_by_segment(b, ["amount"], "balance", "segment").select("segment", "n", rounded("intercept", 3).alias("intercept"), rounded("slope", 9).alias("slope")), None)
register("logistic_fit", None, lambda b: models.iteratively_reweighted(b.where("split = 'train'").withColumn("amount", F.col("amount") / 1e5).withColumn("balance", F.col("balance") / 1e4), ["amount", "balance"], "target").table(b))
on_lines("fractional_fit", None, lambda d: models.iteratively_reweighted(d, ["quantity"], "lgd").table(d))
on_lines("poisson_fit", None, lambda d: models.iteratively_reweighted(d.withColumn("count", F.floor("lgd")), ["quantity"], "count", "poisson").table(d))
on_lines("quantile_fit", None, lambda d: models.quantile_regression(d, ["quantity"], "lgd", 0.75).table(d).select("name", "coefficient"))


def _scorecard(b: DataFrame) -> DataFrame:
    held = b.withColumn("x1", F.col("amount") / 1e5).withColumn("x2", F.col("balance") / 1e4)
    model, card = models.iteratively_reweighted(held.where("split = 'train'"), ["x1", "x2"], "target"), models.Scorecard()
    return held.select("id", card.score(model).alias("points"), F.array_join(card.reasons(model, 1), ",").alias("reason"))


def _tree(b: DataFrame) -> DataFrame:
    model = models.tree_model(b.where("split = 'train'"), ["amount", "balance"], "target", "decision_tree", maxDepth=3)
    return model.transform(b).groupBy("split", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


register("scorecard_points", None, _scorecard)
register("decision_tree", None, _tree, None)

# explanations
COLUMNS = ["amount", "balance"]
SCORE = "1 / (1 + exp(-(-0.5 + {a} / 4e5 - {b} / 2e4)))"
register("partial_dependence", f" SELECT segment, g AS value, {r('avg(' + SCORE.format(a='g', b='balance') + ')')} AS mean_score FROM book, (SELECT unnest([5e4, 1e5, 2e5, 4e5]) AS g) GROUP BY 1, 2", lambda b: explain.partial_dependence(b, COLUMNS, "amount", [5e4, 1e5, 2e5, 4e5], fixed_score, ("segment",)))
register("individual_curves_every_row", f" SELECT id, g AS value, {r(SCORE.format(a='g', b='balance'))} AS score, {r(SCORE.format(a='g', b='balance') + ' - ' + SCORE.format(a='5e4', b='balance'))} AS centred FROM book, (SELECT unnest([5e4, 2e5]) AS g)", lambda b: explain.individual_curves(b, COLUMNS, "id", "amount", [5e4, 2e5], fixed_score))
register("two_way_dependence", f" SELECT x AS a, y AS b, {r('avg(' + SCORE.format(a='x', b='y') + ')')} AS mean_score FROM book, (SELECT unnest([1e5, 3e5]) AS x), (SELECT unnest([0.0::DOUBLE, 5e3]) AS y) GROUP BY 1, 2", lambda b: explain.two_way(b, COLUMNS, "amount", "balance", [1e5, 3e5], [0.0, 5e3], fixed_score))
register("marginal_effect", f" SELECT {r('avg((' + SCORE.format(a='(amount + 1000)', b='balance') + ' - ' + SCORE.format(a='(amount - 1000)', b='balance') + ') / 2000)', 12)} AS effect, count(amount) AS n FROM book", lambda b: explain.marginal_effect(b, COLUMNS, "amount", 1000.0, fixed_score), 12)
register("scenario", f" SELECT segment, count(*) AS n, {r('avg(' + SCORE.format(a='amount', b='balance') + ')')} AS base, {r('avg(' + SCORE.format(a='(amount * 1.2::DOUBLE)', b='(balance - 500)') + ')')} AS shocked, {r('avg(' + SCORE.format(a='(amount * 1.2::DOUBLE)', b='(balance - 500)') + ' - ' + SCORE.format(a='amount', b='balance') + ')')} AS change FROM book GROUP BY segment", lambda b: explain.scenario(b, COLUMNS, {"amount": ("multiply", 1.2), "balance": ("add", -500.0)}, fixed_score, ("segment",)))

# tests
MONTHS = ", m AS (SELECT strftime(date, '%Y-%m') AS month, avg(CAST(target AS DOUBLE)) - avg(score) AS e FROM book GROUP BY 1)"
monthly = lambda b: b.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg((F.avg(F.col("target").cast("double")) - F.avg("score")).alias("e"))
register("durbin_watson", MONTHS + f" SELECT {r('sum(d * d) / sum(e * e)')} AS durbin_watson, count(*) AS n FROM (SELECT e, e - lag(e) OVER (ORDER BY month) AS d FROM m)", lambda b: hypothesis_tests.durbin_watson(monthly(b), "month", "e"))

# events
QUERIES["windowed_events"] = lambda spark, sf: neat(scoring.windowed(spark.read.parquet(f"{sf}/events.parquet"), "ts", "event_type", "value"))
SQL["windowed_events"] = f"SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, {r('avg(value)')} AS mean FROM events GROUP BY 1, 2"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
