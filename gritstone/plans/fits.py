"""Queries of likelihood fits, calibrations, filters and file reading, held to their equations as in `families`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import category, normal_cdf, rounded
from gritstone.operators import binning, diagnostics, frameworks, likelihoods, models, robustness
from gritstone.plans.catalogue import LINES_SQL, lines, r
from gritstone.plans.families import SCALED, SCALED_SQL, long, scaled
from gritstone.plans.registry import Registry
from gritstone.sources import tables
from gritstone.sources.scratch import scratch_path

REGISTRY = Registry()
add = REGISTRY.add

NAMES = ["intercept", *SCALED]
ZEROS = "SELECT unnest([{}]) AS equation, 0.0::DOUBLE AS value"


def zeros(*names: str) -> str:
    return ZEROS.format(", ".join(f"'{n}'" for n in names))


def moments(held: DataFrame, of: Column, features: list[str] | None = None) -> DataFrame:
    """The mean of `of`, alone and times each feature."""
    held = held.withColumn("of", of)  # once a row
    return long(held, {("intercept",): F.avg("of")} | {(c,): F.avg(F.col(c) * F.col("of")) for c in features or SCALED}, "equation string")


def moments_sql(of: str, features: tuple[str, ...] = tuple(SCALED), source: str = "s") -> str:
    return " UNION ALL ".join([f"SELECT 'intercept' AS equation, {r(f'avg({of})')} AS value FROM {source}", *(f"SELECT '{c}', {r(f'avg({c} * ({of}))')} FROM {source}" for c in features)])


TRAIN = f", s AS (SELECT target::DOUBLE AS target, score, {SCALED_SQL} FROM book WHERE split = 'train') "


def train(b: DataFrame) -> DataFrame:
    return scaled(b.where("split = 'train'"), "target", "score")


# generalised linear models: fitted means have the target's moments under a canonical link
def logistic(b: DataFrame) -> DataFrame:
    held = train(b)
    return moments(held, models.iteratively_reweighted(held, list(SCALED), "target").predict())


add("logistic_moments", TRAIN + moments_sql("target"), logistic, digits=None)


def probit(b: DataFrame) -> DataFrame:
    held = train(b)
    model = models.iteratively_reweighted(held, list(SCALED), "target", "probit")
    held = held.withColumn("eta", model.linear()).withColumn("p", model.mean(F.col("eta")))
    eta, p = F.col("eta"), F.col("p")
    return moments(held, (F.col("target") - p) * F.exp(-eta * eta / 2) / (p * (1 - p)))


add("probit_regression", zeros(*NAMES), probit, digits=None)


def tweedie(b: DataFrame) -> DataFrame:
    held = scaled(b, "target").withColumn("loss", F.col("target") * F.col("amount"))
    model = models.iteratively_reweighted(held, ["balance"], "loss", "tweedie", power=1.5)
    mu = model.predict()
    return moments(held, (F.col("loss") - mu) / F.sqrt(mu), ["balance"])


add("tweedie_regression", zeros("intercept", "balance"), tweedie, digits=None)


def counted(family: str):
    def fit(d: DataFrame) -> DataFrame:
        held = d.select((F.col("quantity") / 50).alias("quantity"), F.floor("lgd").cast("double").alias("n"))
        model = models.iteratively_reweighted(held, ["quantity"], "n", family, dispersion=0.5)
        mu = model.predict()
        return moments(held, mu if family == "poisson" else (F.col("n") - mu) / (1 + 0.5 * mu), ["quantity"])

    return fit


COUNTED = ", s AS (SELECT quantity / 50.0::DOUBLE AS quantity, floor(lgd) AS n FROM lines) "
add("poisson_moments", COUNTED + moments_sql("n", ("quantity",)), counted("poisson"), digits=None, source=lines, base=LINES_SQL)
add("negative_binomial_regression", zeros("intercept", "quantity"), counted("negative_binomial"), digits=None, source=lines, base=LINES_SQL)


def gamma(b: DataFrame) -> DataFrame:
    held = scaled(b)
    mu = models.iteratively_reweighted(held, ["balance"], "amount", "gamma").predict()
    return moments(held, F.col("amount") / mu - 1, ["balance"])


add("gamma_regression", zeros("intercept", "balance"), gamma, digits=None)


def hazard(b: DataFrame) -> DataFrame:
    model, held = likelihoods.discrete_hazard(scaled(b, "target", "entity", "date"), ["amount"], "target", "entity", ["date", "id"])
    return moments(held, model.predict(), ["amount", "period", "period_squared"])


add(
    "discrete_time_hazard",
    f"""
    , p AS (SELECT target::DOUBLE AS target, {SCALED_SQL}, row_number() OVER (PARTITION BY entity ORDER BY date, id)::DOUBLE AS period FROM book),
      s AS (SELECT *, period * period AS period_squared FROM p) """
    + moments_sql("target", ("amount", "period", "period_squared")),
    hazard,
    digits=None,
)

# likelihoods
LEVELS = 3


def ordered(b: DataFrame) -> DataFrame:
    """The gradient by cut and feature, from the chances of a row's own level and of its neighbours."""
    held = scaled(b, "state").withColumn("level", F.when(F.col("state") < "2", 0.0).when(F.col("state") < "4", 1.0).otherwise(2.0))
    fit = likelihoods.ordered_logit(held, list(SCALED), "level", LEVELS)
    eta = sum((F.col(c) * fit[c] for c in SCALED), F.lit(0.0))
    upto = [F.lit(0.0), *(1 / (1 + F.exp(-(fit[f"cut_{j}"] - eta))) for j in range(LEVELS - 1)), F.lit(1.0)]
    steep = [p * (1 - p) for p in upto]
    pick = lambda values: F.coalesce(*(F.when(F.col("level") == j, v) for j, v in enumerate(values)))
    chance = pick([upto[j + 1] - upto[j] for j in range(LEVELS)])
    cells = {}
    for j in range(LEVELS - 1):
        cells[f"cut_{j}",] = F.avg(F.when(F.col("level") == j, steep[j + 1]).when(F.col("level") == j + 1, -steep[j + 1]).otherwise(0.0) / chance)
    slope = pick([steep[j] - steep[j + 1] for j in range(LEVELS)]) / chance
    cells |= {(c,): F.avg(F.col(c) * slope) for c in SCALED}
    return long(held, cells, "equation string")


add("ordered_logit", zeros("cut_0", "cut_1", *SCALED), ordered, digits=None)


def tobit(b: DataFrame) -> DataFrame:
    held = scaled(b).withColumn("y", F.greatest(F.col("amount") - 1, F.lit(0.0)))
    fit = likelihoods.tobit(held, ["balance"], "y")
    sigma = math.exp(fit["log_sigma"])
    eta = fit["intercept"] + fit["balance"] * F.col("balance")
    z, at = (F.col("y") - eta) / sigma, -eta / sigma
    mills = F.exp(-at * at / 2) / math.sqrt(2 * math.pi) / normal_cdf(at)
    slope, spread = F.when(F.col("y") <= 0, -mills / sigma).otherwise(z / sigma), F.when(F.col("y") <= 0, -mills * at).otherwise(z * z - 1)
    return moments(held, slope, ["balance"]).unionByName(long(held, {("log_sigma",): F.avg(spread)}, "equation string"))


add("tobit_regression", zeros("intercept", "balance", "log_sigma"), tobit, digits=None)


def hazards(d: DataFrame) -> DataFrame:
    """The partial likelihood's score: events' values less the means of their risk sets."""
    held = d.select("quantity", "lgd", (F.col("status") == "F").cast("double").alias("event"))
    b = likelihoods.cox(held, ["lgd"], "quantity", "event")["lgd"]
    risk = F.exp(F.col("lgd") * b)
    by = held.groupBy("quantity").agg(F.sum(risk).alias("s"), F.sum(risk * F.col("lgd")).alias("sx"), F.sum("event").alias("d"), F.sum(F.col("event") * F.col("lgd")).alias("dx"))
    later = Window.orderBy(F.desc("quantity")).rowsBetween(Window.unboundedPreceding, 0)  # a row per duration
    sets = by.select("d", "dx", F.sum("s").over(later).alias("s"), F.sum("sx").over(later).alias("sx"))
    return long(sets, {("lgd",): F.sum(F.col("dx") - F.col("d") * F.col("sx") / F.col("s")) / F.sum("d"), ("events",): F.sum("d")}, "equation string")


add(
    "cox_proportional_hazards",
    " SELECT 'lgd' AS equation, 0.0::DOUBLE AS value UNION ALL SELECT 'events', count(*)::DOUBLE FROM lines WHERE status = 'F'",
    hazards,
    digits=None,
    source=lines,
    base=LINES_SQL,
)


def two_stage(b: DataFrame) -> DataFrame:
    """Moments of the fitted chance of a loss over all rows, and of the fitted size over the rows with one."""
    held = scaled(b, "target", "score").withColumn("loss", F.col("target") * F.col("score"))
    model = likelihoods.two_stage_loss(held, list(SCALED), "loss")
    lost = held.where("loss > 0")
    parts = (held, "incidence", model.incidence.predict()), (lost, "severity", model.severity.predict())
    out = [moments(t, p).select(F.lit(n).alias("stage"), "equation", "value") for t, n, p in parts]
    return out[0].unionByName(out[1])


add(
    "two_stage_loss",
    f"""
    , s AS (SELECT target * score AS loss, {SCALED_SQL} FROM book), t AS (SELECT * FROM s WHERE loss > 0)
    SELECT 'incidence' AS stage, * FROM ({moments_sql('CASE WHEN loss > 0 THEN 1.0 ELSE 0.0 END')}) UNION ALL SELECT 'severity', * FROM ({moments_sql('loss', source='t')})""",
    two_stage,
    digits=None,
)


def severities(d: DataFrame) -> DataFrame:
    return d.select((F.col("quantity") / 50).alias("quantity"), "lgd")


def beta(d: DataFrame) -> DataFrame:
    held = severities(d).where("lgd > 0 AND lgd < 1")
    return likelihoods.beta_regression(held, ["quantity"], "lgd").table(held)


def inflated(d: DataFrame) -> DataFrame:
    """The chances of either end by their moments: of zero over all rows, of one over the others."""
    held = severities(d)
    model = likelihoods.zero_one_inflated_beta(held, ["quantity"], "lgd")
    parts = (held, "zero", model.zero.predict()), (held.where("lgd > 0"), "one", model.one.predict())
    out = [moments(t, p, ["quantity"]).select(F.lit(n).alias("stage"), "equation", rounded("value", 5).alias("value")) for t, n, p in parts]
    return out[0].unionByName(out[1])


add("beta_regression", None, beta, source=lines)
add(
    "zero_one_inflated_beta",
    f"""
    , s AS (SELECT quantity / 50.0::DOUBLE AS quantity, lgd FROM lines), t AS (SELECT * FROM s WHERE lgd > 0),
      e AS (SELECT 'zero' AS stage, * FROM ({moments_sql('CASE WHEN lgd <= 0 THEN 1.0 ELSE 0.0 END', ('quantity',))})
            UNION ALL SELECT 'one', * FROM ({moments_sql('CASE WHEN lgd >= 1 THEN 1.0 ELSE 0.0 END', ('quantity',), 't')}))
    SELECT stage, equation, {r('value', 5)} AS value FROM e""",
    inflated,
    digits=None,
    source=lines,
    base=LINES_SQL,
)

PENALTY = 0.002


def lasso(b: DataFrame) -> DataFrame:
    """How far each slope is from its optimality condition, and the mean residual."""
    held = scaled(b, "target", "score")
    names = [*SCALED, "score"]
    model = robustness.elastic_net(held, names, "target", PENALTY)
    rest = F.col("target") - model.linear()
    row = held.agg(F.avg(rest).alias("intercept"), *(F.avg(F.col(c) * rest).alias(c) for c in names)).first()
    gap = {"intercept": abs(row["intercept"])}
    for c, v in zip(names, model.coefficients[1:], strict=True):
        gap[c] = abs(row[c] - math.copysign(PENALTY, v)) if v else max(abs(row[c]) - PENALTY, 0.0)
    return held.sparkSession.createDataFrame([(c, float(g)) for c, g in gap.items()], "equation string, value double").withColumn("value", rounded("value"))


add("lasso_regression", zeros("intercept", *SCALED, "score"), lasso, digits=None)


# calibration
def platt(b: DataFrame) -> DataFrame:
    """The calibrated score has the target's moments with the score's logit, on training rows."""
    held = b.where("split = 'train'")
    _, _, calibrated = frameworks.platt(held, "target", "score")
    logit = F.log(F.col("score") / (1 - F.col("score")))
    return long(held, {("intercept",): F.avg(calibrated), ("logit",): F.avg(logit * calibrated)}, "equation string")


add("platt_calibration", f"{TRAIN} SELECT 'intercept' AS equation, {r('avg(target)')} AS value FROM s UNION ALL SELECT 'logit', {r('avg(target * ln(score / (1 - score)))')} FROM s", platt, digits=None)


def isotonic(b: DataFrame) -> DataFrame:
    """Each score's step, scores in hundredths."""
    held = b.select("target", rounded("score", 2).alias("s"))
    steps = frameworks.isotonic(held, "target", "s")
    fitted = F.coalesce(*(F.when(F.col("s") >= low, rate) for low, rate in reversed(steps)))
    return held.select("s").distinct().select(F.col("s").alias("score"), rounded(fitted).alias("rate"))


add(
    "isotonic_calibration",
    f"""
    , c AS (SELECT {r('score', 2)} AS s, count(*) AS n, sum(target)::DOUBLE AS e FROM book GROUP BY 1),
      k AS (SELECT s, sum(n) OVER w AS n, sum(e) OVER w AS e, sum(n) OVER w - n AS n0, sum(e) OVER w - e AS e0 FROM c WINDOW w AS (ORDER BY s)),
      m AS (SELECT x.s, a.s AS low, min((z.e - a.e0) / (z.n - a.n0)) AS least FROM k x JOIN k a ON a.s <= x.s JOIN k z ON z.s >= x.s GROUP BY x.s, a.s)
    SELECT s AS score, {r('max(least)')} AS rate FROM m GROUP BY s""",
    isotonic,
    digits=None,
)

# filters and encodings
FILTERED = ["amount", "balance", "score", "challenger"]


def filtered(b: DataFrame) -> DataFrame:
    matrix = diagnostics.correlation_matrix(b, FILTERED)
    row = b.agg(*(F.abs(F.corr(c, F.col("target").cast("double"))).alias(c) for c in FILTERED)).first()
    out = frameworks.correlation_filter(matrix, FILTERED, row.asDict(), 0.7)
    return b.sparkSession.createDataFrame([(k, c, rival) for k, (c, rival) in enumerate(out, 1)], 'place int, "column" string, rival string'.replace('"', "`"))


PAIRS = [(a, c) for a in FILTERED for c in FILTERED if a != c]
add(
    "correlation_filter",
    f"""
    , strength AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, abs(corr({c}, target)) AS s FROM book" for c in FILTERED)}),
      pair AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{c}' AS b, abs(corr({a}, {c})) >= 0.7 AS near FROM book" for a, c in PAIRS)}),
      near AS (SELECT a, coalesce(list(b) FILTER (WHERE near), []) AS rivals FROM pair GROUP BY a),
      o AS (SELECT c, rivals, row_number() OVER (ORDER BY s DESC, c) AS place FROM strength JOIN near ON a = c),
      steps AS (
        WITH RECURSIVE g AS (
            SELECT 0::BIGINT AS place, NULL::VARCHAR AS c, NULL::VARCHAR AS rival, []::VARCHAR[] AS kept
            UNION ALL
            SELECT o.place, o.c, list_filter(g.kept, lambda k: list_contains(rivals, k))[1],
                   CASE WHEN len(list_intersect(g.kept, rivals)) = 0 THEN list_append(g.kept, o.c) ELSE g.kept END
            FROM g JOIN o ON o.place = g.place + 1)
        SELECT * FROM g)
    SELECT place::INTEGER AS place, c AS "column", rival FROM steps WHERE place > 0""",
    filtered,
    digits=None,
)


def bad_rates(b: DataFrame) -> DataFrame:
    known = b.where("split = 'train'")
    mean = known.agg(F.avg("target")).first()[0]
    rates = binning.woe_table(known, category("sparse_segment"), "target")
    return binning.encode(b, rates, category("sparse_segment"), "bad_rate", mean, "rate").select("id", "rate")


add(
    "bad_rate_encoding",
    f"""
    , k AS (SELECT coalesce(sparse_segment, 'Missing') AS key, avg(target::DOUBLE) AS rate FROM book WHERE split = 'train' GROUP BY 1)
    SELECT id, {r("coalesce(rate, (SELECT avg(target::DOUBLE) FROM book WHERE split = 'train'))")} AS rate FROM book b LEFT JOIN k ON coalesce(b.sparse_segment, 'Missing') = k.key""",
    bad_rates,
)

# files
def through_csv(b: DataFrame) -> DataFrame:
    """Written as CSV, read as such, turned to Parquet and read again."""
    spark, base = b.sparkSession, scratch_path(b.sparkSession, "files")
    tables.export(b.select("id", "segment", "sparse", "sparse_segment", "target"), f"{base}/book.csv", "csv")
    return tables.csv_to_parquet(spark, f"{base}/book.csv", f"{base}/book.parquet").select(F.col("id").cast("bigint").alias("id"), "segment", "sparse", "sparse_segment", F.col("target").cast("int").alias("target"))


add("csv_round_trip", " SELECT id, segment, sparse, sparse_segment, target FROM book", through_csv, digits=None)
