"""Queries of the model families, imputations, screens and resampling whose results SQL can hold to their equations.

A fit has no closed form in SQL, but what makes it the fit has: its score equations. Such a query gives sums over all rows
at the fitted model, and the SQL gives what they must be: the same sums of the target, or 0.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import rounded
from gritstone.operators import additive_boosting, chained, extra_trees, grouped_models, neighbours, penalised, resampling, screening, splines
from gritstone.plans.catalogue import r
from gritstone.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: Features on comparable scales, each with what it is divided by.
SCALED = {"amount": 1e5, "balance": 1e4}
SCALED_SQL = ", ".join(f"{c} / {s:.0f}::DOUBLE AS {c}" for c, s in SCALED.items())


def scaled(b: DataFrame, *more: str) -> DataFrame:
    return b.select("id", *more, *((F.col(c) / s).alias(c) for c, s in SCALED.items()))


def long(df: DataFrame, cells: dict[tuple, Column], names: str) -> DataFrame:
    """One row per aggregate: its name's parts, then `value`, rounded to 6 digits."""
    row = df.agg(*(c.alias(f"c{k}") for k, c in enumerate(cells.values()))).first()
    rows = [(*key, None if row[k] is None else float(row[k])) for k, key in enumerate(cells)]
    return df.sparkSession.createDataFrame(rows, f"{names}, value double").withColumn("value", rounded("value"))


# imputation
GAPS = ", g AS (SELECT id, split, sparse, CASE WHEN id % 7 <> 0 THEN balance / 1e3 END AS a, CASE WHEN id % 5 <> 0 THEN score * 10 END AS b FROM book)"


def with_gaps(b: DataFrame) -> DataFrame:
    return b.select("id", "split", "sparse", F.when(F.col("id") % 7 != 0, F.col("balance") / 1e3).alias("a"), F.when(F.col("id") % 5 != 0, F.col("score") * 10).alias("b"))


def knn(b: DataFrame) -> DataFrame:
    held = with_gaps(b)
    return neighbours.knn_impute(held, held.where("split = 'train'"), "sparse", ["sparse", "a", "b"], "id").select("id", rounded("sparse", 4).alias("sparse"))


add(
    "knn_imputation",
    GAPS
    + f"""
    , d AS (SELECT id AS other, sparse AS v, a, b FROM g WHERE split = 'train' AND sparse IS NOT NULL),
      p AS (SELECT g.id, v, other, CASE WHEN g.a IS NULL OR d.a IS NULL THEN 0 ELSE 1 END AS na, CASE WHEN g.b IS NULL OR d.b IS NULL THEN 0 ELSE 1 END AS nb,
                   coalesce((g.a - d.a) * (g.a - d.a), 0) + coalesce((g.b - d.b) * (g.b - d.b), 0) AS s FROM g, d WHERE g.sparse IS NULL),
      n AS (SELECT id, avg(v) AS fill FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY s / (na + nb), other) AS place FROM p WHERE na + nb > 0) WHERE place <= 5 GROUP BY id)
    SELECT id, {r('coalesce(sparse, fill, (SELECT avg(v) FROM d))', 4)} AS sparse FROM g LEFT JOIN n USING (id)""",
    knn,
    digits=None,
)


def chain(b: DataFrame) -> DataFrame:
    held = with_gaps(b).withColumn("sparse", F.col("sparse") / 1e5)
    return chained.chained_imputer(held.where("split = 'train'"), ["sparse", "a", "b"]).transform(held).select("id", "sparse", "a", "b")


add("chained_imputation", None, chain)


# logistic families
def multinomial(b: DataFrame) -> DataFrame:
    held = scaled(b, "state")
    model = penalised.multinomial_logistic(held, list(SCALED), "state")
    cells = {(c, n): F.avg(p * x) for c, p in zip(model.classes, model.probabilities(), strict=True) for n, x in (("intercept", F.lit(1.0)), *((f, F.col(f)) for f in SCALED))}
    return long(held, cells, "class string, name string")


add(
    "multinomial_logistic",
    f"""
    , s AS (SELECT state, {SCALED_SQL}, count(*) OVER () AS n FROM book)
    SELECT state AS class, 'intercept' AS name, {r('count(*) / any_value(n)')} AS value FROM s GROUP BY state
    UNION ALL SELECT state, 'amount', {r('sum(amount) / any_value(n)')} FROM s GROUP BY state
    UNION ALL SELECT state, 'balance', {r('sum(balance) / any_value(n)')} FROM s GROUP BY state""",
    multinomial,
    digits=None,
)

MIX, STEPS, LEAST = 0.5, 4, 0.02


def elastic_path(b: DataFrame) -> DataFrame:
    """Of every fit the penalty and how far each term is from its optimality condition."""
    names = ["amount", "balance", "score"]
    held = b.select(*((F.col(c) / SCALED.get(c, 1.0)).alias(c) for c in names), F.col("target").cast("double").alias("y"))
    path = penalised.elastic_net_logistic(held, names, "y", MIX, steps=STEPS, least=LEAST)
    mean, spread, _ = penalised.standardising(held, names)
    pulls = {(k, c): F.avg((m.predict() - F.col("y")) * (F.lit(1.0) if c == "intercept" else (F.col(c) - float(mean[names.index(c)])) / float(spread[names.index(c)]))) for k, m in enumerate(path.models) for c in ("intercept", *names)}
    row = held.agg(*(c.alias(f"c{j}") for j, c in enumerate(pulls.values()))).first()
    rows = []
    for j, (k, c) in enumerate(pulls):
        off = row[j]
        if c != "intercept":
            at, penalty = path.models[k].coefficients[1 + names.index(c)] * spread[names.index(c)], path.penalties[k]
            off += penalty * (1 - MIX) * at
            off = abs(off + penalty * MIX * np.sign(at)) if at else max(abs(off) - penalty * MIX, 0.0)
        rows.append((k, c, float(path.penalties[k]), float(off)))
    return held.sparkSession.createDataFrame(rows, "step int, name string, penalty double, gap double")


add(
    "elastic_net_logistic",
    f"""
    , m AS (SELECT greatest(abs(covar_pop(amount, target)) / stddev_pop(amount), abs(covar_pop(balance, target)) / stddev_pop(balance), abs(covar_pop(score, target)) / stddev_pop(score)) / {MIX}::DOUBLE AS most FROM book)
    SELECT k::INTEGER AS step, name, {r(f'most * pow({LEAST}::DOUBLE, k / {STEPS - 1}.0::DOUBLE)')} AS penalty, 0.0::DOUBLE AS gap
    FROM m, (SELECT unnest(range(0, {STEPS})) AS k), (SELECT unnest(['intercept', 'amount', 'balance', 'score']) AS name)""",
    elastic_path,
)

# splines
KNOTS, DEGREE = 5, 3
#: A cubic cardinal spline at t, from 0 to 4.
CARDINAL = "CASE WHEN {t} < 0 OR {t} > 4 THEN 0 WHEN {t} < 1 THEN pow({t}, 3) / 6 WHEN {t} < 2 THEN (((-3 * {t} + 12) * {t} - 12) * {t} + 4) / 6 WHEN {t} < 3 THEN (((3 * {t} - 24) * {t} + 60) * {t} - 44) / 6 ELSE pow(4 - {t}, 3) / 6 END"


def bases_sql() -> str:
    """feature, x, target for both features, with where x is within the feature's range, in units of the knots' distance."""
    one = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} / {s:.0f}::DOUBLE AS x, target FROM book" for c, s in SCALED.items())
    return f", e AS ({one}), u AS (SELECT feature, target, ({KNOTS - 1}) * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS u FROM e WINDOW w AS (PARTITION BY feature))"


def basis_sums(held: DataFrame, of: Column) -> dict[tuple, Column]:
    """The mean of each basis function times `of`."""
    ends = held.agg(*(f(c) for c in SCALED for f in (F.min, F.max))).first()
    cells = {}
    for k, c in enumerate(SCALED):
        for j, column in enumerate(splines.b_splines(ends[2 * k], ends[2 * k + 1], KNOTS, DEGREE).columns(F.col(c))):
            cells[c, j] = F.avg(column * of)
    return cells


def spline_regression(b: DataFrame) -> DataFrame:
    """With next to no penalty the fit is least squares: fitted values have the target's moments with every function."""
    held = scaled(b, "target")
    model = splines.additive_splines(held, list(SCALED), "target", knots=KNOTS, degree=DEGREE, penalties=[1e-7])
    return long(held, basis_sums(held, model.predict()), "feature string, function int")


add(
    "gam_spline_regression",
    bases_sql()
    + f"""
    SELECT feature, j::INTEGER AS function, {r(f"avg(target * ({CARDINAL.format(t='(u + 3 - j)')}))")} AS value
    FROM u, (SELECT unnest(range(0, {KNOTS + DEGREE - 1})) AS j) GROUP BY feature, j""",
    spline_regression,
    digits=None,
)


def spline_logistic(b: DataFrame) -> DataFrame:
    """The penalty's pull on each function's weight equals the mean product of function and residual; with the sum of the target."""
    held, penalty = scaled(b, "target"), 10.0
    model = splines.additive_splines(held, list(SCALED), "target", binary=True, knots=KNOTS, degree=DEGREE, penalties=[penalty])
    ends = held.agg(*(f(c) for c in SCALED for f in (F.min, F.max))).first()
    cells, n = {("fitted", "", -1): F.avg(model.predict())}, held.count()
    width, rest = KNOTS + DEGREE - 2, F.col("target") - model.predict()
    for k, c in enumerate(SCALED):
        for j, column in enumerate(splines.b_splines(ends[2 * k], ends[2 * k + 1], KNOTS, DEGREE).columns(F.col(c))[:width]):
            pull = penalty * float(model.weights[k * width + j]) / n
            cells["gap", c, j] = F.avg(column * rest) / F.stddev_pop(column) - pull
    return long(held, cells, "kind string, feature string, function int")


add(
    "gam_spline_logistic",
    f"""
    SELECT 'fitted' AS kind, '' AS feature, -1 AS function, {r('avg(target::DOUBLE)')} AS value FROM book
    UNION ALL SELECT 'gap', f, j::INTEGER, 0.0::DOUBLE FROM (SELECT unnest(['amount', 'balance']) AS f), (SELECT unnest(range(0, {KNOTS + DEGREE - 2})) AS j)""",
    spline_logistic,
    digits=None,
)


def smoothed(b: DataFrame) -> DataFrame:
    held = scaled(b, "target")
    return held.select("id", splines.additive_splines(held, list(SCALED), "target").predict().alias("fitted"))


add("gam_cross_validated", None, smoothed)


def natural_sql() -> str:
    """Four functions over four knots: second derivatives at the inner two by Cramer's rule, values 1 at one knot each."""
    out = []
    for f in range(4):
        v = [1 if k == f else 0 for k in range(4)]
        d1 = f"(({v[2]} - {v[1]}) / h1 - ({v[1]} - {v[0]}) / h0)"
        d2 = f"(({v[3]} - {v[2]}) / h2 - ({v[2]} - {v[1]}) / h1)"
        det = "((h0 + h1) * (h1 + h2) / 9 - h1 * h1 / 36)"
        m = ["0", f"(({d1} * (h1 + h2) / 3 - {d2} * h1 / 6) / {det})", f"(({d2} * (h0 + h1) / 3 - {d1} * h1 / 6) / {det})", "0"]

        def piece(i: int, v: list[int] = v, m: list[str] = m) -> str:
            a, b = f"((k{i + 1} - x) / h{i})", f"((x - k{i}) / h{i})"
            return f"{v[i]} * {a} + {v[i + 1]} * {b} + (({a} * {a} * {a} - {a}) * {m[i]} + ({b} * {b} * {b} - {b}) * {m[i + 1]}) * h{i} * h{i} / 6"

        below = f"{v[0]} + (x - k0) * (({v[1]} - {v[0]}) / h0 - h0 * {m[1]} / 6)"
        above = f"{v[3]} + (x - k3) * (({v[3]} - {v[2]}) / h2 + h2 * {m[2]} / 6)"
        out.append(f"{r(f'CASE WHEN x < k0 THEN {below} WHEN x < k1 THEN {piece(0)} WHEN x < k2 THEN {piece(1)} WHEN x < k3 THEN {piece(2)} ELSE {above} END')} AS basis_{f + 1}")
    return ", ".join(out)


def natural(b: DataFrame) -> DataFrame:
    held = b.select("id", "split", (F.col("sparse") / 1e5).alias("x"))
    basis = splines.natural_spline(held.where("split = 'train'"), "x")
    return held.select("id", *(c.alias(f"basis_{k}") for k, c in enumerate(basis.columns(F.col("x")), 1)))


add(
    "natural_spline",
    f"""
    , x AS (SELECT id, split, sparse / 100000::DOUBLE AS x FROM book),
      q AS (SELECT quantile_cont(x, [0.0, 1 / 3::DOUBLE, 2 / 3::DOUBLE, 1.0]) AS q FROM (SELECT DISTINCT x FROM x WHERE split = 'train' AND x IS NOT NULL)),
      k AS (SELECT id, x, q[1] AS k0, q[2] AS k1, q[3] AS k2, q[4] AS k3, q[2] - q[1] AS h0, q[3] - q[2] AS h1, q[4] - q[3] AS h2 FROM x, q)
    SELECT id, {natural_sql()} FROM k""".replace("CASE WHEN x <", "CASE WHEN x IS NULL THEN NULL WHEN x <"),
    natural,
)


# groups
def mixed(b: DataFrame) -> DataFrame:
    """The equations of the fixed part and of the ratio of the variances, over rows and groups, with the groups' count."""
    held = scaled(b, "entity", "score")
    model = grouped_models.mixed_effects(held, ["amount"], "score", "entity")
    ratio = model.group_variance / model.residual_variance
    apart = held.withColumn("r", F.col("score") - model.predict()).groupBy("entity").agg(
        F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("amount").alias("x"), F.sum(F.col("r") * F.col("amount")).alias("rx"), F.sum(F.col("r") * F.col("r")).alias("rr")
    )
    w, grown = ratio / (1 + ratio * F.col("n")), 1 + ratio * F.col("n")
    variance = model.residual_variance
    cells = {
        ("groups",): F.count("*").cast("double"),
        ("rows",): F.sum("n").cast("double"),
        ("intercept",): F.sum(F.col("r") - w * F.col("n") * F.col("r")) / F.sum("n"),
        ("amount",): F.sum(F.col("rx") - w * F.col("x") * F.col("r")) / F.sum("n"),
        ("residual variance",): F.sum(F.col("rr") - w * F.col("r") * F.col("r")) / F.sum("n") / variance - 1,
        ("ratio",): (F.sum((F.col("r") / grown) ** 2) / variance - F.sum(F.col("n") / grown)) / F.sum("n"),
    }
    return long(apart, cells, "equation string")


add(
    "mixed_effects_regression",
    """
    SELECT 'groups' AS equation, count(DISTINCT entity)::DOUBLE AS value FROM book UNION ALL SELECT 'rows', count(*)::DOUBLE FROM book
    UNION ALL SELECT unnest(['intercept', 'amount', 'residual variance', 'ratio']), 0.0::DOUBLE""",
    mixed,
    digits=None,
)


def marginal(b: DataFrame) -> DataFrame:
    """The estimating equations with the exchangeable working correlation, and that of the correlation itself."""
    held = scaled(b, "entity", "target")
    model = grouped_models.estimating_equations(held, ["amount", "balance"], "target", "entity")
    a, p = model.correlation, 3
    mu = model.predict()
    d = F.sqrt(mu * (1 - mu))
    rows = held.select("entity", ((F.col("target") - mu) / d).alias("r"), d.alias("d"), (d * F.col("amount")).alias("amount"), (d * F.col("balance")).alias("balance"))
    parts = ["d", "amount", "balance"]
    by = rows.groupBy("entity").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"), *(F.sum(c).alias(c) for c in parts), *(F.sum(F.col(c) * F.col("r")).alias(f"r_{c}") for c in parts))
    c = a / (1 + (F.col("n") - 1) * a)
    n, pairs = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)
    scale = F.sum("rr") / (n - p)
    cells = {("groups",): F.count("*").cast("double")}
    cells |= {(name,): F.sum(F.col(f"r_{x}") - c * F.col(x) * F.col("r")) / n for x, name in zip(parts, ("intercept", "amount", "balance"), strict=True)}
    cells |= {("correlation",): F.sum((F.col("r") * F.col("r") - F.col("rr")) / 2) / scale / (pairs - p) - a}
    return long(by, cells, "equation string")


add(
    "gee_logistic_regression",
    """
    SELECT 'groups' AS equation, count(DISTINCT entity)::DOUBLE AS value FROM book
    UNION ALL SELECT unnest(['intercept', 'amount', 'balance', 'correlation']), 0.0::DOUBLE""",
    marginal,
    digits=None,
)

# boosting and trees
BINS = 8


def boosted(b: DataFrame) -> DataFrame:
    """After many cycles every bin's mean fitted value is its mean target."""
    held = scaled(b, "target")
    model = additive_boosting.additive_boosting(held, list(SCALED), "target", bins=BINS, cycles=3000, rate=0.5)
    fitted = held.withColumn("fitted", model.predict())
    out = None
    for s in model.shapes:
        place = F.lit(1)
        for cut in s.cuts:
            place = place + (F.col(s.feature) > cut).cast("int")
        one = fitted.groupBy(F.lit(s.feature).alias("feature"), place.alias("bin")).agg(F.count("*").alias("n"), rounded(F.avg("fitted")).alias("fitted"))
        out = one if out is None else out.unionByName(one)
    return out


add(
    "explainable_boosting",
    f"""
    , e AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} / {s:.0f}::DOUBLE AS x, target FROM book" for c, s in SCALED.items())}),
      q AS (SELECT feature, list_distinct(quantile_cont(x, [{', '.join(f'{k / BINS}::DOUBLE' for k in range(1, BINS))}])) AS q FROM e GROUP BY feature)
    SELECT feature, (1 + len(list_filter(q, lambda c: x > c)))::INTEGER AS bin, count(*) AS n, {r('avg(target::DOUBLE)')} AS fitted FROM e JOIN q USING (feature) GROUP BY 1, 2""",
    boosted,
    digits=None,
)


def shapes(b: DataFrame) -> DataFrame:
    held = b.select((F.col("amount") / 1e5).alias("amount"), (F.col("balance") / 1e4).alias("balance"), "sparse", "target")
    return additive_boosting.additive_boosting(held, ["amount", "balance", "sparse"], "target", binary=True, bins=16).table(held)


add("explainable_boosting_logistic", None, shapes)


def forest(b: DataFrame) -> DataFrame:
    held = scaled(b, "target")
    return held.select("id", extra_trees.extra_trees(held, list(SCALED), "target").predict().alias("score"))


add("extra_trees", None, forest)

# screens
NUMERIC = ["amount", "balance", "score", "sparse"]
PAIRS = [(a, c) for k, a in enumerate(NUMERIC) for c in NUMERIC[k + 1 :]]
add(
    "interaction_screen",
    f"""
    , t AS (SELECT coalesce(sparse_segment, 'Missing') AS level FROM book GROUP BY 1 ORDER BY count(*) DESC, level LIMIT 3),
      c AS ({' UNION ALL '.join(f"SELECT 'numeric_numeric' AS kind, '{a}' AS source, '{c}' AS secondary, NULL AS level, corr({a} * {c}, target) AS r, count({a} * {c}) AS n FROM book" for a, c in PAIRS)}
            UNION ALL {' UNION ALL '.join(f"SELECT 'categorical_numeric', '{a}', 'sparse_segment', level, corr({a} * (coalesce(sparse_segment, 'Missing') = level)::INT, target), count({a}) FROM book, t GROUP BY level" for a in NUMERIC)})
    SELECT kind, source, secondary, level, {r('abs(r)')} AS score, n, row_number() OVER (ORDER BY abs(r) DESC) <= 5 AS selected FROM c WHERE abs(r) >= 0.001""",
    lambda b: screening.candidate_table(b, screening.interaction_screen(b, NUMERIC, ["sparse_segment"], "target", 0.001, 5, 3)),
)

# resampling
REPLICATES, SEED = 4, 42
add(
    "bootstrap_fixed_size",
    f"""
    , o AS (SELECT target, score, sparse, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS n FROM book),
      d AS (SELECT k, ('0x' || sha256('{SEED}:' || k || ':' || i)[1:13])::BIGINT % n + 1 AS place FROM (SELECT unnest(range(0, {REPLICATES})) AS k), (SELECT unnest(range(0, (SELECT count(*) FROM book))) AS i), (SELECT count(*) AS n FROM book))
    SELECT k::INTEGER AS replicate, count(*) AS n, count(DISTINCT place) AS different, sum(target)::BIGINT AS events, {r('avg(score)')} AS score, {r('avg(sparse)', 3)} AS sparse FROM d JOIN o USING (place) GROUP BY k""",
    lambda b: resampling.bootstrap_rows(b.select("id", "target", "score", "sparse"), "id", REPLICATES)
    .groupBy("replicate")
    .agg(
        F.sum("times").alias("n"), F.count("*").alias("different"), F.sum(F.col("target") * F.col("times")).alias("events"), rounded(F.sum(F.col("score") * F.col("times")) / F.sum("times")).alias("score"),
        rounded(F.sum(F.col("sparse") * F.col("times")) / F.sum(F.when(F.col("sparse").isNotNull(), F.col("times"))), 3).alias("sparse"),
    ),
    digits=None,
)


def positional(b: DataFrame) -> DataFrame:
    tables = {"book": b.select("id", F.col("score").alias("value")), "challenger": b.select("id", F.col("challenger").alias("value"))}
    taken = resampling.positional_sample(tables, "id", 300)
    return taken["book"].select(F.lit("book").alias("table"), "id", "value").unionByName(taken["challenger"].select(F.lit("challenger").alias("table"), "id", "value"))


add(
    "positional_sample",
    f"""
    , o AS (SELECT id, score, challenger, row_number() OVER (ORDER BY id) AS place FROM book),
      s AS (SELECT * FROM o ORDER BY ('0x' || sha256('{SEED}:' || place)[1:13])::BIGINT, place LIMIT 300)
    SELECT 'book' AS "table", id, score AS value FROM s UNION ALL SELECT 'challenger', id, challenger FROM s""",
    positional,
)
