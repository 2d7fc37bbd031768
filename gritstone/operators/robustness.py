"""Bootstrap, pooling of imputations, missingness and stationarity tests, specification tests, influence, subset search."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.distributions import chi2_sf, f_sf
from gritstone.functions.scalars import let
from gritstone.operators.blocks import block_sums, design
from gritstone.operators.models import Linear, gram
from gritstone.operators.resampling import hashed_digits, hashed_number


#: Chances of a Poisson(1) count of at most 0, 1, ..., 11.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()


def poisson_weight(key: str, replicate: int) -> Column:
    """How often a row is in a replicate of a bootstrap: a Poisson(1) count, reproducible from a unique key.

    Counts come from the SHA-256 of replicate and key, so neither neighbouring keys nor replicates go together.
    """

    def count(u: Column) -> Column:
        out = F.when(u <= POISSON[0], 0)
        for k, step in enumerate(POISSON[1:], 1):
            out = out.when(u <= step, k)
        return out.otherwise(len(POISSON))

    # the hash is most of the work, so it is taken once, not once a step
    return let((hashed_number("poisson", replicate, F.col(key)) + 0.5) / float(1 << 52), count)


def _weights(digits: np.ndarray) -> np.ndarray:
    """The same counts from a batch of hashed digits."""
    values = np.frombuffer("".join(digits).encode(), np.uint8).reshape(len(digits), 13).astype(np.int64)
    values = (values & 15) + 9 * (values > 57)
    u = (values @ (np.int64(1) << (4 * np.arange(12, -1, -1, dtype=np.int64))) + 0.5) / float(1 << 52)
    return np.searchsorted(POISSON, u, "left").astype(float)


def bootstrap_means(table: DataFrame, key: str, values: dict[str, Column], replicates: int) -> DataFrame:
    """replicate, n and the weighted mean of each value; one aggregate over the rows, none is copied."""
    weighted = table.select(*(v.cast("double").alias(n) for n, v in values.items()), *(poisson_weight(key, k).alias(f"w{k}") for k in range(replicates)))
    cells = [F.sum(f"w{k}").alias(f"n{k}") for k in range(replicates)]
    # the divisor counts rows that have the value
    cells += [(F.sum(F.col(f"w{k}") * F.col(n)) / F.sum(F.when(F.col(n).isNotNull(), F.col(f"w{k}")))).alias(f"{n}{k}") for k in range(replicates) for n in values]
    row = weighted.agg(*cells)
    each = (F.struct(F.lit(k).alias("replicate"), F.col(f"n{k}").alias("n"), *(F.col(f"{n}{k}").alias(n) for n in values)) for k in range(replicates))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def bootstrap_fit(table: DataFrame, key: str, features: list[str], target: str, replicates: int) -> DataFrame:
    """term, mean, std, p05, p50, p95 and share of the commoner sign of least-squares coefficients over replicates.

    One job sums the weighted moments of all replicates, (k + 1)(k + 2) numbers for each.
    """
    names = [*features, target]
    held = table.select(*(F.col(c).cast("double").alias(c) for c in names), *(hashed_digits("poisson", k, F.col(key)).alias(f"digits__{k}") for k in range(replicates))).na.drop()
    p = len(features) + 1

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        rows = design(x, features)
        wide = np.column_stack([rows, x[target]])
        return np.concatenate([(rows.T @ (wide * _weights(x[f"digits__{k}"])[:, None])).ravel() for k in range(replicates)])

    sums = block_sums(held, replicates * p * (p + 1), part).reshape(replicates, p, p + 1)
    b = np.array([np.linalg.lstsq(m[:, :p], m[:, p], rcond=None)[0] for m in sums])
    low, mid, high = np.quantile(b, [0.05, 0.5, 0.95], axis=0)
    spread = b.std(axis=0, ddof=1) if replicates > 1 else np.zeros(b.shape[1])
    sign = np.maximum((b > 0).mean(axis=0), (b < 0).mean(axis=0))
    rows = [(n, *map(float, x)) for n, *x in zip(["intercept", *features], b.mean(axis=0), spread, low, mid, high, sign, strict=True)]
    return table.sparkSession.createDataFrame(rows, "term string, mean double, std double, p05 double, p50 double, p95 double, sign_share double")


def pooled(estimates: DataFrame, term: str = "term", estimate: str = "estimate", std_error: str = "std_error") -> DataFrame:
    """Rubin's rules over the rows of a term, one per imputation: m, estimate, within, between, total variance, std_error,
    fraction of the variance due to missingness. A single imputation has no between variance."""
    m, between = F.col("m"), F.col("between")
    held = estimates.groupBy(term).agg(F.count(estimate).alias("m"), F.avg(estimate).alias("estimate"), F.avg(F.col(std_error) * F.col(std_error)).alias("within"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"))
    held = held.withColumn("total", F.col("within") + (1 + 1 / m) * between)
    return held.withColumns({"std_error": F.sqrt("total"), "missing_fraction": F.when(F.col("total") > 0, (1 + 1 / m) * between / F.col("total")).otherwise(0.0)})


def pairwise_moments(table: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and pairwise covariances (each over the rows that have both), one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    row = table.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.full((len(columns), len(columns)), np.nan)
    for i, j in pairs:
        if row[f"c{i}_{j}"] is not None:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return np.array([math.nan if row[f"m{i}"] is None else row[f"m{i}"] for i in range(len(columns))]), cov


def missing_completely_at_random(table: DataFrame, columns: list[str]) -> DataFrame:
    """Little's test with pairwise moments: patterns (with two rows or more), statistic, degrees of freedom, p-value.

    A pattern is one group of the aggregate, so at most 2^columns rows reach the driver.
    """
    mean, cov = pairwise_moments(table, columns)
    gone = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    rows = table.groupBy(gone.alias("pattern")).agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns))).collect()
    statistic, terms, patterns = 0.0, 0, 0
    for r in sorted(rows, key=lambda r: r["pattern"]):
        has = [i for i, c in enumerate(r["pattern"]) if c == "0"]
        part = cov[np.ix_(has, has)]
        if not has or r["n"] < 2 or np.isnan(part).any():
            continue
        d = np.array([r[f"m{i}"] for i in has]) - mean[has]
        statistic += float(r["n"] * d @ np.linalg.pinv(part) @ d)
        terms += len(has)
        patterns += 1
    df = max(terms - len(columns), 1)
    return table.sparkSession.createDataFrame([(patterns, statistic, df, float(chi2_sf(statistic, df)))], "patterns int, statistic double, degrees int, p_value double")


def kpss(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """n and the level-stationarity statistic, with Bartlett weights over `lags`; one row per period."""
    own = Window.orderBy(order)
    mean = series.agg(F.avg(value)).first()[0]
    e = F.col(value) - F.lit(mean)
    held = series.where(F.col(value).isNotNull()).select(e.alias("e"), F.sum(e).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), *(F.lag(e, k).over(own).alias(f"e{k}") for k in range(1, lags + 1)))
    variance = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0))
    n = F.count("*")
    return held.agg(n.alias("n"), (F.sum(F.col("s") * F.col("s")) / (n * variance)).alias("statistic"))


def phillips_perron(series: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """n and the t statistic of the level in a regression of changes on it, corrected by a Newey-West variance."""
    own, y = Window.orderBy(order), F.col(value).cast("double")
    steps = series.where(F.col(value).isNotNull()).select(order, F.lag(y).over(own).alias("level"), (y - F.lag(y).over(own)).alias("change")).where("level IS NOT NULL")
    g, v, yy, n = gram(steps, ["level"], F.col("change"))
    b = np.linalg.solve(g, v)
    error = math.sqrt(max(yy - b @ v, 0.0) / (n - 2) * np.linalg.inv(g)[1, 1])
    e = F.col("change") - float(b[0]) - float(b[1]) * F.col("level")
    held = steps.select(e.alias("e"), *(F.lag(e, k).over(own).alias(f"e{k}") for k in range(1, lags + 1)))
    row = held.agg(*(F.sum(F.col("e") * F.col("e" if k == 0 else f"e{k}")).alias(f"s{k}") for k in range(lags + 1))).first()
    gamma = [(row[f"s{k}"] or 0.0) / n for k in range(lags + 1)]
    long_run = gamma[0] + 2 * sum((1 - k / (lags + 1)) * gamma[k] for k in range(1, lags + 1))
    schema = "n bigint, statistic double"
    if long_run <= 0 or gamma[0] <= 0:
        return series.sparkSession.createDataFrame([(n, None)], schema)
    statistic = math.sqrt(gamma[0] / long_run) * b[1] / error - 0.5 * (long_run - gamma[0]) / long_run * n * error / math.sqrt(gamma[0])
    return series.sparkSession.createDataFrame([(n, float(statistic))], schema)


def ramsey_reset(table: DataFrame, features: list[str], target: str, powers: tuple[int, ...] = (2, 3)) -> DataFrame:
    """F of powers of the fitted value (scaled to its range) added to a least-squares model."""
    y = F.col(target).cast("double")
    g, v, yy, n = gram(table, features, y)
    b = np.linalg.solve(g, v)
    fitted = Linear(features, b).linear()
    low, high = table.agg(F.min(fitted), F.max(fitted)).first()
    unit = (fitted - F.lit(low)) / F.lit((high - low) or 1.0)
    more = [f"__fitted_{p}" for p in powers]
    g2, v2, _, _ = gram(table.withColumns({m: F.pow(unit, F.lit(p)) for m, p in zip(more, powers)}), [*features, *more], y)
    small, large = yy - v @ b, yy - v2 @ np.linalg.solve(g2, v2)
    rest = n - len(v2)
    f = (small - large) / len(powers) / (large / rest)
    return table.sparkSession.createDataFrame([(n, float(f), float(f_sf(f, len(powers), rest)))], "n bigint, statistic double, p_value double")


def influence(table: DataFrame, features: list[str], target: str) -> DataFrame:
    """The rows without nulls, with fitted, leverage, studentised residual and Cook's distance of a least-squares model.

    The hat value x' (X'X)^-1 x is an expression in k^2 numbers, so no row leaves its task.
    """
    y = F.col(target).cast("double")
    g, v, yy, n = gram(table, features, y)
    k = len(v)
    b, inverse = np.linalg.solve(g, v), np.linalg.inv(g)
    variance = max(yy - v @ b, 0.0) / max(n - k, 1)
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    leverage = sum((x[i] * x[j] * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    held = table.where(y.isNotNull()).na.drop(subset=features).withColumns({"fitted": Linear(features, b).linear(), "leverage": leverage})
    residual = (y - F.col("fitted")) / F.sqrt(F.lit(variance) * (1 - F.col("leverage"))) if variance else F.lit(0.0)
    return held.withColumn("studentised", residual).withColumn("cooks_distance", F.col("studentised") * F.col("studentised") * F.col("leverage") / (1 - F.col("leverage")) / k)


def elastic_net(table: DataFrame, features: list[str], target: str, penalty: float, mix: float = 1.0, rounds: int = 5000, tolerance: float = 1e-12) -> Linear:
    """Least squares / 2n plus penalty * (mix * L1 + (1 - mix) / 2 * L2), intercept free, features as they are.

    One aggregate; coordinate descent then runs on the k x k moments. mix = 1 is the lasso.
    """
    g, v, _, n = gram(table, features, F.col(target).cast("double"))
    if not n:
        raise ValueError("no row without nulls")
    mean, top = g[0, 1:] / n, v[0] / n
    c, r = g[1:, 1:] / n - np.outer(mean, mean), v[1:] / n - mean * top
    b = np.zeros(len(features))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            rest = r[j] - c[j] @ b + c[j, j] * b[j]
            scale = c[j, j] + penalty * (1 - mix)
            new = math.copysign(max(abs(rest) - penalty * mix, 0.0), rest) / scale if scale > 0 else 0.0
            moved = max(moved, abs(new - b[j]) * math.sqrt(max(c[j, j], 0.0)))
            b[j] = new
        if moved < tolerance:
            break
    return Linear(features, np.concatenate([[top - mean @ b], b]))


def subset_search(table: DataFrame, features: list[str], target: str, sizes: range) -> DataFrame:
    """subset, size, n, r2, aic, bic of the least-squares model of every subset of the given sizes, and the rank by bic.

    One Gram matrix over the rows that have all features serves all subsets.
    """
    g, v, yy, n = gram(table, features, F.col(target).cast("double"))
    total, out = yy - v[0] ** 2 / n, []
    for size in sizes:
        for chosen in itertools.combinations(range(len(features)), size):
            at = [0, *(j + 1 for j in chosen)]
            sse = max(float(yy - v[at] @ np.linalg.lstsq(g[np.ix_(at, at)], v[at], rcond=None)[0]), 1e-300)
            deviance = n * math.log(sse / n)
            out.append((",".join(features[j] for j in chosen), size, n, float(1 - sse / total), deviance + 2 * (size + 1), deviance + math.log(n) * (size + 1)))
    out.sort(key=lambda r: (r[5], r[0]))
    return table.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(out, 1)], "subset string, size int, n bigint, r2 double, aic double, bic double, rank int")


def rank_score(table: DataFrame, value: str, by: list[str], higher_is_better: bool = True, output: str = "rank_score") -> DataFrame:
    """1 for the best candidate of a group down to 0 for the worst, ties sharing the better place; nulls have none, a single value 1."""
    order = F.desc_nulls_last(value) if higher_is_better else F.asc_nulls_last(value)
    known = F.count(value).over(Window.partitionBy(*by))
    place = (F.rank().over(Window.partitionBy(*by).orderBy(order)) - 1) / F.greatest(known - 1, F.lit(1))
    return table.withColumn(output, F.when(F.col(value).isNotNull(), 1 - place))


def segmented_fits(table: DataFrame, segment: str, features: list[str], target: str, least: int = 50) -> tuple[Linear, dict[str, Linear]]:
    """A model of all rows and one of each segment with `least` rows or more; one grouped aggregate of moments gives all.

    Segments are few: a scored row goes through a CASE over them.
    """
    found = segment_moments(table, segment, features, target)
    solved = lambda m: Linear(features, np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0])
    if not found:
        raise ValueError("no row is without nulls")
    return solved(sum(m for _, m in found.values())), {s: solved(m) for s, (n, m) in found.items() if s is not None and n >= least}


def segment_moments(table: DataFrame, segment: str, features: list[str], target: str) -> dict:
    """segment -> rows of it, and moments of (1, features, target) over those without nulls."""
    names = [*features, target]
    k = len(names) + 1
    columns = {f"x{j}": F.col(c).cast("double") for j, c in enumerate(names, 1)}
    whole = F.lit(True)
    for x in columns.values():
        whole = whole & x.isNotNull()
    held = table.select(F.col(segment).alias("segment"), F.lit(1.0).alias("x0"), *(F.when(whole, x).alias(n) for n, x in columns.items()), whole.alias("whole"))
    held = held.withColumn("x0", F.when(F.col("whole"), F.col("x0")))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    rows = held.groupBy("segment").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}")), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in cells)).collect()
    out = {}
    for r in rows:
        m = np.zeros((k, k))
        for i, j in cells:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r["segment"]] = r["n"], m
    return out


def segment_fit_table(table: DataFrame, segment: str, features: list[str], target: str, least: int = 50) -> DataFrame:
    """segment, n, term, coefficient and r2 of each segment with `least` rows or more, in one grouped aggregate."""
    out = []
    for s, (n, m) in segment_moments(table, segment, features, target).items():
        if n < least or not m[0, 0]:
            continue
        b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
        rest = max(m[-1, -1] - b @ m[:-1, -1], 0.0)
        out += [(s, n, c, float(v), float(1 - rest / total) if total > 0 else None) for c, v in zip(["intercept", *features], b, strict=True)]
    kind = table.schema[segment].dataType.simpleString()
    return table.sparkSession.createDataFrame(out, f"segment {kind}, n bigint, term string, coefficient double, r2 double")


def routed(segment: str, whole: Linear, models: dict[str, Linear]) -> tuple[Column, Column]:
    """The score of a row's own model, else of the whole one, and the name of the model that gave it."""
    score, route = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(""))
    for name, model in models.items():
        score, route = score.when(F.col(segment) == F.lit(name), model.predict()), route.when(F.col(segment) == F.lit(name), F.lit(name))
    return score.otherwise(whole.predict()), route.otherwise(F.lit("global"))
