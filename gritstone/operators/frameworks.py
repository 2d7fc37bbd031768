"""Tables of the diagnostic frameworks: curves, comparisons, flags, bands, folds, checks of time series."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import clipped_between, correlation, divided
from gritstone.operators.metrics import probability_losses, rank_metrics, score_counts
from gritstone.operators.models import gram
from gritstone.operators.quantiles import exact_quantiles, quantiles_of
from gritstone.operators.ranges import count_below, free_name, range_count
from gritstone.operators.splits import global_rank


def top_per_group(table: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows per group and task before it shuffles."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def pivoted(table: DataFrame, row: str, column: str, values: list[str], value: Column) -> DataFrame:
    """One column per listed value: a bounded pivot, one job."""
    return table.groupBy(row).pivot(column, values).agg(value)


def with_target(table: DataFrame, target: str) -> DataFrame:
    return table.where(F.col(target).isNotNull())


def fence_flags(table: DataFrame, key: str, column: str, reach: float = 1.5) -> DataFrame:
    """key, value, side of the rows beyond the quartiles by more than `reach` interquartile ranges."""
    low, high = exact_quantiles(table, column, [0.25, 0.75])
    x = F.col(column)
    side = F.when(x < F.lit(low) - reach * (F.lit(high) - F.lit(low)), "low").when(x > F.lit(high) + reach * (F.lit(high) - F.lit(low)), "high")
    return table.select(key, x.alias("value"), side.alias("side")).where("side IS NOT NULL")


def missing_correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, r of the columns' missing indicators; one aggregate."""
    gone = {c: F.col(c).isNull().cast("double") for c in columns}
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = table.agg(*(correlation(gone[a], gone[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def ks_curve(table: DataFrame, target: str, score: str) -> DataFrame:
    """score, cumulative shares of events and others, and their gap; null where there are none at all."""
    c = score_counts(table, target, score)
    bad, good = (divided(F.col(f"{s}_upto").cast("double"), F.col(f"{s}_all").cast("double")) for s in ("pos", "neg"))
    return c.select(score, bad.alias("events"), good.alias("others"), F.abs(bad - good).alias("gap"))


def precision_recall_curve(table: DataFrame, target: str, score: str) -> DataFrame:
    """threshold, precision, recall of score >= threshold."""
    c = score_counts(table, target, score)
    hit = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    every = hit + F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    ratio = lambda a, b: divided(a.cast("double"), b.cast("double"))
    return c.select(F.col(score).alias("threshold"), ratio(hit, every).alias("precision"), ratio(hit, F.col("pos_all")).alias("recall"))


def challenger_comparison(table: DataFrame, target: str, primary: str, challenger: str, by: str) -> DataFrame:
    """by, metric, primary, challenger and their difference, in long form."""

    def measured(score: str, name: str) -> DataFrame:
        ranks = rank_metrics(table, target, score, (by,))
        losses = table.groupBy(by).agg(*probability_losses(F.col(target), F.col(score)))
        return ranks.join(losses, by).unpivot([by], ["auc", "ks", "average_precision", "brier", "log_loss"], "metric", name)

    return measured(primary, "primary").join(measured(challenger, "challenger"), [by, "metric"]).withColumn("difference", F.col("challenger") - F.col("primary"))


def quantile_summary(table: DataFrame, columns: list[str], points: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """column, quantile, value."""
    found = quantiles_of(table, {c: F.col(c) for c in columns}, {c: list(points) for c in columns})
    rows = [(c, p, q) for c in columns for p, q in zip(points, found[c], strict=True)]
    return table.sparkSession.createDataFrame(rows, "column string, quantile double, value double")


def rolling_residuals(table: DataFrame, period: Column, target: str, score: str, width: int = 3) -> DataFrame:
    """period, n, residual and its mean over the last `width` periods (one row per period before the window)."""
    held = table.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.avg(F.col(target) - F.col(score)).alias("residual"))
    return held.withColumn("rolling", F.avg("residual").over(Window.orderBy("period").rowsBetween(1 - width, 0)))


def stratified_folds(table: DataFrame, key: str, target: str, k: int, multiplier: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """The rows of each class dealt in turn to k folds, in a reproducible shuffle of a unique integer key."""
    mixed, place = free_name("mixed__", table.columns), free_name("place__", table.columns)
    ranked = global_rank(table.withColumn(mixed, F.pmod(F.col(key) * multiplier, F.lit(modulus))), [mixed, key], place, (target,))
    return ranked.withColumn("fold", F.pmod(F.col(place) - 1, F.lit(k)).cast("int")).drop(mixed, place, f"{place}_n")


def expanding_folds(table: DataFrame, order: list[str], k: int) -> DataFrame:
    """fold 0..k: equal blocks in time order; fold f is tested on a model of all blocks before it."""
    place = free_name("place__", table.columns)
    ranked = global_rank(table, order, place)
    return ranked.withColumn("block", F.floor((F.col(place) - 1) * (k + 1) / F.col(f"{place}_n")).cast("int")).drop(place, f"{place}_n")


def banded_dependence(table: DataFrame, columns: list[str], feature: str, grid: list[float], score, z: float = 1.96) -> DataFrame:
    """value, mean_score and a confidence band of the mean, by grid point."""
    from gritstone.operators.explain import inputs

    scores = [score(inputs(columns, **{feature: F.lit(g)})) for g in grid]
    row = table.agg(F.count("*").alias("n"), *(f(s).alias(f"{n}{k}") for k, s in enumerate(scores) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    half = lambda k: z * F.col(f"s{k}") / F.sqrt("n")
    each = (F.struct(F.lit(g).alias("value"), F.col(f"m{k}").alias("mean_score"), (F.col(f"m{k}") - half(k)).alias("low"), (F.col(f"m{k}") + half(k)).alias("high")) for k, g in enumerate(grid))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def monotonicity(curve: DataFrame, value: str = "value", score: str = "mean_score") -> DataFrame:
    """steps, how many rise and fall, and the direction if all go one way; curve: one row per grid point."""
    move = F.col(score) - F.lag(score).over(Window.orderBy(value))
    held = curve.select(move.alias("d")).agg(F.count("d").alias("steps"), F.sum((F.col("d") > 0).cast("bigint")).alias("rises"), F.sum((F.col("d") < 0).cast("bigint")).alias("falls"))
    return held.withColumn("direction", F.when(F.col("falls") == 0, "increasing").when(F.col("rises") == 0, "decreasing").otherwise("mixed"))


def cusum(series: DataFrame, order: str, value: str) -> DataFrame:
    """The largest absolute running sum of deviations from the mean, over s * sqrt(n); one row per period."""
    row = series.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n")).first()
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = series.select(F.abs(F.sum(F.col(value) - F.lit(row["m"])).over(upto)).alias("d"))
    scale = row["s"] * math.sqrt(row["n"]) if row["s"] else None
    return held.agg(F.count("*").alias("n"), (F.max("d") / F.lit(scale)).alias("statistic"))


def augmented_dickey_fuller(series: DataFrame, order: str, value: str, lags: int = 1) -> DataFrame:
    """The t statistic of the level in a regression of changes on a constant, the level and lagged changes; one row per period."""
    own, y = Window.orderBy(order), F.col(value)
    step = series.select(order, F.lag(y).over(own).alias("level"), (y - F.lag(y).over(own)).alias("change"))
    held = step.select("level", "change", *(F.lag("change", k).over(own).alias(f"change_{k}") for k in range(1, lags + 1))).na.drop()
    features = ["level", *(f"change_{k}" for k in range(1, lags + 1))]
    g, v, yy, n = gram(held, features, F.col("change"))
    b = np.linalg.solve(g, v)
    se = math.sqrt(max(yy - b @ v, 0.0) / (n - len(b)) * np.linalg.inv(g)[1, 1])
    return series.sparkSession.createDataFrame([(n, float(b[1]), float(b[1] / se))], "n bigint, coefficient double, statistic double")


def correlation_filter(matrix: np.ndarray, columns: list[str], strength: dict[str, float], threshold: float) -> list[tuple[str, str | None]]:
    """(column, what it is dropped for) in the order of strength: a column goes if a stronger kept one correlates with it."""
    at, kept, out = {c: k for k, c in enumerate(columns)}, [], []
    for c in sorted(columns, key=lambda c: (-strength[c], c)):
        rival = next((o for o in kept if abs(matrix[at[c], at[o]]) >= threshold), None)
        if rival is None:
            kept.append(c)
        out.append((c, rival))
    return out


def platt(table: DataFrame, target: str, score: str, floor: float = 1e-6) -> tuple[float, float, Column]:
    """Intercept and slope of a logistic regression on the score's logit, and the calibrated score."""
    from gritstone.operators.models import iteratively_reweighted

    p = clipped_between(score, floor, 1 - floor)
    logit = F.log(p / (1 - p))
    model = iteratively_reweighted(table.select(logit.alias("logit"), target), ["logit"], target)
    a, b = map(float, model.coefficients)
    return a, b, 1 / (1 + F.exp(-(a + b * logit)))


def pooled_steps(rows: Iterable[tuple[float, float, float]]) -> list[list[float]]:
    """(least score, rows, events) in order of the score, adjacent ones joined until the rates rise."""
    steps: list[list[float]] = []
    for score, n, events in rows:
        steps.append([score, n, events])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, n, events = steps.pop()
            steps[-1][1] += n
            steps[-1][2] += events
    return steps


def isotonic(table: DataFrame, target: str, score: str) -> list[tuple[float, float]]:
    """(least score, rate) of the steps of the best non-decreasing fit.

    Scores are counted, then pooled within ranges of the score in tasks of their own; what a range pools stays pooled
    over all, so the driver pools only the ranges' steps, of which a rising curve has far fewer than scores.
    """
    counts = table.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(target).cast("double")).alias("events"))
    ranges = range_count(table)
    cuts = counts.select(F.percentile_approx("s", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 10_000).alias("c")).first()["c"]
    placed = counts.withColumn("at", count_below(F.col("s"), sorted(set(cuts or ()))))

    def pool(held: pa.Table) -> pa.Table:
        held = held.sort_by("s")
        steps = pooled_steps(zip(*(held.column(c).to_pylist() for c in ("s", "n", "events")), strict=True))
        return pa.table([pa.array([x[k] for x in steps], pa.float64()) for k in range(3)], names=["s", "n", "events"])

    rows = placed.groupBy("at").applyInArrow(pool, "s double, n double, events double").orderBy("s").collect()
    return [(s, e / n) for s, n, e in pooled_steps(tuple(r) for r in rows)]
