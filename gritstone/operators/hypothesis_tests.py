"""Statistical tests: aggregates in Spark, distribution functions at the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.distributions import chi2_sf, f_sf, kolmogorov_sf, normal_sf, t_two_sided
from gritstone.functions.scalars import divided
from gritstone.operators.models import gram
from gritstone.operators.quantiles import running_shares


def mcnemar(table: DataFrame, first_right: Column, second_right: Column) -> DataFrame:
    """Discordant pairs, the continuity-corrected statistic and its p-value."""
    b, c = table.agg(F.sum((first_right & ~second_right).cast("bigint")), F.sum((~first_right & second_right).cast("bigint"))).first()
    statistic = (abs(b - c) - 1) ** 2 / (b + c) if b + c else 0.0
    return table.sparkSession.createDataFrame([(b, c, float(statistic), chi2_sf(statistic, 1))], "first_only bigint, second_only bigint, statistic double, p_value double")


def kolmogorov_smirnov(table: DataFrame, value: str, sample: Column) -> DataFrame:
    """Two-sample statistic and asymptotic p-value; sample is true for the first one. Values are counted first, and summed within ranges."""
    rows = table.select(F.col(value).alias("v"), sample.alias("first")).where("v IS NOT NULL AND first IS NOT NULL")
    held = rows.groupBy("v").agg(F.sum(F.col("first").cast("bigint")).alias("a"), F.sum((~F.col("first")).cast("bigint")).alias("b"))
    shares = running_shares(held, "v", ["a", "b"])
    share = lambda c: divided(F.col(f"{c}_upto").cast("double"), F.col(f"{c}_all").cast("double"))
    gap = shares.select(F.abs(share("a") - share("b")).alias("d"), F.col("a_all").alias("n"), F.col("b_all").alias("m"))
    d, n, m = gap.agg(F.max("d"), F.max("n"), F.max("m")).first()
    root = math.sqrt(n * m / (n + m)) if n and m else 0.0
    return table.sparkSession.createDataFrame([(d, n, m, kolmogorov_sf((root + 0.12 + 0.11 / root) * d) if root else None)], "statistic double, n bigint, m bigint, p_value double")


def delong(table: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """Paired comparison of two areas under the curve by mid-rank placements."""

    def placed(score: str, out: str) -> DataFrame:
        held = table.groupBy(score).agg(F.sum(target).cast("double").alias("p"), F.sum(1 - F.col(target)).cast("double").alias("q"))
        below = lambda c: (F.col(f"{c}_upto") - F.col(c) / 2) / F.col(f"{c}_all")
        return running_shares(held, score, ["p", "q"]).select(score, below("q").alias(f"{out}1"), (1 - below("p")).alias(f"{out}0"))

    both = table.select(target, a, b).join(placed(a, "u"), a).join(placed(b, "v"), b)
    value = lambda x: F.when(F.col(target) == 1, F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    rows = both.groupBy(target).agg(F.count("*").alias("n"), F.avg(value("u")).alias("a"), F.avg(value("v")).alias("b"), F.var_samp(value("u")).alias("aa"), F.var_samp(value("v")).alias("bb"), F.covar_samp(value("u"), value("v")).alias("ab")).collect()
    variance = sum((r["aa"] + r["bb"] - 2 * r["ab"]) / r["n"] for r in rows)
    auc = next((r["a"], r["b"]) for r in rows if r[target] == 1)
    z = (auc[0] - auc[1]) / math.sqrt(variance) if variance > 0 else 0.0
    return table.sparkSession.createDataFrame([(*auc, variance, z, 2 * normal_sf(abs(z)))], "auc_a double, auc_b double, variance double, z double, p_value double")


def durbin_watson(series: DataFrame, order: str, value: str) -> DataFrame:
    """series: one row per period, so that its length does not grow with the rows behind it."""
    own = Window.orderBy(order)
    e = F.col(value)
    return series.withColumn("d", e - F.lag(e).over(own)).agg((F.sum(F.col("d") * F.col("d")) / F.sum(e * e)).alias("durbin_watson"), F.count("*").alias("n"))


def ljung_box(series: DataFrame, order: str, value: str, lags: int = 4) -> DataFrame:
    own = Window.orderBy(order)
    mean = series.agg(F.avg(value)).first()[0]
    e = F.col(value) - mean
    held = series.select(e.alias("e"), *(F.lag(e, k).over(own).alias(f"e{k}") for k in range(1, lags + 1)))
    row = held.agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("s"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"s{k}") for k in range(1, lags + 1))).first()
    n = row["n"]
    q = n * (n + 2) * sum((row[f"s{k}"] / row["s"]) ** 2 / (n - k) for k in range(1, lags + 1))
    return series.sparkSession.createDataFrame([(n, q, chi2_sf(q, lags))], "n bigint, statistic double, p_value double")


def diebold_mariano(table: DataFrame, order: list[str], loss_difference: str, lags: int = 3) -> DataFrame:
    """Newey-West over at most three lags of the loss differential; fewer than 20 rows give no test."""
    own = Window.orderBy(*order)
    row = table.agg(F.avg(loss_difference).alias("m"), F.count("*").alias("n")).first()
    m, n = row["m"], row["n"]
    schema = "n bigint, mean_difference double, statistic double, p_value double"
    if n < 20:
        return table.sparkSession.createDataFrame([(n, m, None, None)], schema)
    d = F.col(loss_difference) - m
    held = table.select(d.alias("d"), *(F.lag(d, k).over(own).alias(f"d{k}") for k in range(1, lags + 1)))
    s = held.agg(F.avg(F.col("d") * F.col("d")), *((F.sum(F.col("d") * F.col(f"d{k}")) / n) for k in range(1, lags + 1))).first()
    variance = (s[0] + 2 * sum((1 - k / (lags + 1)) * s[k] for k in range(1, lags + 1))) / n
    z = m / math.sqrt(variance) if variance > 0 else 0.0
    return table.sparkSession.createDataFrame([(n, m, z, t_two_sided(z, n - 1))], schema)


def chow(table: DataFrame, features: list[str], target: str, before: Column) -> DataFrame:
    """Break test: F of separate fits on both sides against one fit."""
    import numpy as np

    def sse(part: DataFrame) -> tuple[float, int]:
        g, v, yy, n = gram(part, features, F.col(target).cast("double"))
        return yy - v @ np.linalg.solve(g, v), n

    (pooled, n), (a, _), (b, _) = sse(table), sse(table.where(before)), sse(table.where(~before))
    k = len(features) + 1
    f = ((pooled - a - b) / k) / ((a + b) / (n - 2 * k))
    return table.sparkSession.createDataFrame([(n, float(f), float(f_sf(f, k, n - 2 * k)))], "n bigint, statistic double, p_value double")


def breusch_pagan(table: DataFrame, features: list[str], squared_residual: str) -> DataFrame:
    """n R-squared of the squared residuals on the features."""
    import numpy as np

    g, v, yy, n = gram(table, features, F.col(squared_residual).cast("double"))
    explained = v @ np.linalg.solve(g, v)
    mean = v[0] / n
    lm = n * (explained - n * mean**2) / (yy - n * mean**2)
    return table.sparkSession.createDataFrame([(n, float(lm), float(chi2_sf(lm, len(features))))], "n bigint, statistic double, p_value double")
