"""Shapes of columns: normality from moments, categories, covariances, missing values against the target, residuals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.distributions import chi2_sf
from gritstone.functions.scalars import category
from gritstone.operators.ranges import free_name


def skewness_z(g1: float, n: int) -> float:
    """D'Agostino's normal deviate of a sample skewness."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = math.sqrt(2 * (b - 1)) - 1
    return math.asinh(y / math.sqrt(2 / (w - 1))) / math.sqrt(0.5 * math.log(w))


def kurtosis_z(g2: float, n: int) -> float:
    """Anscombe and Glynn's normal deviate of a sample excess kurtosis."""
    mean = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(variance)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    inner = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    return (1 - 2 / (9 * a) - math.copysign(abs(inner) ** (1 / 3), inner)) / math.sqrt(2 / (9 * a))


def normality(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, skewness, excess kurtosis, K^2 and its p-value (null below 8 values or without spread); one aggregate."""
    row = table.agg(*(f(F.col(c).cast("double")).alias(f"{k}{j}") for j, c in enumerate(columns) for k, f in (("n", F.count), ("v", F.var_pop), ("s", F.skewness), ("k", F.kurtosis)))).first()
    out = []
    for j, c in enumerate(columns):
        n, spread, s, k = (row[f"{x}{j}"] for x in "nvsk")
        if n < 8 or not spread:
            out.append((c, n, None, None, None, None))
            continue
        statistic = skewness_z(s, n) ** 2 + kurtosis_z(k, n) ** 2
        out.append((c, n, float(s), float(k), float(statistic), chi2_sf(statistic, 2)))
    return table.sparkSession.createDataFrame(out, "`column` string, n bigint, skewness double, kurtosis double, statistic double, p_value double")


def describe_categories(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n (values), distinct values, the most frequent one (ties by name) and how often it occurs."""
    rows = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*").where("v IS NOT NULL")
    counts = rows.groupBy("column", "v").agg(F.count("*").alias("n"))
    most = F.max_by("v", F.struct("n", "other"))
    # of equal counts the least name: the greatest of its place from the end
    place = F.row_number().over(Window.partitionBy("column", "n").orderBy(F.desc("v")))
    held = counts.withColumn("other", place).groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"), most.alias("top"), F.max("n").alias("frequency"))
    empty = table.sparkSession.createDataFrame([(c,) for c in columns], "`column` string")
    return empty.join(held, "column", "left").na.fill(0, ["n", "distinct_values", "frequency"])


def covariances(table: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, n and the sample covariance of every pair, each column with itself too, over the rows that have both."""
    x = {c: F.col(c).cast("double") for c in columns}
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = table.agg(*(e for k, (a, b) in enumerate(pairs) for e in (F.count(F.when(x[a].isNotNull() & x[b].isNotNull(), 1)).alias(f"n{k}"), F.covar_samp(x[a], x[b]).alias(f"c{k}"))))
    each = (F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"n{k}").alias("n"), F.when(F.col(f"n{k}") > 1, F.col(f"c{k}")).alias("covariance")) for k, (a, b) in enumerate(pairs))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def missing_association(table: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, rates of events with and without a value, their difference, |r| of missing with the target, and the p-value of
    the fourfold table with Yates' correction; null where either is constant. One aggregate."""
    y = F.col(target).cast("double")
    known = table.where(y.isNotNull())
    cells = []
    for k, c in enumerate(columns):
        gone = F.col(c).isNull()
        cells += [F.sum((gone & (y == v)).cast("bigint")).alias(f"{name}{k}") for name, v in (("g1_", 1), ("g0_", 0))] + [F.sum((~gone & (y == v)).cast("bigint")).alias(f"{name}{k}") for name, v in (("h1_", 1), ("h0_", 0))]
    row = known.agg(*cells).first()
    out = []
    for k, c in enumerate(columns):
        a, b, d, e = (row[f"{x}{k}"] or 0 for x in ("g1_", "g0_", "h1_", "h0_"))
        n, product = a + b + d + e, (a + b) * (d + e) * (a + d) * (b + e)
        gone, held = (a / (a + b) if a + b else None), (d / (d + e) if d + e else None)
        if not product:
            out.append((c, gone, held, None, None, None))
            continue
        cross = a * e - b * d
        statistic = n * max(abs(cross) - min(n / 2, abs(cross)), 0) ** 2 / product
        out.append((c, gone, held, gone - held, abs(cross) / math.sqrt(product), chi2_sf(statistic, 1)))
    return table.sparkSession.createDataFrame(out, "`column` string, rate_missing double, rate_present double, difference double, relation double, p_value double")


def segment_bias(table: DataFrame, segment: str, target: str, score: str, least: int = 1) -> DataFrame:
    """segment, n, mean residual, its standard error and z, of segments with `least` rows or more; a gap is a segment."""
    e = F.col(target) - F.col(score)
    held = table.groupBy(category(segment).alias("segment")).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("s")).where(F.col("n") >= least)
    error = F.col("s") / F.sqrt("n")
    return held.select("segment", "n", "bias", error.alias("std_error"), F.when(error > 0, F.col("bias") / error).alias("z"))


def date_parts(column: str, parts: tuple[str, ...] = ("year", "month", "quarter", "day", "dayofweek")) -> dict[str, Column]:
    """`<column>_<part>` for each part; days of the week count from Monday, 0."""
    x = F.col(column)
    made = {"year": F.year(x), "month": F.month(x), "quarter": F.quarter(x), "day": F.dayofmonth(x), "dayofweek": F.weekday(x)}
    return {f"{column}_{p}": made[p] for p in parts}


def period_terms(entity: list[str], order: list[str], output: str = "period") -> dict[str, Column]:
    """A row's 1-based place among its entity's rows, and its square."""
    place = F.row_number().over(Window.partitionBy(*entity).orderBy(*order)).cast("double")
    return {output: place, f"{output}_squared": place * place}


def rows_since(table: DataFrame, event: Column, entity: list[str], order: list[str], output: str) -> DataFrame:
    """The table with how many rows ago the entity's last event was (0: this row); null before the first."""
    place, own = free_name("place__", table.columns), Window.partitionBy(*entity).orderBy(*order)
    last = F.last(F.when(event, F.col(place)), True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn(place, F.row_number().over(own)).withColumn(output, F.col(place) - last).drop(place)
