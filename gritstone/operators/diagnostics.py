"""Descriptions of data: moments, missingness, correlation, dependency, outliers, suitability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import correlation, divided
from gritstone.operators.quantiles import quantiles_of
from gritstone.operators.splits import global_rank
from gritstone.operators.transforms import inverse_normal


def _long(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    each = (F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{f}").alias(f) for f in fields)) for c in columns)
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def describe(table: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max per column; quartiles by ranges of the values."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = table.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in columns for k, f in stats.items()))
    quartiles = quantiles_of(table, {c: F.col(c) for c in columns}, {c: [0.25, 0.5, 0.75] for c in columns})
    at = F.create_map(*(x for c in columns for x in (F.lit(c), F.array(*(F.lit(q).cast("double") for q in quartiles[c])))))
    held = _long(row, columns, list(stats))
    return held.select("column", "n", "mean", "std", "min", *(F.get(at[F.col("column")], F.lit(k)).alias(p) for k, p in enumerate(("p25", "p50", "p75"))), "max")


def moments(table: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis beside n, mean and the population deviation."""
    row = table.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in columns for k, f in {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "g1": F.skewness, "g2": F.kurtosis}.items()))
    held, n = _long(row, columns, ["n", "mean", "std", "g1", "g2"]), F.col("n").cast("double")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return held.select("column", "n", "mean", "std", skew.alias("skewness"), kurtosis.alias("kurtosis"))


def missingness(table: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Missing count and share, and the target's mean with and without the value."""
    gone = lambda c: F.col(c).isNull()
    row = table.agg(*(e for c in columns for e in (F.count("*").alias(f"{c}__n"), F.sum(gone(c).cast("bigint")).alias(f"{c}__missing"), F.avg(F.when(gone(c), F.col(target).cast("double"))).alias(f"{c}__rate_missing"), F.avg(F.when(~gone(c), F.col(target).cast("double"))).alias(f"{c}__rate_present"))))
    return _long(row, columns, ["n", "missing", "rate_missing", "rate_present"]).withColumn("share", F.col("missing") / F.col("n"))


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, r for all pairs, each over the rows that have both; one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = table.agg(*(correlation(a, b).alias(f"{a}__{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def correlation_matrix(table: DataFrame, columns: list[str]) -> np.ndarray:
    k, out = len(columns), np.eye(len(columns))
    at = {c: j for j, c in enumerate(columns)}
    for r in correlations(table, columns).collect() if k > 1 else []:
        out[at[r["left"]], at[r["right"]]] = out[at[r["right"]], at[r["left"]]] = r["r"] if r["r"] is not None else 0.0
    return out


def vif(table: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    held = np.linalg.pinv(correlation_matrix(table, columns))
    return table.sparkSession.createDataFrame([(c, float(held[k, k])) for k, c in enumerate(columns)], "column string, vif double")


def dependency(table: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """Condition index per direction and the cluster (first column) of columns linked by |r| >= threshold."""
    r = correlation_matrix(table, columns)
    values = np.sort(np.linalg.eigvalsh(r))[::-1]
    cluster = list(range(len(columns)))
    for _ in columns:
        for a in range(len(columns)):
            for b in range(len(columns)):
                if abs(r[a, b]) >= threshold:
                    cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    rows = [(c, columns[cluster[k]], float(np.sqrt(values[0] / max(values[k], 1e-12)))) for k, c in enumerate(columns)]
    return table.sparkSession.createDataFrame(rows, "column string, cluster string, condition_index double")


def outliers(table: DataFrame, key: str, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows at least `threshold` population deviations from the mean."""
    mean, std = table.agg(F.avg(column), F.stddev_pop(column)).first()
    return table.select(key, column, ((F.col(column) - F.lit(mean)) / F.lit(std)).alias("z")).where(F.abs("z") >= threshold) if std else table.select(key, column, F.lit(0.0).alias("z")).where("false")


def qq(table: DataFrame, key: str, residual: str) -> DataFrame:
    """The i-th residual in order beside the normal quantile of i / (n + 1)."""
    held = global_rank(table.select(key, residual), [residual, key], "place")
    return held.select("place", residual, inverse_normal(F.col("place") / (F.col("place_n") + 1.0)).alias("normal_quantile"))


def residual_summary(table: DataFrame, target: str, predicted: str) -> DataFrame:
    return describe(table.withColumn("residual", F.col(target) - F.col(predicted)), ["residual"])


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("n").alias("largest"))


def gaps(table: DataFrame, entity: str, date: str, tie: str) -> DataFrame:
    """Per entity the rows and the longest gap in days between neighbours."""
    own = Window.partitionBy(entity).orderBy(date, tie)
    held = table.withColumn("gap", F.datediff(F.col(date), F.lag(date).over(own)))
    return held.groupBy(entity).agg(F.count("*").alias("n"), F.max("gap").alias("max_gap"))


def suitability(table: DataFrame, target: str, features: int) -> DataFrame:
    return table.agg(F.count("*").alias("n"), F.sum(target).cast("bigint").alias("events")).select("n", "events", (F.col("events") / F.col("n")).alias("rate"), (F.col("events") / features).alias("events_per_feature"))


def cardinality(table: DataFrame, columns: list[str], limit: int = 500, ratio: float = 0.2) -> DataFrame:
    """distinct values and whether both limits are passed."""
    row = table.agg(*(e for c in columns for e in (F.count("*").alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__distinct"))))
    return _long(row, columns, ["n", "distinct"]).withColumn("too_many", (F.col("distinct") > limit) & (divided(F.col("distinct").cast("double"), F.col("n").cast("double")) > ratio))


def screening(table: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Advisory screen: missing share, sample variance and |r| with the target."""
    y = F.col(target).cast("double")
    row = table.agg(*(e for c in columns for e in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__missing"), F.var_samp(F.col(c).cast("double")).alias(f"{c}__variance"), F.abs(correlation(c, y)).alias(f"{c}__relation"))))
    held = _long(row, columns, ["missing", "variance", "relation"])
    return held.withColumn("status", F.when(F.col("missing") >= 0.95, "missing").when(F.col("variance") <= 1e-12, "constant").otherwise("keep"))
