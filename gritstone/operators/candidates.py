"""Tables about sets of candidate features and about fits over folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.operators.diagnostics import correlations
from gritstone.operators.robustness import segment_moments


def frontier(candidates: DataFrame, size: str = "size", value: str = "bic", name: str = "subset", lower_is_better: bool = True) -> DataFrame:
    """The best candidate of each size, ties by name."""
    best = F.asc(value) if lower_is_better else F.desc(value)
    place = F.row_number().over(Window.partitionBy(size).orderBy(best, name))
    return candidates.withColumn("place__", place).where("place__ = 1").drop("place__")


def feature_frequency(candidates: DataFrame, top: int, rank: str = "rank", name: str = "subset") -> DataFrame:
    """feature, how many of the `top` candidates have it, and their share."""
    best = candidates.where(F.col(rank) <= top)
    n = best.count()
    held = best.select(F.explode(F.split(name, ",")).alias("feature")).groupBy("feature").agg(F.count("*").alias("selected"))
    return held.withColumn("share", F.col("selected") / F.lit(max(n, 1)))


def redundancy(table: DataFrame, candidates: DataFrame, features: list[str], top: int, near: float = 0.7, high: float = 0.85, rank: str = "rank", name: str = "subset") -> DataFrame:
    """left, right, r, together (in how many of the `top` candidates both are) and risk, of pairs with |r| >= near that meet there."""
    sets = [set(r[0].split(",")) for r in candidates.where(F.col(rank) <= top).select(name).collect()]
    rows = []
    for r in correlations(table, features).collect():
        together = sum({r["left"], r["right"]} <= s for s in sets)
        if r["r"] is not None and abs(r["r"]) >= near and together:
            rows.append((r["left"], r["right"], float(r["r"]), together, "high" if abs(r["r"]) >= high else "moderate"))
    return table.sparkSession.createDataFrame(rows, "left string, right string, r double, together int, risk string")


def fold_fits(table: DataFrame, features: list[str], target: str, fold: str) -> DataFrame:
    """fold, term and coefficient of least squares on the rows of all other folds; the moments of every fold come from one
    grouped aggregate, and those of the others are the whole less them."""
    found = segment_moments(table, fold, features, target)
    whole = sum(m for _, m in found.values())
    rows = []
    for k, (_, m) in found.items():
        rest = whole - m
        b = np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0]
        rows += [(str(k), c, float(v)) for c, v in zip(["intercept", *features], b, strict=True)]
    return table.sparkSession.createDataFrame(rows, "fold string, term string, coefficient double")


def consistency(fits: DataFrame) -> DataFrame:
    """term, folds, mean, std, mean absolute coefficient, and the share of the commoner sign among those that are not 0."""
    b = F.col("coefficient")
    signs, up = F.sum((b != 0).cast("int")), F.sum((b > 0).cast("int"))
    share = F.when(signs > 0, F.greatest(up, signs - up) / signs).otherwise(0.0)
    return fits.groupBy("term").agg(F.count("*").alias("folds"), F.avg(b).alias("mean"), F.stddev_samp(b).alias("std"), F.avg(F.abs(b)).alias("mean_absolute"), share.alias("sign_share"))


def candidate_stability(base: DataFrame, by_group: DataFrame, key: str, value: str) -> DataFrame:
    """base (one row per candidate) with how the value varies over the groups of by_group: groups, least, greatest, spread."""
    held = by_group.groupBy(key).agg(F.count(value).alias("groups"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.stddev_pop(value).alias("spread"))
    return base.join(held, key, "left")


def with_risk_counts(base: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """base with `risks`, how many rows flags has for its key, and their names in order, joined by commas."""
    held = flags.groupBy(key).agg(F.count("*").alias("risks"), F.array_join(F.array_sort(F.collect_set("risk")), ",").alias("risk_names"))
    return base.join(held, key, "left").na.fill(0, ["risks"]).na.fill("", ["risk_names"])


def scorecard_summary(evidence: DataFrame, edges: dict[str, list[float] | None]) -> DataFrame:
    """feature, bins, iv, largest share, span of the weights, and their trend over the bins of a number.

    evidence: feature, bucket, total, woe, iv, a few rows per feature.
    """
    numbered = [f for f, e in edges.items() if e is not None]
    place = F.when(F.col("feature").isin(numbered), F.col("bucket").try_cast("int"))
    step = F.col("woe") - F.lag("woe").over(Window.partitionBy("feature").orderBy(place.asc_nulls_first(), "bucket"))
    before = F.lag(place).over(Window.partitionBy("feature").orderBy(place.asc_nulls_first(), "bucket"))
    held = evidence.withColumn("step", F.when(place.isNotNull() & before.isNotNull(), step))
    rises, falls = F.sum((F.col("step") > 0).cast("int")), F.sum((F.col("step") < 0).cast("int"))
    trend = F.when(F.count("step") == 0, "none").when(falls == 0, "increasing").when(rises == 0, "decreasing").otherwise("mixed")
    return held.groupBy("feature").agg(F.count("*").alias("bins"), F.sum("iv").alias("iv"), (F.max("total") / F.sum("total")).alias("largest_share"), (F.max("woe") - F.min("woe")).alias("woe_span"), trend.alias("trend"))


def reason_frequency(scored: DataFrame, reasons: str = "reasons") -> DataFrame:
    """place, reason, n and share of each reason at each place."""
    held = scored.select(F.posexplode(reasons).alias("place", "reason")).groupBy((F.col("place") + 1).alias("place"), "reason").agg(F.count("*").alias("n"))
    return held.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("place")))
