"""How effects of a score hold up: centred accumulated effects, strength of interactions, spread over splits, resampled
bands, calibration by a feature's buckets, shocks by a feature's deviation, and other fills of a feature's gaps.

A score is a function from columns to an expression, as in `explain`; grids are a few constants.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import category
from gritstone.operators.explain import Score, accumulated_effects, inputs, partial_dependence, two_way
from gritstone.operators.metrics import rank_metrics
from gritstone.operators.quantiles import exact_quantiles
from gritstone.operators.ranges import count_below
from gritstone.operators.resampling import bootstrap_rows


def centred_effects(table: DataFrame, columns: list[str], feature: str, bins: int, score: Score) -> DataFrame:
    """bin, n, effect and `centred`: effects accumulated over the intervals, less the mean over them (one row per bin)."""
    held = accumulated_effects(table, columns, feature, bins, score)
    return held.select("bin", "n", "effect", (F.col("accumulated") - F.avg("accumulated").over(Window.partitionBy())).alias("centred"))


def interaction_strength(table: DataFrame, columns: list[str], pairs: list[tuple[str, str]], grids: dict[str, list[float]], score: Score) -> DataFrame:
    """a, b, mean and largest absolute, and mean signed departure of the two-way effect from the sum of both less the mean score."""
    base = float(table.agg(F.avg(score(inputs(columns)))).first()[0])
    alone = {c: {r["value"]: r["mean_score"] for r in partial_dependence(table, columns, c, grids[c], score).collect()} for c in dict.fromkeys(x for p in pairs for x in p)}
    rows = []
    for a, b in pairs:
        cells = two_way(table, columns, a, b, grids[a], grids[b], score).collect()
        left = [r["mean_score"] - (alone[a][r["a"]] + alone[b][r["b"]] - base) for r in cells]
        rows.append((a, b, float(np.mean(np.abs(left))), float(np.max(np.abs(left))), float(np.mean(left)), len(left)))
    return table.sparkSession.createDataFrame(rows, "a string, b string, mean_absolute double, largest_absolute double, mean_signed double, cells int")


def effect_stability(table: DataFrame, columns: list[str], feature: str, grid: list[float], score: Score, by: str = "split") -> DataFrame:
    """by, value, mean_score, and `spread`, the range of the means over the groups at that value."""
    held = partial_dependence(table, columns, feature, grid, score, (by,))
    own = Window.partitionBy("value")  # a row per group and grid point
    return held.withColumn("spread", F.max("mean_score").over(own) - F.min("mean_score").over(own))


def resampled_bands(table: DataFrame, columns: list[str], key: str, feature: str, grid: list[float], score: Score, replicates: int = 50, low: float = 0.05, high: float = 0.95, seed: int = 42) -> DataFrame:
    """value, mean_score, and the `low` and `high` quantiles of the mean over resampled rows (drawn with replacement, as
    many as there are). One aggregate per replicate and grid point; the driver sees these means."""
    scores = [score(inputs(columns, **{feature: F.lit(g)})).alias(f"g{k}") for k, g in enumerate(grid)]
    scored = table.select(key, *scores)
    means = scored.agg(*(F.avg(f"g{k}").alias(f"g{k}") for k in range(len(grid)))).first()
    drawn = bootstrap_rows(scored, key, replicates, seed=seed)
    rows = drawn.groupBy("replicate").agg(*((F.sum(F.col(f"g{k}") * F.col("times")) / F.sum(F.when(F.col(f"g{k}").isNotNull(), F.col("times")))).alias(f"g{k}") for k in range(len(grid)))).collect()
    out = []
    for k, g in enumerate(grid):
        held = [r[f"g{k}"] for r in rows if r[f"g{k}"] is not None]
        ends = np.quantile(held, [low, high]).tolist() if held else [None, None]
        out.append((float(g), means[f"g{k}"], *ends))
    return table.sparkSession.createDataFrame(out, "value double, mean_score double, low double, high double")


def bucket(table: DataFrame, feature: str, buckets: int = 10, levels: int = 10) -> Column:
    """A label of a feature's value: the number of its quantile bucket, or its level if it is among the most frequent."""
    if dict(table.dtypes)[feature] == "string":
        top = [r["level"] for r in table.groupBy(category(feature).alias("level")).count().orderBy(F.desc("count"), "level").limit(levels).collect()]
        return F.when(category(feature).isin(top), category(feature)).otherwise("Other")
    edges = sorted({q for q in exact_quantiles(table, feature, [k / buckets for k in range(buckets + 1)]) if q is not None})[1:-1]
    return F.when(F.col(feature).isNotNull(), count_below(F.col(feature).cast("double"), edges).cast("string")).otherwise("Missing")


def effect_calibration(table: DataFrame, features: list[str], target: str, score: str, buckets: int = 10, levels: int = 10) -> DataFrame:
    """feature, bucket, n, mean score, mean target and their gap."""
    out = None
    for c in features:
        held = table.where(F.col(target).isNotNull() & F.col(score).isNotNull()).groupBy(F.lit(c).alias("feature"), bucket(table, c, buckets, levels).alias("bucket"))
        one = held.agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("mean_target"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("gap", F.col("mean_target") - F.col("mean_score"))


def deviation_shocks(table: DataFrame, columns: list[str], features: list[str], score: Score, times: float = 1.0) -> DataFrame:
    """feature, shock (`times` population deviations), mean score before and after, and the change; constant features are left out."""
    spread = table.agg(*(F.stddev_pop(F.col(c).cast("double")).alias(c) for c in features)).first()
    shocks = {c: spread[c] * times for c in features if spread[c]}
    row = table.agg(F.avg(score(inputs(columns))).alias("base"), *(F.avg(score(inputs(columns, **{c: F.col(c) + s}))).alias(f"s{k}") for k, (c, s) in enumerate(shocks.items()))).first()
    rows = [(c, float(s), row["base"], row[f"s{k}"], row[f"s{k}"] - row["base"]) for k, (c, s) in enumerate(shocks.items())]
    return table.sparkSession.createDataFrame(rows, "feature string, shock double, base double, shocked double, change double")


def imputation_sensitivity(table: DataFrame, columns: list[str], feature: str, fills: dict[str, float], primary: str, target: str, score: Score) -> DataFrame:
    """policy, fill, mean, mean absolute and largest change of the score against the primary policy, and the change of the
    AUC, when the feature's gaps are filled otherwise; most material first."""
    filled = lambda v: score(inputs(columns, **{feature: F.coalesce(F.col(feature), F.lit(float(v)))}))
    names = list(fills)
    held = table.select(target, *(filled(fills[p]).alias(f"p{k}") for k, p in enumerate(names)))
    first = names.index(primary)
    auc = {k: rank_metrics(held, target, f"p{k}").first()["auc"] for k in range(len(names))}
    others = [k for k in range(len(names)) if k != first]
    moved = [F.col(f"p{k}") - F.col(f"p{first}") for k in others]
    row = held.agg(*(f.alias(f"{n}{j}") for j, d in enumerate(moved) for n, f in (("m", F.avg(d)), ("a", F.avg(F.abs(d))), ("x", F.max(F.abs(d)))))).first()
    rows = [(names[k], float(fills[names[k]]), row[f"m{j}"], row[f"a{j}"], row[f"x{j}"], auc[k] - auc[first]) for j, k in enumerate(others)]
    rows.sort(key=lambda r: (-(r[3] or 0.0), r[0]))
    return table.sparkSession.createDataFrame(rows, "policy string, fill double, mean_change double, mean_absolute double, largest_absolute double, auc_change double")
