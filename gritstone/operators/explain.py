"""How a score reacts: partial dependence, single-row curves, accumulated effects, margins, scenarios, permutation.

A score is a function from a mapping of columns to an expression, so a changed input is only another expression; grids are
exploded literals, a few rows each, and never joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.operators.binning import quantile_edges
from gritstone.operators.quantiles import exact_quantiles
from gritstone.operators.ranges import free_name
from gritstone.sources.scratch import checkpointed

Score = Callable[[dict[str, Column]], Column]


def inputs(columns: list[str], **changed: Column) -> dict[str, Column]:
    return {c: F.col(c) for c in columns} | changed


def quantile_grid(table: DataFrame, feature: str, points: int = 5, low: float = 0.05, high: float = 0.95) -> list[float]:
    at = [low + (high - low) * k / (points - 1) for k in range(points)]
    return sorted({q for q in exact_quantiles(table, feature, at) if q is not None})


def partial_dependence(table: DataFrame, columns: list[str], feature: str, grid: list[float], score: Score, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value, mean_score: one pass, an aggregate per grid point."""
    held = table.groupBy(*by).agg(*(F.avg(score(inputs(columns, **{feature: F.lit(g)}))).alias(f"g{k}") for k, g in enumerate(grid)))
    return held.select(*by, F.explode(F.array(*(F.struct(F.lit(g).alias("value"), F.col(f"g{k}").alias("mean_score")) for k, g in enumerate(grid)))).alias("x")).select(*by, "x.*")


def individual_curves(table: DataFrame, columns: list[str], key: str, feature: str, grid: list[float], score: Score) -> DataFrame:
    """key, value, score and its difference from the first grid point, for every row given."""
    each = [F.struct(F.lit(g).alias("value"), score(inputs(columns, **{feature: F.lit(g)})).alias("score")) for g in grid]
    held = table.select(key, F.array(*each).alias("curve"))
    return held.select(key, F.explode("curve").alias("x"), F.get("curve", F.lit(0))["score"].alias("first")).select(key, "x.value", "x.score", (F.col("x.score") - F.col("first")).alias("centred"))


def two_way(table: DataFrame, columns: list[str], a: str, b: str, grid_a: list[float], grid_b: list[float], score: Score) -> DataFrame:
    cells = [(x, y) for x in grid_a for y in grid_b]
    held = table.agg(*(F.avg(score(inputs(columns, **{a: F.lit(x), b: F.lit(y)}))).alias(f"c{k}") for k, (x, y) in enumerate(cells)))
    return held.select(F.explode(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{k}").alias("mean_score")) for k, (x, y) in enumerate(cells)))).alias("x")).select("x.*")


def accumulated_effects(table: DataFrame, columns: list[str], feature: str, bins: int, score: Score) -> DataFrame:
    """Mean score difference across each quantile interval, accumulated."""
    low, high = table.agg(F.min(F.col(feature).cast("double")), F.max(F.col(feature).cast("double"))).first()
    edges = [low, *quantile_edges(table, feature, bins), high]
    at = F.least(F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(feature))), F.lit(1)), F.lit(len(edges) - 1))
    left, right = F.get(F.array(*map(F.lit, edges)), at - 1), F.get(F.array(*map(F.lit, edges)), at)
    change = score(inputs(columns, **{feature: right})) - score(inputs(columns, **{feature: left}))
    held = table.where(F.col(feature).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(change).alias("effect"))
    return held.withColumn("accumulated", F.sum("effect").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def marginal_effect(table: DataFrame, columns: list[str], feature: str, step: float, score: Score) -> DataFrame:
    up, down = (score(inputs(columns, **{feature: F.col(feature) + d})) for d in (step, -step))
    return table.agg(F.avg((up - down) / (2 * step)).alias("effect"), F.count(feature).alias("n"))


def scenario(table: DataFrame, columns: list[str], shocks: dict[str, tuple[str, float]], score: Score, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean score before and after shocks (add, multiply or set), and the mean change."""
    moved = {c: {"add": F.col(c) + v, "multiply": F.col(c) * v, "set": F.lit(v)}[op] for c, (op, v) in shocks.items()}
    base, shocked = score(inputs(columns)), score(inputs(columns, **moved))
    return table.groupBy(*by).agg(F.count("*").alias("n"), F.avg(base).alias("base"), F.avg(shocked).alias("shocked"), F.avg(shocked - base).alias("change"))


def permuted_together(table: DataFrame, key: str, features: list[str], multiplier: int = 7919, modulus: int = 1_000_003) -> tuple[DataFrame, dict[str, str]]:
    """The table with a column beside each feature, and its name, that holds the feature's values dealt anew: those in key
    order go to the rows in a shuffled order. All features are dealt by one pair of ranks and one join."""
    from gritstone.operators.splits import global_rank

    a, b, mixed = (free_name(c, table.columns) for c in ("a__", "b__", "mixed__"))
    names = {f: free_name(f"dealt{k}__", table.columns) for k, f in enumerate(features)}
    values = global_rank(table.select(key, *(F.col(f).alias(names[f]) for f in features)), [key], a).select(F.col(a).alias(b), *names.values())
    ranked = global_rank(table.withColumn(mixed, F.pmod(F.col(key) * multiplier, F.lit(modulus))), [mixed, key], b).drop(f"{b}_n", mixed)
    return ranked.join(values, b).drop(b), names


def permuted(table: DataFrame, key: str, feature: str, multiplier: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """The table with one column dealt anew."""
    held, names = permuted_together(table, key, [feature], multiplier, modulus)
    return held.withColumn(feature, F.col(names[feature])).drop(names[feature])


def permutation_importance(table: DataFrame, columns: list[str], features: list[str], key: str, target: str, score: Score, by: tuple[str, ...] = ()) -> DataFrame:
    """by, feature and how much the rank metrics lose when the feature's values are dealt anew: base less permuted.

    Every row is scored once as it is and once per feature, and all these scores are ranked together, by number of the feature.
    """
    from gritstone.operators.metrics import rank_metrics

    names = ("auc", "ks", "average_precision")
    held, dealt = permuted_together(table.select(*dict.fromkeys((key, target, *columns, *features, *by))), key, features)
    which, scored, x = (free_name(c, held.columns) for c in ("which__", "score__", "x__"))
    cases = [inputs(columns), *(inputs(columns, **{f: F.col(dealt[f])}) for f in features)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias(which), score(c).alias(scored)) for k, c in enumerate(cases)))).alias(x)
    # ranking reads the scores several times; kept, they cost the ranks and the join once
    scores = checkpointed(held.select(target, *by, each).select(target, *by, f"{x}.{which}", f"{x}.{scored}"))
    found = rank_metrics(scores, target, scored, (*by, which))
    # a row per group and feature
    base = found.where(F.col(which) == 0).select(*(F.col(c).alias(f"{c}__base") for c in by), *(F.col(c).alias(f"base_{c}") for c in names))
    meets = F.lit(True)
    for c in by:
        meets = meets & (F.col(c) == F.col(f"{c}__base"))
    label = F.get(F.array(*map(F.lit, features)), F.col(which) - 1)
    return found.where(F.col(which) > 0).join(base, meets).select(*by, label.alias("feature"), *((F.col(f"base_{c}") - F.col(c)).alias(c) for c in names))
