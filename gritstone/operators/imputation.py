"""Filling missing values with statistics learned on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.operators.quantiles import quantiles_of
from gritstone.operators.ranges import free_name

#: Aggregates of a column; a group's median keeps the group's distinct values in one buffer, that of a whole table is found by ranges.
STATISTICS = {"mean": lambda c: F.avg(c), "median": lambda c: F.percentile(F.col(c).cast("double"), F.lit(0.5)), "mode": lambda c: F.mode(c, True)}


def fit_fills(train: DataFrame, policies: dict[str, tuple[str, object]]) -> dict[str, object]:
    """column -> fill; policies: column -> (mean, median, mode or constant, the constant). Medians by ranges of the values, the rest by one aggregate."""
    learned = {c: STATISTICS[p](c) for c, (p, _) in policies.items() if p in ("mean", "mode")}
    found = train.agg(*(a.alias(c) for c, a in learned.items())).first().asDict() if learned else {}
    middle = [c for c, (p, _) in policies.items() if p == "median"]
    found |= {c: q[0] for c, q in quantiles_of(train, {c: F.col(c) for c in middle}, {c: [0.5] for c in middle}).items()}
    return {c: found.get(c, value) for c, (_, value) in policies.items()}


def fill(table: DataFrame, fills: dict[str, object], indicators: bool = True) -> DataFrame:
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in fills} if indicators else {}
    return table.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def fill_by_group(table: DataFrame, train: DataFrame, column: str, groups: list[str], policy: str, fallback: object = None) -> DataFrame:
    """The group's training statistic, else the fallback, by default the statistic of all training rows; a null group is a group."""
    if fallback is None:
        fallback = fit_fills(train, {column: (policy, None)})[column]
    found = free_name("fill__", table.columns)
    names = {g: free_name(f"{g}__", table.columns, (found,)) for g in groups}
    stats = train.groupBy(*groups).agg(STATISTICS[policy](column).alias(found))
    stats = stats.select(*(F.col(g).alias(n) for g, n in names.items()), found)
    meets = F.lit(True)
    for g, n in names.items():
        meets = meets & F.col(g).eqNullSafe(F.col(n))
    return table.join(stats, meets, "left").withColumn(column, F.coalesce(column, found, F.lit(fallback))).drop(found, *names.values())


def carry(x: str, partition: list[str], order: list[str], forward: bool = True) -> Column:
    """The last known value before (or the next one after) a gap."""
    own = Window.partitionBy(*partition).orderBy(*order)
    if forward:
        return F.last(x, True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return F.first(x, True).over(own.rowsBetween(0, Window.unboundedFollowing))


def missing_by(table: DataFrame, columns: list[str], by: str) -> DataFrame:
    """by, column, n, missing, share: one aggregate, then long."""
    held = table.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns))
    return held.unpivot([by, "n"], columns, "column", "missing").withColumn("share", F.col("missing") / F.col("n"))
