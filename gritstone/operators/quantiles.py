"""Exact quantiles and running shares without one task or one buffer for all values of a column."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.operators.ranges import constants, count_below, free_name, range_count


def _cuts(found: list[float] | None) -> list[float]:
    return sorted({c for c in found or () if c == c})


def _points(ranges: int) -> Column:
    return F.array(*(F.lit(k / ranges) for k in range(1, ranges)))


def quantiles_of(table: DataFrame, values: dict[str, Column], wanted: dict[str, list[float]], ranges: int | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, as F.percentile gives them; None where there is no value.

    The source is read once: distinct values are counted and kept, then ranked within ranges of each column. The driver
    sees the ranges' sizes, and of the values the ones at the wanted ranks.
    """
    columns, ranges = list(values), ranges or range_count(table)
    if not columns:
        return {}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), values[c].cast("double").alias("v")) for k, c in enumerate(columns))))
    counts = table.select(pairs.alias("x")).select("x.c", "x.v").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n")).persist()
    choose = lambda each: F.coalesce(*(F.when(F.col("c") == k, x) for k, x in each.items())) if each else F.lit(0)
    try:
        cuts = {r["c"]: _cuts(r["cuts"]) for r in counts.groupBy("c").agg(F.percentile_approx("v", _points(ranges), 10_000).alias("cuts")).collect()}
        placed = counts.withColumn("range", choose({k: count_below(F.col("v"), held) for k, held in cuts.items()}))
        sizes = {(r["c"], r["range"]): r["n"] for r in placed.groupBy("c", "range").agg(F.sum("n").alias("n")).collect()}
        ranks, before, total = {}, {}, {}
        for k, c in enumerate(columns):
            seen, before[k] = 0, []
            for j in range(len(cuts.get(k, ())) + 1):
                before[k].append(seen)
                seen += sizes.get((k, j), 0)
            total[k] = seen
            ranks[k] = sorted({t for p in wanted[c] for t in (math.floor((seen - 1) * p), math.ceil((seen - 1) * p))}) if seen else []
        # only ranges that hold a wanted rank are sorted; of them only the rows that stand at one are sent
        held = {k: [j for j, start in enumerate(before[k]) if bisect_left(ranks[k], start) < bisect_left(ranks[k], start + sizes.get((k, j), 0))] for k in before}
        asked = F.lit(False)
        for k, own in held.items():
            asked = asked | ((F.col("c") == k) & F.col("range").isin(own)) if own else asked
        upto = F.sum("n").over(Window.partitionBy("c", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        start = choose({k: F.get(F.array(*map(F.lit, b)), F.col("range")) for k, b in before.items()})
        ends = placed.where(asked).withColumn("upto", upto + start)
        # the first wanted rank from where a value starts on; a row stands at one if that is below its end
        first = choose({k: F.get(constants(r), count_below((F.col("upto") - F.col("n")).cast("double"), r)) for k, r in ranks.items() if r})
        at = ends.where(first < F.col("upto")).select("c", "v", "n", "upto").collect() if any(ranks.values()) else []
    finally:
        counts.unpersist()
    value: dict[tuple[int, int], float] = {}
    for r in at:
        own = ranks[r["c"]]
        for t in own[bisect_left(own, r["upto"] - r["n"]) : bisect_left(own, r["upto"])]:
            value[r["c"], t] = r["v"]
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(columns):
        out[c] = []
        for p in wanted[c]:
            w = (total[k] - 1) * p
            a, b = math.floor(w), math.ceil(w)
            out[c].append(None if not total[k] else value[k, a] if a == b else (b - w) * value[k, a] + (w - a) * value[k, b])
    return out


def exact_quantiles(table: DataFrame, column: str, points: list[float], ranges: int | None = None) -> list[float | None]:
    """Quantiles of one column; all None where it has no value."""
    return quantiles_of(table, {column: F.col(column)}, {column: points}, ranges)[column]


def running_shares(counts: DataFrame, value: str, parts: list[str], ranges: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The counts with `<part>_upto` and `<part>_all` for each count column: sums over all values up to this one and over all.

    counts has one row per value (and group). Windows run within ranges; a range starts after the sums of those before it.
    """
    ranges = ranges or range_count(counts)
    at = free_name("range__", counts.columns)
    x = F.col(value).cast("double")
    cuts = _cuts(counts.select(F.percentile_approx(x, _points(ranges), 10_000).alias("c")).first()["c"])
    placed = counts.withColumn(at, count_below(x, cuts))
    before = {p: free_name(f"{p}_before__", counts.columns) for p in parts}
    groups = {c: free_name(f"{c}__", counts.columns, before.values()) for c in by}
    sizes = placed.groupBy(*by, at).agg(*(F.sum(p).alias(p) for p in parts))
    every = Window.partitionBy(*by)
    ahead = every.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(c).alias(n) for c, n in groups.items()), F.col(at).alias(f"{at}_"), *(F.coalesce(F.sum(p).over(ahead), F.lit(0)).alias(n) for p, n in before.items()), *(F.sum(p).over(every).alias(f"{p}_all") for p in parts))
    meets = F.col(at) == F.col(f"{at}_")
    for c, n in groups.items():
        meets = meets & F.col(c).eqNullSafe(F.col(n))
    own = Window.partitionBy(*by, at).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    held = placed.withColumns({f"{p}_upto": F.sum(p).over(own) for p in parts}).join(starts, meets)
    return held.withColumns({f"{p}_upto": F.col(f"{p}_upto") + F.col(n) for p, n in before.items()}).drop(at, f"{at}_", *before.values(), *groups.values())
