"""Bins, bands, weights of evidence, encodings and stability of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import category, divided
from gritstone.operators.quantiles import exact_quantiles
from gritstone.operators.ranges import count_below, free_name
from gritstone.operators.splits import global_rank


def rank_band(table: DataFrame, order: list[str], q: int, by: tuple[str, ...] = (), output: str = "band") -> DataFrame:
    """Equal-count bands 1..q by rank: greatest(1, ceil((rank - 1) * q / (n - 1))), in integer arithmetic.

    order: a number first, a unique key last. The rank is distributed; no task sees all rows.
    """
    rank = free_name("rank__", table.columns, (output,))
    spans = F.greatest(F.col(f"{rank}_n") - 1, F.lit(1))
    band = F.greatest(F.lit(1), F.floor(((F.col(rank) - 1) * q + spans - 1) / spans)).cast("int")
    return global_rank(table, order, rank, by).withColumn(output, band).drop(rank, f"{rank}_n")


def quantile_edges(train: DataFrame, source: str, bins: int) -> list[float]:
    """Interior edges of linear-interpolated quantiles, without repeats."""
    edges = sorted({q for q in exact_quantiles(train, source, [k / bins for k in range(bins + 1)]) if q is not None})
    return edges[1:-1]


def equal_width_edges(train: DataFrame, source: str, bins: int) -> list[float]:
    low, high = train.agg(F.min(F.col(source).cast("double")), F.max(F.col(source).cast("double"))).first()
    return [] if low is None or low == high else [low + (high - low) * k / bins for k in range(1, bins)]


def monotonic_edges(train: DataFrame, source: str, target: str, bins: int) -> list[float]:
    """Quantile edges with as many bins as keep the target's mean monotone, in numeric order of the bins.

    The quantiles of every number of bins come from one count of the values, and one count of the bins that all their
    edges together make serves all of them.
    """
    numbers = range(bins, 1, -1)
    points = sorted({k / n for n in numbers for k in range(n + 1)})
    at = dict(zip(points, exact_quantiles(train, source, points), strict=True))
    fine = sorted({q for q in at.values() if q is not None})
    held = train.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(count_below(F.col(source).cast("double"), fine).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("t"))
    found = {r["b"]: (r["n"], r["t"]) for r in held.collect()}
    for n in numbers:
        edges = sorted({q for k in range(n + 1) if (q := at[k / n]) is not None})[1:-1]
        # fine bin b holds what is above fine[b - 1] and at most fine[b]
        sums: dict[int, list[float]] = {}
        for b, (rows, events) in found.items():
            own = sums.setdefault(sum(e < fine[min(b, len(fine) - 1)] for e in edges), [0, 0.0])
            own[0], own[1] = own[0] + rows, own[1] + events
        means = [sums[b][1] / sums[b][0] for b in sorted(sums)]
        if means == sorted(means) or means == sorted(means, reverse=True):
            return edges
    return []


def bin_number(x: Column, edges: list[float]) -> Column:
    """0-based number of the right-closed interval (a, b], the outer ones unbounded; null stays null."""
    out = F.when(x.isNull(), None)
    for k, e in enumerate(edges):
        out = out.when(x <= e, k)
    return out.otherwise(len(edges)).cast("int")


def woe_table(table: DataFrame, key: Column, target: str, smoothing: float = 0.5) -> DataFrame:
    """key, n, events, bad_rate, woe = ln(share of non-events / share of events), smoothed, and iv of each key."""
    held = table.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(target).cast("bigint").alias("events"))
    every = Window.partitionBy()
    k = F.count("*").over(every)
    bad = (F.col("events") + smoothing) / (F.sum("events").over(every) + smoothing * k)
    good = (F.col("n") - F.col("events") + smoothing) / (F.sum(F.col("n") - F.col("events")).over(every) + smoothing * k)
    return held.select("key", "n", "events", (F.col("events") / F.col("n")).alias("bad_rate"), F.log(good / bad).alias("woe"), ((good - bad) * F.log(good / bad)).alias("iv"))


def floored_woe_table(table: DataFrame, key: Column, target: str, floor: float = 0.5) -> DataFrame:
    """As woe_table, but with counts of at least `floor` instead of smoothed ones, over totals that are left as they are."""
    held = table.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(target).cast("bigint").alias("events"))
    every = Window.partitionBy()  # a row per key
    share = lambda c: F.greatest(c.cast("double"), F.lit(floor)) / F.greatest(F.sum(c).over(every).cast("double"), F.lit(1.0))
    bad, good = share(F.col("events")), share(F.col("n") - F.col("events"))
    return held.select("key", "n", "events", F.log(good / bad).alias("woe"), ((good - bad) * F.log(good / bad)).alias("iv"))


def encode(table: DataFrame, mapping: DataFrame, key: Column, value: str, default: float, output: str) -> DataFrame:
    """Look a key up in a learned table (key, value); an unseen key gets the default. The join is Spark's to plan."""
    found = mapping.select(F.col("key").alias("__key"), F.col(value).alias("__value"))
    return table.join(found, key == F.col("__key"), "left").withColumn(output, F.coalesce("__value", F.lit(default))).drop("__key", "__value")


def source_key(train: DataFrame, source: str, bins: int = 10) -> Column:
    """What an encoding looks a value up by: a number's quantile bin, a category itself, Missing for a gap."""
    if dict(train.dtypes)[source] in ("string", "boolean"):
        return category(source)
    return category(bin_number(F.col(source).cast("double"), quantile_edges(train, source, bins)))


def evidence_encoding(table: DataFrame, train: DataFrame, source: str, target: str, output: str, bins: int = 10, value: str = "woe") -> DataFrame:
    """The table with the weight of evidence (unseen: 0) or, by value, the bad_rate (unseen: the mean target) of its key."""
    key = source_key(train, source, bins)
    default = 0.0 if value == "woe" else train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return encode(table, woe_table(train, key, target), key, value, default, output)


def rare_levels(train: DataFrame, source: str, share: float = 0.01) -> DataFrame:
    """key, kept: levels with less than the share become 'Other', 'Missing' never."""
    held = train.groupBy(category(source).alias("key")).agg(F.count("*").alias("n"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy())
    return held.select("key", F.when((part >= share) | (F.col("key") == "Missing"), F.col("key")).otherwise("Other").alias("kept"))


def frequency_table(train: DataFrame, source: str) -> DataFrame:
    held = train.groupBy(category(source).alias("key")).agg(F.count("*").alias("n"))
    return held.select("key", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def ordinal_table(train: DataFrame, source: str) -> DataFrame:
    return train.select(category(source).alias("key")).distinct().withColumn("code", F.row_number().over(Window.orderBy("key")) - 1)


def target_encoding(table: DataFrame, source: str, target: str, smoothing: float = 20.0, output: str = "encoded") -> DataFrame:
    """Training rows: smoothed mean of the other rows of their category (the global mean if alone); others: its raw mean."""
    train = table.where("split = 'train'")
    mu = train.agg(F.avg(target)).first()[0]
    stats = train.groupBy(category(source).alias("__key")).agg(F.count("*").alias("__n"), F.sum(target).alias("__sum"))
    loo = F.when(F.col("__n") > 1, (F.col("__sum") - F.col(target) + smoothing * mu) / (F.col("__n") - 1 + smoothing)).otherwise(F.lit(mu))
    out = F.when(F.col("split") == "train", loo).otherwise(F.coalesce(F.col("__sum") / F.col("__n"), F.lit(mu)))
    return table.join(stats, category(source) == F.col("__key"), "left").withColumn(output, out).drop("__key", "__n", "__sum")


def psi(table: DataFrame, source: str, base: Column, other: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """bin, expected, actual, psi between the rows of `base` and of `other`, over quantile bins of the base; null shares
    where there are no such rows."""
    edges = quantile_edges(table.where(base), source, bins)
    held = table.where((base | other) & F.col(source).isNotNull()).groupBy(bin_number(F.col(source), edges).alias("bin")).agg(F.sum(base.cast("bigint")).alias("e"), F.sum(other.cast("bigint")).alias("a"))
    every = Window.partitionBy()
    shares = (divided(F.col(c).cast("double"), F.sum(c).over(every).cast("double")) for c in ("e", "a"))
    e, a = (F.when(s.isNotNull(), F.greatest(s, F.lit(floor))) for s in shares)
    return held.select("bin", e.alias("expected"), a.alias("actual"), ((a - e) * F.log(a / e)).alias("psi"))
