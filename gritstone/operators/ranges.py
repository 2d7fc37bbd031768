"""Cutting an order into ranges that tasks can sort alone.

Cuts come from a sample of the whole order key, so equal leading values are cut as well, and their number follows the
session's shuffle partitions. They are constants of the plan: any evaluation, retries included, deals rows alike. Cuts
only balance the work; results don't depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import let

#: Ranges at least and at most, and sampled keys per range.
LEAST_RANGES, MOST_RANGES, PER_RANGE = 8, 10_000, 50
#: Cuts up to here become a tree of comparisons in generated code, more of them a tree over every n-th and a search in an array.
TREE = 64


def free_name(name: str, *taken: Iterable[str]) -> str:
    """The name, lengthened until no table has such a column (upper and lower case alike)."""
    held = {c.lower() for columns in taken for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def constants(values: list[float]) -> Column:
    """An array of doubles, parsed at once instead of built one by one."""
    return F.expr(f"array({', '.join(f'{v!r}D' if math.isfinite(v) else f'double({str(v)!r})' for v in map(float, values))})")


def count_below(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are less than x. Cuts are numbers or columns of constants; a null x is below all."""
    if not cuts:
        return F.lit(0)
    every = -(-len(cuts) // TREE)
    coarse = [c if isinstance(c, Column) else F.lit(c) for c in cuts[every - 1 :: every]]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low * every)
        middle = (low + high) // 2
        return F.when(coarse[middle] < x, tree(middle + 1, high)).otherwise(tree(low, middle))

    if every == 1:
        return tree(0, len(coarse))
    # what the tree leaves open are the `every` cuts from there on
    array = F.array(*cuts) if isinstance(cuts[0], Column) else constants(cuts)
    width = 1 << (every.bit_length() - 1)

    def wider(found: Column, width: int) -> Column:
        return let(found, lambda p: F.when(F.get(array, p + (width - 1)) < x, p + width).otherwise(p))

    out = tree(0, len(coarse))
    while width:
        out, width = wider(out, width), width >> 1
    return out


def ordinal(table: DataFrame, column: str) -> Column:
    """What orders as the column does and survives a way through the driver: times as microseconds without a zone."""
    kind, x = dict(table.dtypes)[column], F.col(column)
    if kind == "timestamp":
        return F.unix_micros(x)
    if kind == "date":
        return F.unix_date(x)
    if kind == "timestamp_ntz":
        minutes = (F.unix_date(x.cast("date")).cast("bigint") * 24 + F.hour(x)) * 60 + F.minute(x)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("bigint")
    return x


def range_count(table: DataFrame) -> int:
    return min(max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_RANGES), MOST_RANGES)


def ranged(table: DataFrame, order: list[str], output: str, ranges: int | None = None) -> DataFrame:
    """The table with the number of each row's range, whose numbers rise with the order key (nulls first)."""
    key = F.struct(*(ordinal(table, c).alias(f"k{j}") for j, c in enumerate(order)))
    keys, wanted = table.select(key.alias("key")), ranges or range_count(table)
    total = keys.count()
    share = min(1.0, wanted * PER_RANGE / max(total, 1))
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else keys.limit(wanted * PER_RANGE)
    rows = sorted_keys(sample)
    every = max(1, len(rows) // wanted)
    kinds = [f.dataType for f in keys.schema["key"].dataType.fields]
    cuts = [F.struct(*(F.lit(v).cast(t).alias(f"k{j}") for j, (v, t) in enumerate(zip(r["key"], kinds, strict=True)))) for r in rows[every::every][: wanted - 1]]
    return table.withColumn(output, count_below(key, cuts))


def sorted_keys(sample: DataFrame) -> list:
    """The sampled keys in the order that Spark compares them by."""
    return sample.orderBy("key").collect()
