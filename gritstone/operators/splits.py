"""Train, validation and test as one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import strip
from gritstone.operators.ranges import free_name, ranged

#: Names that stand for a split.
ALIASES = {
    "train": ("train", "training", "dev", "development", "in_sample"),
    "validation": ("validation", "valid", "val", "tuning"),
    "test": ("test", "testing", "holdout", "hold_out", "oot", "out_of_time"),
}


def global_rank(table: DataFrame, order: list[str], output: str = "place", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """1-based rank by `order`, nulls first, and `<output>_n`, the number of rows, without one task for all rows.

    `order` ends with a unique key. Rows are ranked within ranges of the whole order key; a range starts after the rows
    of those before it. With `by`, each group has ranks of its own. A table that has the output's columns is an error.
    """
    if clash := {output.lower(), f"{output}_n".lower()} & {c.lower() for c in table.columns}:
        raise ValueError(f"the table already has {sorted(clash)}")
    at, n, before, total = (free_name(c, table.columns, (output, f"{output}_n")) for c in ("range__", "n__", "before__", "total__"))
    held = ranged(table, order, at, ranges)
    groups = Window.partitionBy(*by)
    ahead = groups.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*by, at).agg(F.count("*").alias(n))
    names = {c: free_name(f"{c}__", table.columns, (at, n, before, total)) for c in by}
    starts = sizes.select(*(F.col(c).alias(names[c]) for c in by), F.col(at).alias(f"{at}_"), F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before), F.sum(n).over(groups).alias(total))
    meets = F.col(at) == F.col(f"{at}_")
    for c in by:
        meets = meets & F.col(c).eqNullSafe(F.col(names[c]))
    own = F.row_number().over(Window.partitionBy(*by, at).orderBy(*order))
    ranked = held.withColumn(output, own).join(starts, meets)
    return ranked.withColumns({output: F.col(output) + F.col(before), f"{output}_n": F.col(total)}).drop(at, f"{at}_", before, total, *names.values())


def _dealt(table: DataFrame, order: list[str], share: tuple[float, float], by: tuple[str, ...] = ()) -> DataFrame:
    """`split` by rank: the first floor(n * train) rows (of each group) train, the next floor(n * validation) validate."""
    place = free_name("place", table.columns)
    a, b = (F.floor(F.col(f"{place}_n") * x + 1e-9) for x in share)
    ranked = global_rank(table, order, place, by)
    return ranked.withColumn("split", F.when(F.col(place) <= a, "train").when(F.col(place) <= a + b, "validation").otherwise("test")).drop(place, f"{place}_n")


def chronological(table: DataFrame, order: list[str], train: float, validation: float) -> DataFrame:
    """The first floor(n * train) rows in time train, the next floor(n * validation) validate, the rest test."""
    return _dealt(table, order, (train, validation))


def date_cutoff(date: Column, validation_start: str, test_start: str) -> Column:
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return F.when(date < stamp(validation_start), "train").when(date < stamp(test_start), "validation").otherwise("test")


def date_windows(table: DataFrame, date: str, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Closed windows per split; overlapping windows or rows outside all of them are an error."""
    ordered = sorted(windows.values())
    if any(a[1] >= b[0] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("windows overlap")
    split = F.coalesce(*(F.when(F.col(date).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), k) for k, (a, b) in windows.items()))
    out = table.withColumn("split", split)
    if not out.where("split IS NULL").isEmpty():
        raise ValueError("rows outside all windows")
    return out


def named_split(label: Column) -> Column:
    word = F.regexp_replace(F.lower(strip(label.cast("string"))), r"[\s-]+", "_")
    return F.coalesce(*(F.when(word.isin(*names), k) for k, names in ALIASES.items()))


def stratified(table: DataFrame, key: str, target: str, train: float, validation: float, multiplier: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """Exact shares within each target class, in a reproducible shuffle of a unique integer key."""
    mixed = free_name("mixed", table.columns)
    return _dealt(table.withColumn(mixed, F.pmod(F.col(key) * multiplier, F.lit(modulus))), [mixed, key], (train, validation), (target,)).drop(mixed)


def summary(table: DataFrame, date: str) -> DataFrame:
    return table.groupBy("split").agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def fold(key: str, k: int, multiplier: int = 7919, modulus: int = 1_000_003) -> Column:
    return (F.pmod(F.pmod(F.col(key) * multiplier, F.lit(modulus)), F.lit(k))).cast("int")
