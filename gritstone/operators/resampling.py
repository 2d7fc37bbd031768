"""Draws of a fixed number of rows: with replacement for a bootstrap, and positions shared by several tables.

A draw is a number of the hash of (seed, replicate, number of the draw), taken modulo the rows, so any engine with SHA-256
draws the same, and neither partitions nor retries change it. Rows are named by their place in the order of a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.operators.ranges import free_name
from gritstone.operators.splits import global_rank


#: Draws that a task makes and counts.
TASK_DRAWS = 2_000_000


def hashed_digits(*parts: Column | int | str) -> Column:
    """The first 13 hexadecimal digits of the SHA-256 of the parts, written with colons between them."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.substring(F.sha2(text, 256), 1, 13)


def hashed_number(*parts: Column | int | str) -> Column:
    """The whole number below 2^52 that these digits are."""
    return F.conv(hashed_digits(*parts), 16, 10).cast("bigint")


def _at_places(table: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """The table's rows joined to what `places` (with a column place) has for their place in the order of the key."""
    place = free_name("place", table.columns, places.columns)
    ranked = global_rank(table, [key], place).drop(f"{place}_n")
    return ranked.join(places.withColumnRenamed("place", place), place).drop(place)


def bootstrap_counts(table: DataFrame, key: str, replicates: int, rows: int | None = None, seed: int = 42) -> DataFrame:
    """replicate, place (1-based, in the order of the key) and n, how often the row is drawn; exactly `rows` draws per
    replicate, by default as many as the table has rows. Rows that are not drawn do not appear.

    Draws are dealt by place in parts of TASK_DRAWS, before they are counted, so no task's table of counts grows with the input.
    """
    total = table.count()
    wanted = total if rows is None else rows
    if not total:
        return table.sparkSession.createDataFrame([], "replicate int, place bigint, n bigint")
    parts = max(1, -(-replicates * wanted // TASK_DRAWS), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    draws = table.sparkSession.range(0, replicates * wanted, 1, parts).select(F.floor(F.col("id") / wanted).cast("int").alias("replicate"), F.pmod("id", F.lit(wanted)).alias("draw"))
    place = F.pmod(hashed_number(seed, F.col("replicate"), F.col("draw")), F.lit(total)) + 1
    return draws.select("replicate", place.alias("place")).repartition(parts, "place").groupBy("replicate", "place").agg(F.count("*").alias("n"))


def bootstrap_rows(table: DataFrame, key: str, replicates: int, rows: int | None = None, seed: int = 42) -> DataFrame:
    """The drawn rows with all their columns, `replicate` and `times`; a row drawn twice comes once with times 2."""
    return _at_places(table, key, bootstrap_counts(table, key, replicates, rows, seed).withColumnRenamed("n", "times"))


def sampled_places(spark, total: int, rows: int, seed: int = 42) -> DataFrame:
    """`rows` of the places 1 to `total` without replacement: those with the least hashes, ties by place."""
    return spark.range(1, total + 1).select(F.col("id").alias("place")).orderBy(hashed_number(seed, F.col("place")), "place").limit(rows)


def positional_sample(tables: dict[str, DataFrame], key: str, rows: int, seed: int = 42) -> dict[str, DataFrame]:
    """The same places, in the order of the key, of tables with equally many rows; all rows where there are no more."""
    sizes = {name: t.count() for name, t in tables.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"tables of different sizes share no places: {sizes}")
    total = next(iter(sizes.values()), 0)
    if total <= rows:
        return dict(tables)
    places = {name: sampled_places(t.sparkSession, total, rows, seed) for name, t in tables.items()}
    return {name: _at_places(t, key, places[name]) for name, t in tables.items()}
