"""Tables of a credit-risk review: back-test, vintage, cohort, migration, roll rates, lifetime curves, severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import month


def backtest(banded: DataFrame, target: str, score: str, band: str = "band") -> DataFrame:
    return banded.groupBy(band).agg(F.count("*").alias("n"), F.sum(target).cast("bigint").alias("defaults"), F.avg(score).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("observed_rate"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def group_performance(table: DataFrame, by: list, target: str, score: str) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("observed_rate"))


def vintage(table: DataFrame, date: str, target: str, score: str) -> DataFrame:
    return group_performance(table, ["split", month(date).alias("vintage")], target, score)


def cohort(table: DataFrame, entity: str, date: str, target: str, score: str) -> DataFrame:
    """By the month in which the entity was first seen anywhere."""
    first = F.min(date).over(Window.partitionBy(entity))
    return group_performance(table.withColumn("cohort", month(first)), ["split", "cohort"], target, score)


def transitions(table: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    """split, from_state, to_state: each row with its successor in the split."""
    own = Window.partitionBy("split", entity).orderBy(*order)
    return table.select("split", F.col(state).alias("from_state"), F.lead(state).over(own).alias("to_state")).where("to_state IS NOT NULL")


def migration(table: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    held = transitions(table, entity, order, state).groupBy("split", "from_state", "to_state").agg(F.count("*").alias("n"))
    return held.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("split", "from_state")))


def roll_rates(migrated: DataFrame) -> DataFrame:
    """Rates summed over from-states by direction; a state's leading number gives its order (lower is worse)."""
    level = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).cast("int")
    move = F.when(level("to_state") > level("from_state"), "improving").when(level("to_state") < level("from_state"), "worsening").otherwise("stable")
    return migrated.groupBy("split", move.alias("direction")).agg(F.sum("n").alias("n"), F.sum("rate").alias("rate"))


def period_index(entity: str, order: list[str]):
    return F.row_number().over(Window.partitionBy(entity).orderBy(*order))


def lifetime_curve(table: DataFrame, period: str, target: str, score: str) -> DataFrame:
    """Mean and observed hazard by period, survival and cumulative default probability."""
    held = table.groupBy(period).agg(F.count("*").alias("n"), F.avg(score).alias("hazard"), F.avg(F.col(target).cast("double")).alias("observed"))
    survival = F.product(1 - F.col("hazard")).over(Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("survival", survival).withColumn("cumulative_pd", 1 - F.col("survival"))


def severity_by_segment(table: DataFrame, segment: str, actual: str, predicted: str, top: int = 10) -> DataFrame:
    """The largest segments with mean loss, predicted loss, and recovery (1 - loss); the report shows the top ones."""
    held = table.groupBy(segment).agg(F.count("*").alias("n"), F.avg(actual).alias("lgd"), F.avg(predicted).alias("predicted_lgd"))
    return held.withColumn("recovery", 1 - F.col("lgd")).orderBy(F.desc("n"), segment).limit(top)
