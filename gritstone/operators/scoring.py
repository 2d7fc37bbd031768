"""Scoring with a kept model: its contract of features, what a split's scored rows hold, and what is written of them."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.distributions import normal_sf
from gritstone.operators.models import Linear
from gritstone.operators.resampling import hashed_number

#: A step of a replay: a table in, a table out.
Step = Callable[[DataFrame], DataFrame]


@dataclass
class Kept:
    """A fitted model with the type of every feature that it needs, and the threshold of its classes."""

    model: Linear
    types: dict[str, str]
    threshold: float = 0.5

    def save(self, spark: SparkSession, path: str) -> None:
        m = self.model
        held = {"features": m.features, "coefficients": list(map(float, m.coefficients)), "link": m.link, "intercept": m.intercept, "types": self.types, "threshold": self.threshold}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Kept:
        held = json.loads(spark.read.text(path).first()["value"])
        return Kept(Linear(held["features"], np.array(held["coefficients"]), None, held["link"], held["intercept"]), held["types"], held["threshold"])

    def checked(self, table: DataFrame) -> DataFrame:
        """The table with the features in their types; missing ones are an error that names them, a value that is no number a null."""
        missing = [c for c in self.types if c not in table.columns]
        if missing:
            raise ValueError(f"the model needs {missing}")
        return table.withColumns({c: F.col(c).try_cast(t) for c, t in self.types.items()})


def kept(model: Linear, table: DataFrame, threshold: float = 0.5) -> Kept:
    kinds = dict(table.dtypes)
    return Kept(model, {c: kinds[c] for c in model.features}, threshold)


def replayed(table: DataFrame, steps: list[tuple[str, Step]]) -> DataFrame:
    """A table through named steps; one that gives no table is an error with its name. All steps stay one lazy plan."""
    for name, step in steps:
        table = step(table)
        if not isinstance(table, DataFrame):
            raise TypeError(f"step {name} gave {type(table).__name__} instead of a table")
    return table


def score_binary(table: DataFrame, held: Kept, target: str | None = None) -> DataFrame:
    """The table with probability, predicted_class, and, where the target is known, residual."""
    scored = held.checked(table).withColumn("probability", held.model.predict())
    scored = scored.withColumn("predicted_class", (F.col("probability") >= held.threshold).cast("int"))
    return scored.withColumn("residual", F.col(target) - F.col("probability")) if target else scored


def score_multiclass(table: DataFrame, model, target: str | None = None) -> DataFrame:
    """The table with predicted_class, its probability, and the probability of each class by number; model: Multinomial."""
    each = {f"probability_{k}": p for k, p in enumerate(model.probabilities())}
    scored = table.withColumn("predicted_class", model.predict()).withColumns(each).withColumn("predicted_probability", F.greatest(*each))
    return scored.withColumn("hit", (F.col(target) == F.col("predicted_class")).cast("int")) if target else scored


def compact(scored: DataFrame, key: list[str], outputs: list[str], sample: int | None = None, seed: int = 42) -> DataFrame:
    """Key and outputs only; with `sample`, that many rows with the least hashes of the key (all if there are fewer)."""
    held = scored.select(*key, *outputs)
    return held if sample is None else held.orderBy(hashed_number(seed, *(F.col(c) for c in key)), *key).limit(sample)


def parquet_safe(table: DataFrame, flat: bool = False) -> DataFrame:
    """Types that Parquet readers share: times of no value (void) as text; with `flat` nested columns as JSON text too."""
    out = {}
    for f in table.schema.fields:
        if isinstance(f.dataType, T.NullType):
            out[f.name] = F.col(f.name).cast("string")
        elif flat and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[f.name] = F.to_json(f.name)
        elif isinstance(f.dataType, T.DayTimeIntervalType | T.YearMonthIntervalType):
            out[f.name] = F.col(f.name).cast("string")
    return table.withColumns(out) if out else table


def importance_table(df: DataFrame, model: Linear) -> DataFrame:
    """feature, importance (the absolute coefficient), coefficient, std_error, p_value and, for a logit, the odds ratio."""
    first = 1 if model.intercept else 0
    error = np.sqrt(np.maximum(np.diag(model.covariance), 0)) if model.covariance is not None else np.full(len(model.coefficients), np.nan)
    rows = []
    for c, b, s in zip(model.features, model.coefficients[first:].tolist(), error[first:].tolist(), strict=True):
        known = s > 0
        rows.append((c, abs(b), b, s if known else None, 2 * normal_sf(abs(b / s)) if known else None, (math.exp(b) if b < 700 else math.inf) if model.link == "logit" else None))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, coefficient double, std_error double, p_value double, odds_ratio double")


def with_row_function(table: DataFrame, output: str, function: Callable, columns: list[str], kind: str) -> DataFrame:
    """A user's function of whole columns (pandas Series in, one out), in Arrow batches."""

    def whole(*x: pd.Series) -> pd.Series:
        return function(*x)

    return table.withColumn(output, F.pandas_udf(whole, kind)(*columns))


def with_group_function(table: DataFrame, by: list[str], outputs: dict[str, tuple[Callable, list[str], str]]) -> DataFrame:
    """A user's aggregates of whole groups (pandas Series in, one value out): output -> (function, columns, type).

    A group's rows meet in one task, so it is for groups that a task can hold.
    """

    def aggregate(function: Callable, columns: list[str], kind: str) -> Column:
        def whole(*x: pd.Series) -> float:
            return function(*x)

        return F.pandas_udf(whole, kind)(*columns)

    return table.groupBy(*by).agg(*(aggregate(*spec).alias(name) for name, spec in outputs.items()))
