"""Checks of data and models against what a run expects, each as one row: check, subject, observed, limit, passed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.scalars import correlation

SCHEMA = "check string, subject string, observed string, expected string, passed boolean"

#: Which targets a model can have.
UNIT_INTERVAL = ("beta_regression", "fractional_logit", "zero_one_inflated_beta", "two_stage_loss")
POSITIVE = ("cox_proportional_hazards", "accelerated_failure_time")


def feature_types(table: DataFrame, roles: dict[str, str]) -> dict[str, list[str]]:
    """numeric and categorical feature columns by type; columns with another role than `feature` are neither."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": []}
    for f in table.schema.fields:
        if roles.get(f.name, "feature") != "feature" or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            continue
        out["numeric" if isinstance(f.dataType, T.NumericType) else "categorical"].append(f.name)
    return out


def resolved_policies(table: DataFrame, policies: dict[str, str], features: list[str]) -> dict[str, str]:
    """The given policy of each feature, else the median for a number and the mode for anything else."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return {c: policies.get(c) or ("median" if isinstance(kinds[c], T.NumericType) else "mode") for c in features}


def split_strategy(structure: str) -> str:
    """cross_sectional data are dealt at random, time series and panels in the order of time."""
    return "random" if structure == "cross_sectional" else "chronological"


@dataclass
class Expected:
    """What a run expects of its data."""

    mode: str = "binary"  # or multiclass, continuous
    model: str = ""
    structure: str = "cross_sectional"  # or time_series, panel
    date: str | None = None
    entity: str | None = None
    segments: list[str] = field(default_factory=list)
    most_segments: int = 50
    most_missing: float = 1.0


def dataset_checks(table: DataFrame, target: str, expected: Expected) -> DataFrame:
    """Class count against the mode, bounds that the model needs, the columns that the structure needs, segments, and the
    share of missing values of every column; one aggregate over the table, and one over its segments."""
    present = set(table.columns)
    rows: list[tuple[str, str, str, str, bool]] = []
    numeric = isinstance(table.schema[target].dataType, T.NumericType)
    y = F.col(target).cast("double") if numeric else F.lit(None).cast("double")
    row = table.agg(F.count("*").alias("n"), F.count_distinct(target).alias("classes"), F.min(y).alias("low"), F.max(y).alias("high"), *(F.avg(F.col(c).isNull().cast("double")).alias(f"m{k}") for k, c in enumerate(table.columns))).first()
    classes = row["classes"]
    need = {"binary": ("2", classes == 2), "multiclass": ("at least 3", classes >= 3), "continuous": ("a number with at least 2 values", numeric and classes >= 2)}[expected.mode]
    rows.append(("target_values", target, str(classes), *need))
    if expected.model in UNIT_INTERVAL:
        rows.append(("target_bounds", target, f"{row['low']} to {row['high']}", "0.0 to 1.0", row["low"] is not None and 0 <= row["low"] and row["high"] <= 1))
    if expected.model in POSITIVE:
        rows.append(("target_bounds", target, f"{row['low']}", "above 0", row["low"] is not None and row["low"] > 0))
    if expected.structure != "cross_sectional":
        rows.append(("date_column", expected.date or "", "present" if expected.date in present else "missing", "present", expected.date in present))
    if expected.structure == "panel":
        rows.append(("entity_column", expected.entity or "", "present" if expected.entity in present else "missing", "present", expected.entity in present))
    for c in expected.segments:
        rows.append(("segment_column", c, "present" if c in present else "missing", "present", c in present))
    if expected.segments and set(expected.segments) <= present:
        n = table.select(*expected.segments).distinct().count()
        rows.append(("segments", ",".join(expected.segments), str(n), f"at most {expected.most_segments}", n <= expected.most_segments))
    for k, c in enumerate(table.columns):
        share = row[f"m{k}"] or 0.0
        rows.append(("missing", c, f"{share:.6f}", f"at most {expected.most_missing}", share <= expected.most_missing))
    return table.sparkSession.createDataFrame(rows, SCHEMA)


@dataclass
class Policy:
    """What a feature set must be like. Signs: positive, negative, nonnegative or nonpositive; monotone: increasing or decreasing."""

    required: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    most_missing: float | None = None
    most_vif: float | None = None
    least_iv: float | None = None
    signs: dict[str, str] = field(default_factory=dict)
    monotone: dict[str, str] = field(default_factory=dict)


def has_sign(value: float | None, sign: str) -> bool:
    return value is not None and {"positive": value > 0, "negative": value < 0, "nonnegative": value >= 0, "nonpositive": value <= 0}.get(sign, False)


def is_monotone(curve: list[float], direction: str, slack: float = 1e-6) -> bool:
    steps = [b - a for a, b in zip(curve, curve[1:])]
    return bool(steps) and (all(s >= -slack for s in steps) if direction == "increasing" else direction == "decreasing" and all(s <= slack for s in steps))


def policy_checks(df: DataFrame, features: list[str], policy: Policy, missing: dict[str, float], vif: dict[str, float], iv: dict[str, float], coefficients: dict[str, float], curves: dict[str, list[float]]) -> DataFrame:
    """One row per rule and feature; what is not known of a feature fails the rules that need it."""
    rows = [("required_feature", c, "present" if c in features else "missing", "present", c in features) for c in policy.required]
    rows += [("excluded_feature", c, "present" if c in features else "missing", "missing", c not in features) for c in policy.excluded]
    if policy.most_missing is not None:
        rows += [("most_missing", c, f"{missing.get(c, 0.0):.6f}", str(policy.most_missing), missing.get(c, 0.0) <= policy.most_missing) for c in features]
    if policy.most_vif is not None:
        rows += [("most_vif", c, f"{v:.6f}", str(policy.most_vif), v <= policy.most_vif) for c, v in vif.items()]
    if policy.least_iv is not None:
        rows += [("least_iv", c, f"{v:.6f}", str(policy.least_iv), v >= policy.least_iv) for c, v in iv.items()]
    rows += [("expected_sign", c, "unknown" if coefficients.get(c) is None else f"{coefficients[c]:.6f}", s, has_sign(coefficients.get(c), s)) for c, s in policy.signs.items()]
    rows += [("monotone", c, "monotone" if is_monotone(curves.get(c, []), d) else "not monotone", d, is_monotone(curves.get(c, []), d)) for c, d in policy.monotone.items()]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def workbench(table: DataFrame, constructed: dict[str, tuple[str, list[str]]], target: str) -> DataFrame:
    """Of each constructed feature its kind and sources, the share of values, distinct values, mean, population deviation
    and |r| with the target over rows that have both (null below ten of them); one aggregate."""
    y = F.col(target).cast("double")
    cells = []
    for k, c in enumerate(constructed):
        x = F.col(c).cast("double")
        both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
        cells += [F.avg(F.col(c).isNotNull().cast("double")).alias(f"s{k}"), F.count_distinct(c).alias(f"d{k}"), F.avg(x).alias(f"m{k}"), F.stddev_pop(x).alias(f"v{k}"), F.when(both >= 10, F.abs(correlation(x, y))).alias(f"r{k}")]
    row = table.agg(*cells).first()
    rows = [(c, kind, ",".join(sources), row[f"s{k}"], row[f"d{k}"], row[f"m{k}"], row[f"v{k}"], row[f"r{k}"]) for k, (c, (kind, sources)) in enumerate(constructed.items())]
    return table.sparkSession.createDataFrame(rows, "feature string, kind string, sources string, known double, distinct_values bigint, mean double, std double, relation double")


def lineage(df: DataFrame, features: list[str], made_from: dict[str, list[str]]) -> DataFrame:
    """feature, source: each model feature with the original columns that it goes back to, over any number of steps."""

    def roots(c: str, seen: frozenset[str] = frozenset()) -> set[str]:
        if c in seen:
            raise ValueError(f"{c} is made from itself")
        return {r for s in made_from[c] for r in roots(s, seen | {c})} if c in made_from else {c}

    rows = [(c, s) for c in features for s in sorted(roots(c))]
    return df.sparkSession.createDataFrame(rows, "feature string, source string")


def quality_summary(table: DataFrame, keys: list[str], target: str) -> DataFrame:
    """fact, value: rows, columns, repeated keys, rows without a target, cells without a value, columns without any."""
    row = table.agg(F.count("*").alias("n"), F.sum(F.col(target).isNull().cast("bigint")).alias("no_target"), *(F.count(c).alias(f"c{k}") for k, c in enumerate(table.columns))).first()
    distinct = table.select(*keys).distinct().count()
    known = [row[f"c{k}"] for k in range(len(table.columns))]
    facts = {"rows": row["n"], "columns": len(table.columns), "repeated_keys": row["n"] - distinct, "rows_without_target": row["no_target"] or 0, "missing_cells": row["n"] * len(known) - sum(known), "empty_columns": sum(not k for k in known)}
    return table.sparkSession.createDataFrame([(k, int(v)) for k, v in facts.items()], "fact string, value bigint")
