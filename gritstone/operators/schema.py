"""Declared schemas, casts, cleaning and targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import strip

#: Texts that count as true and false.
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")


def cast_column(x: Column, kind: str) -> Column:
    """A tolerant cast: what can't be read is null; a fractional number is no integer."""
    if kind in ("string", "str", "text", "category", "categorical"):
        return x.cast("string")
    number = x.try_cast("double")
    if kind in ("float", "float64", "double"):
        return F.when(~F.isnan(number), number)
    if kind in ("int", "int64", "integer"):
        return F.when(number % 1 == 0, number.try_cast("bigint"))
    if kind in ("bool", "boolean"):
        word = F.lower(strip(x.cast("string")))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if kind in ("datetime", "datetime64", "date"):
        return x.try_cast("timestamp")
    raise ValueError(f"unknown type {kind}")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    source: str | None = None
    kind: str | None = None
    enabled: bool = True
    default: object = None
    create: bool = False


def apply_specs(table: DataFrame, specs: list[ColumnSpec], pass_through: bool = True) -> DataFrame:
    """Drop, rename, create and cast columns in one projection."""
    named = {s.source or s.name: s for s in specs}
    missing = [s.name for s in specs if s.enabled and not s.create and (s.source or s.name) not in table.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    out = []
    for c in table.columns:
        s = named.get(c)
        if s is None and pass_through:
            out.append(F.col(c))
        elif s is not None and s.enabled:
            out.append((cast_column(F.col(c), s.kind) if s.kind else F.col(c)).alias(s.name))
    made = [(cast_column(F.lit(s.default), s.kind) if s.kind else F.lit(s.default)).alias(s.name) for s in specs if s.enabled and s.create and (s.source or s.name) not in table.columns]
    return table.select(*out, *made)


def clean_strings(table: DataFrame, trim: bool = True) -> DataFrame:
    """Blank text becomes null; then text is trimmed of all white space."""
    texts = [c for c, t in table.dtypes if t == "string"]
    blank = lambda c: F.when(~F.col(c).rlike(r"^\s*$"), strip(c) if trim else F.col(c))
    return table.withColumns({c: blank(c) for c in texts}) if texts else table


def drop_empty_columns(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns that are null in every row."""
    counts = table.agg(*(F.count(c).alias(c) for c in table.columns)).first().asDict()
    return table.drop(*(c for c, n in counts.items() if not n and c not in keep))


def binary_target(source: Column, positive: tuple[str, ...]) -> Column:
    return F.when(source.isNull(), None).when(F.lower(strip(source.cast("string"))).isin(*(p.strip().lower() for p in positive)), 1).otherwise(0)


def multiclass_target(table: DataFrame, source: str, output: str) -> DataFrame:
    """Class numbers 0..k-1 in the order of the values; the list of classes is small and meets the rows by a join."""
    classes = table.where(F.col(source).isNotNull()).select(source).distinct().withColumn(output, F.row_number().over(Window.orderBy(source)) - 1)
    return table.join(classes, source, "left")
