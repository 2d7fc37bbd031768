"""A paged query surface: AND-ed filters, projection, one sort column, pages; built as a lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(table: DataFrame, name: str, op: str, value) -> Column | None:
    """The predicate of one filter; an unknown column or operation, or an empty list, filters nothing."""
    if name not in table.columns:
        return None
    c, op = F.col(name), str(op).lower()
    if op in ("eq", "="):
        return c == F.lit(value)
    if op in ("contains", "like"):
        return c.cast("string").ilike(f"%{value}%")
    if op == "in" and value:
        return c.isin(list(value))
    if op == "between" and value is not None and len(value) == 2:
        return c.between(*value)
    return None


def filtered(table: DataFrame, filters: list[dict] = ()) -> DataFrame:
    for f in filters:
        if (found := condition(table, f.get("column"), f.get("op", "eq"), f.get("value"))) is not None:
            table = table.where(found)
    return table


def query_page(table: DataFrame, *, columns: list[str] | None = None, filters: list[dict] = (), sort_by: str | None = None, descending: bool = False, page: int = 1, page_size: int = 50, tie_breakers: tuple[str, ...] = ()) -> DataFrame:
    """One page; nulls sort last either way; page and size are at least 1. A bounded page is a top-k, not a full sort."""
    kept = [c for c in columns or () if c in table.columns] or table.columns
    page, page_size = max(1, page), max(1, page_size)
    out = filtered(table, filters)
    if sort_by in table.columns:
        order = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
        out = out.orderBy(order, *(F.col(c).asc_nulls_last() for c in tie_breakers))
    return out.offset((page - 1) * page_size).limit(page_size).select(*kept)


def count_rows(table: DataFrame, filters: list[dict] = ()) -> DataFrame:
    return filtered(table, filters).agg(F.count("*").alias("n"))


def distinct_values(table: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """Non-null values as text, ordered, at most `limit` (the feature is a list for a chooser)."""
    return table.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(limit)
