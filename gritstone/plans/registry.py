"""What a module of queries offers: each query by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritstone.plans.catalogue import BOOK_SQL, book, neat

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None, build: Callable[[DataFrame], DataFrame], digits: int | None = 6, source: Query = book, base: str = BOOK_SQL) -> None:
        """build makes the query from the source's table; its doubles are rounded to `digits`. The SQL follows `base`."""

        def query(spark: SparkSession, sf: str) -> DataFrame:
            out = build(source(spark, sf))
            return out if digits is None else neat(out, digits)

        self.queries[name] = query
        if sql is not None:
            self.sql[name] = base + sql
