"""Sums over all rows of what NumPy makes of a batch: one job, and one row per task and cell before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a batch by name, nulls as NaN -> `size` sums.
Part = Callable[[dict[str, np.ndarray]], np.ndarray]


def block_sums(table: DataFrame, size: int, part: Part) -> np.ndarray:
    """`size` sums over the table's rows; the driver sees only them."""
    names = table.columns

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part({c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)})
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(total[cells])], names=["cell", "part"])

    out = np.zeros(size)
    for r in table.mapInArrow(sums, "cell bigint, part double").groupBy("cell").agg(F.sum("part").alias("total")).collect():
        out[r["cell"]] = r["total"]
    return out


def doubles(table: DataFrame, columns: list[str], whole: bool = True) -> DataFrame:
    """The columns as finite doubles; others become null. With `whole`, rows with a null are left out."""
    cast = (F.col(c).cast("double") for c in columns)
    held = table.select(*(F.when(F.abs(x) < float("inf"), x).alias(c) for c, x in zip(columns, cast, strict=True)))
    return held.na.drop() if whole else held


def design(x: dict[str, np.ndarray], features: list[str], rows: int | None = None) -> np.ndarray:
    """A column of ones, then the features."""
    n = rows if rows is not None else len(next(iter(x.values())))
    return np.column_stack([np.ones(n), *(x[c] for c in features)])
