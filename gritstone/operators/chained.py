"""Chained imputation: each incomplete column is regressed on all others in turn, round after round.

Gaps start at the column's mean over training rows. A step takes the moments of the rows that have the column, over the
table as imputed so far, fits a Bayesian ridge regression to them at the driver, and predicts the gaps; the next step sees
them. Rows without gaps give the same moments to every step, so they are summed once; the others are kept with what is
imputed so far and are checkpointed once a round, so neither a step's work nor the lineage grows with the rounds. Within
a round a step repeats the round's earlier steps in its own task instead of writing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.operators.blocks import block_sums, doubles
from gritstone.sources.scratch import checkpointed


def bayesian_ridge(gram: np.ndarray, moment: np.ndarray, square: float, n: float, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """Coefficients for centred moments X'X, X'y and y'y of n rows.

    Noise precision a and weight precision l are re-estimated from the effective number of parameters until the
    coefficients move by less than `tolerance` in sum; both have a gamma prior with shape and rate `prior`.
    """
    values, vectors = np.linalg.eigh(gram)
    values, turned = np.maximum(values, 0), vectors.T @ moment
    a, l, last = 1 / (square / n + np.finfo(float).eps), 1.0, None  # noqa: E741
    for _ in range(rounds):
        b = vectors @ (turned / (values + l / a))
        rest = max(square - 2 * b @ moment + b @ gram @ b, 0.0)
        if last is not None and np.abs(last - b).sum() < tolerance:
            break
        last = b
        used = (a * values / (l + a * values)).sum()
        l = (used + 2 * prior) / (b @ b + 2 * prior)  # noqa: E741
        a = (n - used + 2 * prior) / (rest + 2 * prior)
    return vectors @ (turned / (values + l / a))


@dataclass
class Step:
    """Predicts column `at` from all others: intercept and one slope per column (0 for its own)."""

    at: int
    intercept: float
    slopes: np.ndarray


def _replayed(values: np.ndarray, gaps: np.ndarray, steps: list[Step]) -> np.ndarray:
    for s in steps:
        row = gaps[:, s.at]
        values[row, s.at] = values[row] @ s.slopes + s.intercept
    return values


@dataclass
class Chained:
    columns: list[str]
    means: np.ndarray
    rounds: list[list[Step]]
    moved: list[float]  # the largest change of a value in each round
    converged: bool

    def transform(self, table: DataFrame) -> DataFrame:
        """The table with every gap of the columns filled, by the same steps; a narrow pass in batches."""
        columns, means, steps = self.columns, self.means, [s for r in self.rounds for s in r]
        at = [table.columns.index(c) for c in columns]

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at])
                gaps = ~np.isfinite(held)
                filled = _replayed(np.where(gaps, means, held), gaps, steps)
                for j, k in enumerate(at):
                    batch = batch.set_column(k, pa.field(batch.schema.names[k], pa.float64()), pa.array(filled[:, j]))
                yield batch

        cast = table.withColumns({c: F.col(c).cast("double") for c in columns})
        return cast.mapInArrow(fill, T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in cast.schema.fields]))


def chained_imputer(train: DataFrame, columns: list[str], rounds: int = 10, tolerance: float = 1e-3) -> Chained:
    """Learns the steps from training rows; columns in the order of their gaps, fewest first, then by name.

    Ends early once no value moves by more than `tolerance` times the largest known value. Values that are not finite
    count as gaps. A column without any value is an error; a row of gaps only takes part with its means.
    """
    k = len(columns)
    known = doubles(train, columns, whole=False)
    row = known.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{j}") for j, c in enumerate(columns) for name, f in (("m", F.avg), ("c", F.count), ("x", lambda c: F.max(F.abs(c)))))).first()
    if not all(row[f"c_{j}"] for j in range(k)):
        raise ValueError("a column has no value in the training rows")
    means = np.array([row[f"m_{j}"] for j in range(k)])
    missing = [row["n"] - row[f"c_{j}"] for j in range(k)]
    order = sorted((j for j in range(k) if missing[j]), key=lambda j: (missing[j], columns[j]))
    limit = tolerance * max(row[f"x_{j}"] for j in range(k))
    any_gap = F.lit(False)
    for c in columns:
        any_gap = any_gap | F.col(c).isNull()
    size = (k + 1) ** 2

    def moments(values: np.ndarray) -> np.ndarray:
        wide = np.column_stack([np.ones(len(values)), values - means])
        return (wide.T @ wide).ravel()

    complete = block_sums(known.where(~any_gap), size, lambda x: moments(np.column_stack([x[c] for c in columns])))
    # g: the gaps as a number of bits; the columns hold what is imputed so far
    bits = sum((F.when(F.col(c).isNull(), F.lit(1 << j)).otherwise(F.lit(0)) for j, c in enumerate(columns)), F.lit(0).cast("bigint"))
    state = known.where(any_gap).select(*(F.coalesce(F.col(c), F.lit(float(m))).alias(f"v{j}") for j, (c, m) in enumerate(zip(columns, means, strict=True))), bits.alias("g"))
    state = checkpointed(state)
    history, moved, converged = [], [], not order

    def unpacked(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([x[f"v{j}"] for j in range(k)]), (x["g"].astype(np.int64)[:, None] >> np.arange(k)) & 1 == 1

    for _ in range(rounds if order else 0):
        steps: list[Step] = []
        for at in order:

            def part(x: dict[str, np.ndarray], at: int = at, steps: tuple[Step, ...] = tuple(steps)) -> np.ndarray:
                values, gaps = unpacked(x)
                return moments(_replayed(values, gaps, list(steps))[~gaps[:, at]])

            whole = (complete + block_sums(state, size, part)).reshape(k + 1, k + 1)
            n, others = whole[0, 0], np.delete(np.arange(k), at)
            centre = whole[0, 1:] / n
            spread = whole[1:, 1:] - n * np.outer(centre, centre)
            slopes = np.zeros(k)
            slopes[others] = bayesian_ridge(spread[np.ix_(others, others)], spread[others, at], spread[at, at], n)
            shift = means + centre
            steps.append(Step(at, float(shift[at] - slopes @ shift), slopes))
        history.append(steps)
        state, change = _advanced(state, k, steps)
        moved.append(change)
        if change < limit:
            converged = True
            break
    return Chained(columns, means, history, moved, converged)


def _advanced(state: DataFrame, k: int, steps: list[Step]) -> tuple[DataFrame, float]:
    """The state after a round, and the largest change of a value."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(j).to_numpy() for j in range(k)])
            gaps = (batch.column(k).to_numpy()[:, None] >> np.arange(k)) & 1 == 1
            new = _replayed(values.copy(), gaps, steps)
            change = np.abs(new - values).max(axis=1) if len(values) else np.zeros(0)
            yield pa.record_batch([*(pa.array(new[:, j]) for j in range(k)), batch.column(k), pa.array(change)], names=[*(f"v{j}" for j in range(k)), "g", "change"])

    schema = ", ".join([*(f"v{j} double" for j in range(k)), "g bigint", "change double"])
    following = checkpointed(state.select(*(f"v{j}" for j in range(k)), "g").mapInArrow(advance, schema))
    change = following.agg(F.max("change")).first()[0]
    return following, float(change or 0.0) if change is None or math.isfinite(change) else math.inf
