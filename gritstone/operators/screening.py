"""Screens of candidate features: all pairwise products from one tensor of moments, and a table that selects features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalars import category
from gritstone.operators.blocks import block_sums, doubles

#: Moments of a product that a screen sums: rows, sum, squares, with the target, and the target's own sum and squares there.
KINDS = 6
#: Columns of a block of the tensor; a task holds KINDS * BLOCK^2 numbers per pair of blocks it works on.
BLOCK = 128


@dataclass
class Candidate:
    kind: str  # numeric_numeric or categorical_numeric
    source: str
    secondary: str
    level: str | None
    score: float
    rows: int
    selected: bool = False

    def column(self) -> Column:
        """The product itself."""
        x = F.col(self.source).cast("double")
        return x * (F.col(self.secondary).cast("double") if self.level is None else (category(self.secondary) == self.level).cast("double"))


def correlations(moments: np.ndarray, least_rows: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """|r| of each product with the target (NaN where there is none), and its rows; moments: KINDS x products."""
    n, s, ss, sy, y, yy = moments
    with np.errstate(divide="ignore", invalid="ignore"):
        spread, target = ss - s * s / n, yy - y * y / n
        r = np.abs((sy - s * y / n) / np.sqrt(spread * target))
    return np.where((n >= least_rows) & (spread > 1e-12 * np.abs(ss)) & (target > 1e-12 * np.abs(yy)), np.minimum(r, 1.0), np.nan), n


def product_moments(held: DataFrame, left: list[str], right: list[str], target: str) -> np.ndarray:
    """KINDS x left x right: moments of every product over the rows where both factors and the target are known."""

    def part(x: dict[str, np.ndarray]) -> np.ndarray:
        y = x[target]
        known = ~np.isnan(y)
        y = np.where(known, y, 0.0)
        a, b = (np.column_stack([x[c] for c in side]) for side in (left, right))
        both = (~np.isnan(a) & known[:, None]).astype(float), (~np.isnan(b)).astype(float)
        a, b = np.nan_to_num(a) * both[0], np.nan_to_num(b)
        col = y[:, None]
        return np.concatenate([(u.T @ v).ravel() for u, v in ((both[0], both[1]), (a, b), (a * a, b * b), (a * col, b), (both[0] * col, both[1]), (both[0] * col * col, both[1]))])

    return block_sums(held.select(*dict.fromkeys([*left, *right, target])), KINDS * len(left) * len(right), part).reshape(KINDS, len(left), len(right))


def interaction_screen(table: DataFrame, numeric: list[str], categorical: list[str], target: str, least_score: float = 0.0, most: int | None = None, levels: int = 5, least_rows: int = 10) -> list[Candidate]:
    """All products of two numeric features, and of a numeric feature and one of a category's `levels` most frequent levels,
    by falling |r| with the target, then kind and names; those with at least `least_score`, of which `most` are selected.

    One pass over the rows sums the moments of all pairs (in blocks of BLOCK columns if there are more); no product becomes
    a column. Products of fewer than `least_rows` rows or without spread are left out. Equally frequent levels go by name.
    """
    tops: dict[str, list[str]] = {}
    for c in categorical:
        counted = table.groupBy(category(c).alias("level")).count().orderBy(F.desc("count"), "level").limit(levels).collect()
        tops[c] = [r["level"] for r in counted]
    flags = {f"f{k}": (c, v) for k, (c, v) in enumerate((c, v) for c in categorical for v in tops[c])}
    names = {f"x{j}": c for j, c in enumerate(numeric)}
    held = doubles(table.select(*(F.col(c).alias(n) for n, c in names.items()), F.col(target).alias("y"), *((category(c) == v).cast("double").alias(n) for n, (c, v) in flags.items())), [*names, "y", *flags], whole=False).persist()
    try:
        # the target is centred, which changes no correlation but keeps sums small
        level = held.agg(F.avg("y")).first()[0] or 0.0
        held = held.withColumn("y", F.col("y") - float(level))
        found = []
        xs, fs = list(names), list(flags)
        pieces = [xs[k : k + BLOCK] for k in range(0, len(xs), BLOCK)]
        for a, left in enumerate(pieces):
            for right in [*pieces[a:], *(fs[k : k + BLOCK] for k in range(0, len(fs), BLOCK))]:
                moments = product_moments(held, left, right, "y")
                scores, rows = correlations(moments.reshape(KINDS, -1), least_rows)
                for at, (score, n) in enumerate(zip(scores.tolist(), rows.tolist(), strict=True)):
                    one, other = left[at // len(right)], right[at % len(right)]
                    if score != score or score < least_score:
                        continue
                    if other in flags:
                        c, v = flags[other]
                        found.append(Candidate("categorical_numeric", names[one], c, v, score, int(n)))
                    elif int(one[1:]) < int(other[1:]):
                        found.append(Candidate("numeric_numeric", names[one], names[other], None, score, int(n)))
    finally:
        held.unpersist()
    found.sort(key=lambda c: (-c.score, c.kind, c.source, c.secondary, c.level or ""))
    for c in found[: len(found) if most is None else most]:
        c.selected = True
    return found


def candidate_table(df: DataFrame, found: list[Candidate]) -> DataFrame:
    rows = [(c.kind, c.source, c.secondary, c.level, c.score, c.rows, c.selected) for c in found]
    return df.sparkSession.createDataFrame(rows, "kind string, source string, secondary string, level string, score double, n bigint, selected boolean")
