"""Scorecards: bins merged until bad rates are monotone, weights of evidence with a bin for missing values, points, reasons.

One grouped count over fine bins is all a feature's bins need; merging works on these few counts at the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.operators.binning import bin_number, quantile_edges
from gritstone.operators.models import Linear, Scorecard, iteratively_reweighted

MISSING = "MISSING"


def merged_edges(edges: list[float], counts: list[int], bads: list[int], min_share: float, monotone: bool = True) -> list[float]:
    """Edges that remain: first bins below the share join a neighbour, then the first pair out of order is joined, again
    and again. The order is that of the correlation of bin number and bad rate; two bins always remain."""
    edges, n, bad = list(edges), list(map(float, counts)), list(map(float, bads))

    def join(k: int) -> None:
        """Bins k and k + 1 become one."""
        del edges[k]
        for held in (n, bad):
            held[k : k + 2] = [held[k] + held[k + 1]]

    while len(n) > 2:
        small = [k for k in range(len(n)) if n[k] < min_share * sum(n)]
        if small:
            join(min(small[0], len(n) - 2))
            continue
        rates = [b / m for b, m in zip(bad, n, strict=True)]
        rising = np.cov(range(len(n)), rates, fweights=None, aweights=n)[0, 1] >= 0
        wrong = [k for k in range(len(n) - 1) if (rates[k + 1] < rates[k]) == rising and rates[k + 1] != rates[k]]
        if not monotone or not wrong:
            break
        join(wrong[0])
    return edges


def fit_edges(train: DataFrame, feature: str, target: str, bins: int = 5, min_share: float = 0.05, monotone: bool = True) -> list[float]:
    edges = quantile_edges(train, feature, min(bins, max(2, int(1 / min_share))))
    rows = train.where(F.col(feature).isNotNull()).groupBy(bin_number(F.col(feature), edges).alias("b")).agg(F.count("*").alias("n"), F.sum(target).alias("bad")).collect()
    held = {r["b"]: (r["n"], r["bad"]) for r in rows}
    counts, bads = zip(*(held.get(k, (0, 0)) for k in range(len(edges) + 1)), strict=True)
    return merged_edges(edges, counts, bads, min_share, monotone)


def bucket(feature: str, edges: list[float] | None) -> Column:
    """The label of a value's bin: its number, the category itself without edges, or MISSING."""
    label = F.col(feature).cast("string") if edges is None else bin_number(F.col(feature).cast("double"), edges).cast("string")
    return F.coalesce(label, F.lit(MISSING))


def evidence(train: DataFrame, features: dict[str, list[float] | None], target: str, smoothing: float = 0.5) -> DataFrame:
    """feature, bucket, total, bad, good, woe, iv of all features in one job; features: name -> edges, None for categories."""
    labels = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), bucket(f, e).alias("bucket")) for f, e in features.items())))
    held = train.where(F.col(target).isNotNull()).select(F.col(target).cast("bigint").alias("bad"), labels.alias("x")).groupBy("x.feature", "x.bucket").agg(F.count("*").alias("total"), F.sum("bad").alias("bad"))
    totals = held.groupBy("feature").agg(F.sum("bad").alias("all_bad"), F.sum(F.col("total") - F.col("bad")).alias("all_good"), F.count("*").alias("k"))
    part = lambda count, every: (count + smoothing) / F.greatest(F.col(every) + smoothing * F.col("k"), F.lit(1.0))
    bad, good = part(F.col("bad"), "all_bad"), part(F.col("good"), "all_good")
    joined = held.join(F.broadcast(totals), "feature").withColumn("good", F.col("total") - F.col("bad"))  # one row per feature
    return joined.select("feature", "bucket", "total", "bad", "good", F.log(good / bad).alias("woe"), ((good - bad) * F.log(good / bad)).alias("iv"))


@dataclass
class FittedScorecard:
    """Weights by feature and bucket, the weight of unseen buckets (the mean by count), and the logistic model on them."""

    edges: dict[str, list[float] | None]
    weights: dict[str, dict[str, float]]
    unseen: dict[str, float]
    model: Linear
    card: Scorecard

    def weight(self, feature: str) -> Column:
        held = self.weights[feature]
        found = F.try_element_at(F.create_map(*(F.lit(x) for pair in held.items() for x in pair)), bucket(feature, self.edges[feature]))
        return F.coalesce(found, F.lit(self.unseen[feature]))

    def apply(self, table: DataFrame, reasons: int = 3) -> DataFrame:
        """The table with points per feature (points_<feature>), score and the features with the fewest points."""
        points = {f"points_{f}": -self.card.factor * float(b) * self.weight(f) for f, b in zip(self.model.features, self.model.coefficients[1:], strict=True)}
        out = table.withColumns(points)
        least = F.array_sort(F.array(*(F.struct(F.col(f"points_{f}").alias("points"), F.lit(f).alias("name")) for f in self.model.features)))
        score = sum((F.col(c) for c in points), F.lit(self.card.offset(float(self.model.coefficients[0]))))
        return out.withColumns({"score_points": score, "reasons": F.transform(F.slice(least, 1, reasons), lambda x: x["name"])})


def fit_scorecard(train: DataFrame, features: dict[str, list[float] | None], target: str, card: Scorecard | None = None) -> FittedScorecard:
    """Logistic regression on the weights of evidence of every feature."""
    rows = evidence(train, features, target).collect()
    weights = {f: {r["bucket"]: r["woe"] for r in rows if r["feature"] == f} for f in features}
    unseen = {f: float(np.average([r["woe"] for r in rows if r["feature"] == f], weights=[r["total"] for r in rows if r["feature"] == f])) for f in features}
    fitted = FittedScorecard(features, weights, unseen, None, card or Scorecard())
    held = train.select(*(fitted.weight(f).alias(f) for f in features), target)
    fitted.model = iteratively_reweighted(held, list(features), target)
    return fitted
