"""Choosing features: how each one alone tells the target, a screen with advice, and a table of what is selected and why.

All features are scored together. Numbers (with their gaps at the median) and categories (as their rate of events) become
rows of (feature, value) that are counted before anything else, so a score needs the distinct values only, summed within
ranges of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import category
from gritstone.operators.diagnostics import correlation_matrix
from gritstone.operators.quantiles import quantiles_of, running_shares
from gritstone.operators.ranges import count_below, free_name

#: Categories with weights of evidence of their own in a screen; the others are one.
TOP_LEVELS = 50


def _long(features: list[str], value) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("f"), value(c).alias("v")) for k, c in enumerate(features)))).alias("x")


def medians(table: DataFrame, numeric: list[str]) -> dict[str, float | None]:
    found = quantiles_of(table, {c: F.col(c) for c in numeric}, {c: [0.5] for c in numeric})
    return {c: q[0] for c, q in found.items()}


def univariate_scores(train: DataFrame, numeric: list[str], categorical: list[str], target: str) -> dict[str, float]:
    """2 |AUC - 1/2| of each feature alone for a target of 0 and 1, ties counting half; 0 for a feature with one value.

    A gap in a number counts as its median, in a category as the level Missing; a category's level stands for its rate.
    """
    known = train.where(F.col(target).isNotNull())
    middle = medians(known, numeric)
    hits, others = (F.sum(c).cast("bigint") for c in (F.col(target), 1 - F.col(target)))
    counts = None
    if numeric:
        rows = known.select(F.col(target).cast("int").alias(target), _long(numeric, lambda c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double"))))
        counts = rows.where("x.v IS NOT NULL").groupBy("x.f", "x.v").agg(hits.alias("pos"), others.alias("neg"))
    if categorical:
        rows = known.select(F.col(target).cast("int").alias(target), _long(categorical, category))
        levels = rows.groupBy("x.f", "x.v").agg(hits.alias("pos"), others.alias("neg"))
        rates = levels.groupBy((F.col("f") + len(numeric)).alias("f"), (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("v")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counts = rates if counts is None else counts.unionByName(rates)
    if counts is None:
        return {}
    ranked = running_shares(counts, "v", ["pos", "neg"], by=("f",))
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)) / F.first("pos_all") / F.first("neg_all")
    found = {r["f"]: r["auc"] for r in ranked.where("pos_all > 0 AND neg_all > 0").groupBy("f").agg(wins.alias("auc")).collect()}
    return {c: abs(found.get(k, 0.5) - 0.5) * 2 for k, c in enumerate([*numeric, *categorical])}


def information_values(train: DataFrame, numeric: list[str], categorical: list[str], target: str, bins: int = 10) -> dict[str, float]:
    """IV over quantile bins of a number (gaps left out) and over the TOP_LEVELS levels of a category, the rest as Other.

    Events and others of a bin are counted with half a row more each before shares are taken.
    """
    known = train.select(*numeric, *categorical, F.coalesce(F.col(target), F.lit(0)).cast("int").alias("y__"))
    edges = quantiles_of(known, {c: F.col(c) for c in numeric}, {c: [k / bins for k in range(bins + 1)] for c in numeric})
    counts = None
    if numeric:
        cuts = {c: sorted({q for q in edges[c] if q is not None})[1:-1] for c in numeric}
        rows = known.select("y__", _long(numeric, lambda c: F.when(F.col(c).isNotNull(), count_below(F.col(c).cast("double"), cuts[c])).cast("string")))
        counts = rows.where("x.v IS NOT NULL").groupBy("x.f", "x.v").agg(F.sum("y__").alias("bad"), F.count("*").alias("n"))
    if categorical:
        levels = known.select("y__", _long(categorical, category)).groupBy((F.col("x.f") + len(numeric)).alias("f"), "x.v").agg(F.sum("y__").alias("bad"), F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "v"))
        levels = levels.withColumn("v", F.when(place <= TOP_LEVELS, F.concat(F.lit("="), "v")).otherwise("Other")).groupBy("f", "v").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        counts = levels if counts is None else counts.unionByName(levels)
    if counts is None:
        return {}
    own = Window.partitionBy("f")
    bad, good = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    b, g = bad / F.sum(bad).over(own), good / F.sum(good).over(own)
    found = {r["f"]: r["iv"] for r in counts.select("f", ((b - g) * F.log(b / g)).alias("part")).groupBy("f").agg(F.sum("part").alias("iv")).collect()}
    return {c: found.get(k, 0.0) for k, c in enumerate([*numeric, *categorical])}


def stability(table: DataFrame, base: Column, numeric: list[str], categorical: list[str], bins: int = 10, floor: float = 1e-4) -> dict[str, float]:
    """PSI of each feature between the rows of `base` and all others, by shares of at least `floor`.

    Numbers fall into quantile bins of the base; what lies outside its range, and gaps, are a bin beside them. Categories
    are bins themselves. A number with fewer than two bins has no index, and without rows on either side nothing has.
    """
    expected = table.where(base)
    found = quantiles_of(expected, {c: F.col(c) for c in numeric}, {c: [k / bins for k in range(bins + 1)] for c in numeric})
    edges = {c: sorted({q for q in found[c] if q is not None}) for c in numeric}
    usable = [c for c in numeric if len(edges[c]) > 2]

    def binned(c: str) -> Column:
        x, e = F.col(c).cast("double"), edges[c]
        return F.when(x.between(e[0], e[-1]), F.greatest(count_below(x, e[1:-1]), F.lit(0)).cast("string")).otherwise("outside")

    names = [*usable, *categorical]
    if not names:
        return {}
    rows = table.select(base.alias("base"), _long(names, lambda c: binned(c) if c in usable else category(c)))
    counts = rows.groupBy("x.f", "x.v").agg(F.sum(F.col("base").cast("int")).alias("e"), F.sum((~F.col("base")).cast("int")).alias("a"))
    own = Window.partitionBy("f")
    counts = counts.withColumns({f"{c}_all": F.sum(c).over(own) for c in "ea"}).where("e_all > 0 AND a_all > 0")  # else there is nothing to compare
    e, a = (F.greatest(F.col(c) / F.col(f"{c}_all"), F.lit(floor)) for c in "ea")
    sums = counts.select("f", ((a - e) * F.log(a / e)).alias("part")).groupBy("f").agg(F.sum("part").alias("psi")).collect()
    return {names[r["f"]]: r["psi"] for r in sums}


def prescreen(table: DataFrame, numeric: list[str], categorical: list[str], target: str, base: Column, most_levels: int = 500, most_ratio: float = 0.2) -> DataFrame:
    """One row per feature of the base rows: missing and distinct values, variance, how it tells the target alone, IV,
    PSI against the other rows, and advice: exclude what is (almost) always missing, constant, or a category of very many levels.

    The columns are kept while the screen runs, so the source is read once.
    """
    features = [*numeric, *categorical]
    mark = free_name("base__", table.columns)
    kept = table.select(*dict.fromkeys([*features, target]), base.alias(mark)).persist()
    try:
        return _screened(kept, numeric, categorical, target, F.col(mark), most_levels, most_ratio)
    finally:
        kept.unpersist()


def _screened(table: DataFrame, numeric: list[str], categorical: list[str], target: str, base: Column, most_levels: int, most_ratio: float) -> DataFrame:
    train, features = table.where(base), [*numeric, *categorical]
    held = train.agg(
        F.count("*").alias("n"),
        *(e for k, c in enumerate(features) for e in (F.count(c).alias(f"c{k}"), F.count_distinct(c).alias(f"d{k}"))),
        *(F.var_samp(F.col(c).cast("double")).alias(f"v{k}") for k, c in enumerate(numeric)),
    ).first()
    scores, iv, psi = univariate_scores(train, numeric, categorical, target), information_values(train, numeric, categorical, target), stability(table, base, numeric, categorical)
    rows = []
    for k, c in enumerate(features):
        n, known, distinct = held["n"], held[f"c{k}"], held[f"d{k}"]
        variance = held[f"v{k}"] if c in numeric else None
        missing, ratio = 1 - known / n if n else 0.0, distinct / max(known, 1)
        reasons = [name for name, is_so in (("very_high_missingness", missing >= 0.95), ("low_variance", distinct <= 1 or variance is not None and variance <= 1e-12), ("high_cardinality_categorical", c in categorical and (distinct > most_levels or ratio > most_ratio))) if is_so]
        rows.append((c, "numeric" if c in numeric else "categorical", n, missing, distinct, variance, scores.get(c), iv.get(c), psi.get(c), "exclude" if reasons else "retain", ",".join(reasons) or "screen_passed"))
    schema = "feature string, type string, n bigint, missing double, distinct_values bigint, variance double, score double, iv double, psi double, action string, reason string"
    return table.sparkSession.createDataFrame(rows, schema)


@dataclass
class Rules:
    """What a selection goes by; locked features beat every rule, a locked exclusion beats a locked inclusion."""

    least_score: float | None = None
    most_correlation: float | None = None
    most_features: int | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass
class Choice:
    feature: str
    kind: str
    score: float
    selected: bool
    reason: str


def decide(scores: dict[str, float], kinds: dict[str, str], correlated: dict[tuple[str, str], float], rules: Rules) -> list[Choice]:
    """The rules in their order, over features by falling score and name: locks, least score, correlation, cap."""
    order = sorted(scores, key=lambda c: (-scores[c], c))
    out: dict[str, str] = {c: "locked_exclude" for c in rules.exclude if c in scores}
    locked = [c for c in dict.fromkeys(rules.include) if c in scores and c not in out]
    if rules.least_score is not None:
        out |= {c: "below_univariate_threshold" for c in order if c not in out and c not in locked and scores[c] < rules.least_score}
    if rules.most_correlation is not None:
        kept: list[str] = []
        for c in (c for c in order if kinds[c] == "numeric" and c not in out):
            rivals = [o for o in kept if correlated.get((c, o), 0.0) >= rules.most_correlation]
            if rivals and c not in locked:
                out[c] = f"correlated_with:{max(rivals, key=lambda o: scores[o])}"  # of equal scores the first kept
            else:
                kept.append(c)
    if rules.most_features is not None:
        room = rules.most_features - len(locked)
        for c in (c for c in order if c not in out and c not in locked):
            if room <= 0:
                out[c] = "max_feature_cap"
            room -= 1
    choices = [Choice(c, kinds[c], scores[c], c not in out, out.get(c, "locked_include" if c in locked else "screen_passed")) for c in order]
    return sorted(choices, key=lambda c: (not c.selected, -c.score, c.feature))


def reviewed(choices: list[Choice], verdicts: dict[str, tuple[bool, str]]) -> list[Choice]:
    """The choices after a manual review: feature -> (selected, why); others stay as they are."""
    out = [Choice(c.feature, c.kind, c.score, verdicts[c.feature][0], f"manual_review:{verdicts[c.feature][1]}") if c.feature in verdicts else c for c in choices]
    return sorted(out, key=lambda c: (not c.selected, -c.score, c.feature))


def select_features(train: DataFrame, numeric: list[str], categorical: list[str], target: str, rules: Rules) -> list[Choice]:
    """Scores, then the rules; correlations are those of numbers with their gaps at the median, in one aggregate."""
    train = train.select(*dict.fromkeys([*numeric, *categorical, target])).persist()
    try:
        return _selected(train, numeric, categorical, target, rules)
    finally:
        train.unpersist()


def _selected(train: DataFrame, numeric: list[str], categorical: list[str], target: str, rules: Rules) -> list[Choice]:
    scores = univariate_scores(train, numeric, categorical, target)
    kinds = dict.fromkeys(numeric, "numeric") | dict.fromkeys(categorical, "categorical")
    correlated = {}
    if rules.most_correlation is not None and len(numeric) > 1:
        middle = medians(train, numeric)
        matrix = np.abs(correlation_matrix(train.select(*(F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")).alias(c) for c in numeric)), numeric))
        correlated = {(a, b): float(matrix[i, j]) for i, a in enumerate(numeric) for j, b in enumerate(numeric) if i != j}
    return decide(scores, kinds, correlated, rules)


def choice_table(df: DataFrame, choices: list[Choice]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c.feature, c.kind, float(c.score), c.selected, c.reason) for c in choices], "feature string, type string, score double, selected boolean, reason string")
