"""Governed transformations: parameters learned on training rows, replayed as column expressions everywhere.

A plan of transforms is fitted together: everything that needs an aggregate of a numeric column comes from one job over
the training rows. Fitted transforms are plain numbers, so all of them fuse into one projection; temporal ones are windows
within a split and entity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import DAYS_PER_MONTH, clipped_between, divided, let
from gritstone.operators.quantiles import quantiles_of
from gritstone.operators.ranges import constants, count_below


@dataclass(frozen=True)
class Transform:
    kind: str
    source: str
    output: str | None = None
    second: str | None = None
    value: object = None
    window: int = 3
    lag: int = 1
    low: float = 0.01
    high: float = 0.99
    columns: tuple[str, ...] = ()


@dataclass
class Fitted:
    spec: Transform
    params: dict = field(default_factory=dict)


#: What a numeric transform learns, as (parameter, aggregate of the column).
_FITS = {
    "capped_zscore": lambda s, x: {"mean": F.avg(x), "std": F.stddev_pop(x)},
    "standard_scale": lambda s, x: {"mean": F.avg(x), "std": F.stddev_pop(x)},
    "min_max_scale": lambda s, x: {"low": F.min(x), "high": F.max(x)},
    "log1p": lambda s, x: {"low": F.min(x)},
    "center_mean": lambda s, x: {"mean": F.avg(x)},
    "normal_score": lambda s, x: {"n": F.count(x)},
    "date_age_days": lambda s, x: {"last": F.max(s.source)},
    "date_age_months": lambda s, x: {"last": F.max(s.source)},
}


_GRID = [k / 1000 for k in range(1001)]
#: The quantiles of the column that a transform learns, and the parameters that they make.
_QUANTILES = {
    "winsorize": (lambda s: [s.low, s.high], lambda q: {"low": q[0], "high": q[1]}),
    "robust_scale": (lambda s: [0.25, 0.5, 0.75], lambda q: {"q": None if None in q else q}),
    "center_median": (lambda s: [0.5], lambda q: {"q": q[0]}),
    "percentile_rank": (lambda s: _GRID, lambda q: {"grid": q}),
    "normal_score": (lambda s: _GRID, lambda q: {"grid": q}),
}


def _learned_quantiles(train: DataFrame, specs: list[Transform]) -> dict[int, dict]:
    """Parameters by the number of the transform; the columns' values are counted together, once."""
    own = {k: s for k, s in enumerate(specs) if s.kind in _QUANTILES}
    points = {s.source: sorted({p for o in own.values() if o.source == s.source for p in _QUANTILES[o.kind][0](o)}) for s in own.values()}
    found = quantiles_of(train, {c: F.col(c).try_cast("double") for c in points}, points)
    at = {c: dict(zip(points[c], found[c], strict=True)) for c in points}
    return {k: _QUANTILES[s.kind][1]([at[s.source][p] for p in _QUANTILES[s.kind][0](s)]) for k, s in own.items()}


def fit(train: DataFrame, specs: list[Transform]) -> list[Fitted]:
    """One aggregate over the training rows for all transforms that need any, and one count of values for all quantiles."""
    wanted = {}
    for k, s in enumerate(specs):
        for name, agg in _FITS.get(s.kind, lambda s, x: {})(s, F.col(s.source).try_cast("double") if not s.kind.startswith("date") else F.col(s.source)).items():
            wanted[k, name] = agg
    row = train.agg(*(a.alias(f"{k}_{n}") for (k, n), a in wanted.items())).first() if wanted else None
    out = [Fitted(s) for s in specs]
    for k, n in wanted:
        out[k].params[n] = row[f"{k}_{n}"]
    for k, params in _learned_quantiles(train, specs).items():
        out[k].params |= params
    for f in out:
        if f.spec.kind in ("box_cox", "yeo_johnson") and f.spec.value is None:
            f.params["lambda"] = _power_lambda(train, f.spec)
    return out


def _power_lambda(train: DataFrame, spec: Transform) -> float:
    """Maximum likelihood over a grid from -2 to 2, refined twice; each grid is one aggregate job over the kept column."""
    x = F.col("x")
    held = train.select(F.col(spec.source).try_cast("double").alias("x")).where(x > 0 if spec.kind == "box_cox" else x.isNotNull()).persist()
    jacobian = F.sum(F.log(x)) if spec.kind == "box_cox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
    centre, step = 0.0, 0.25
    try:
        for _ in range(3):
            grid = [centre + step * k for k in range(-8, 9)]
            row = held.agg(F.count("*").alias("n"), jacobian.alias("j"), *(F.var_pop(_power(spec.kind, x, g)).alias(f"v{k}") for k, g in enumerate(grid))).first()
            if not row["n"] or any(row[f"v{k}"] in (None, 0.0) for k in range(len(grid))):
                return 1.0
            centre = max(grid, key=lambda g: -row["n"] / 2 * math.log(row[f"v{grid.index(g)}"]) + (g - 1) * row["j"])
            step /= 8
        return centre
    finally:
        held.unpersist()


def _power(kind: str, x: Column, p: float) -> Column:
    if kind == "box_cox":
        return F.when(x > 0, F.log(x) if abs(p) < 1e-9 else (F.pow(x, F.lit(p)) - 1) / p)
    above = F.log1p(x) if abs(p) < 1e-9 else (F.pow(x + 1, F.lit(p)) - 1) / p
    below = -F.log1p(-x) if abs(p - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - p)) - 1) / (2 - p)
    return F.when(x >= 0, above).when(x < 0, below)


def _scaled(x: Column, centre: float, spread: float | None) -> Column:
    return (x - centre) / spread if spread else F.lit(0.0)


def _interpolated(x: Column, grid: list[float]) -> Column:
    """Position of x among the distinct grid values, spaced evenly on [0, 1]; a single value gives 1/2."""
    points = sorted(set(v for v in grid or () if v is not None))
    if len(points) < 2:
        return F.when(x.isNotNull(), 0.5)
    last, grid = len(points) - 1, constants(points)

    def place(v: Column) -> Column:
        # a point itself stands at the end of the piece below it, which gives the same
        k, x = F.greatest(F.least(v["k"], F.lit(last)), F.lit(1)), v["x"]
        low, high = F.get(grid, k - 1), F.get(grid, k)
        return F.when(x.isNotNull(), clipped_between((k - 1 + (x - low) / (high - low)) / last, 0.0, 1.0))

    return let(F.struct(count_below(x, points).alias("k"), x.alias("x")), place)


#: Numerator and denominator of the middle, then of the tails.
NORMAL_COEFFICIENTS = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)


def inverse_normal(p: Column) -> Column:
    """Acklam's rational approximation (relative error below 1.2e-9), as an expression."""
    a, b, c, d = NORMAL_COEFFICIENTS

    def poly(coefficients, x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    inner = lambda q: let(q * q, lambda r: q * poly(a, r) / poly(b, r))
    outer = lambda p: let(F.sqrt(-2 * F.log(F.least(p, 1 - p))), lambda t: poly(c, t) / poly(d, t))
    return let(p, lambda p: F.when((p > 0.02425) & (p < 0.97575), let(p - 0.5, inner)).when(p <= 0.02425, outer(p)).otherwise(-outer(p)))


def column(f: Fitted, entity: str | None = None, date: str | None = None, tie: str | None = None) -> Column:
    """The expression of a fitted transform; temporal kinds look at the rows of one split (and entity) in time order."""
    s, p = f.spec, f.params
    x = F.col(s.source)
    number = x.try_cast("double")
    b = F.col(s.second).try_cast("double") if s.second else None
    k = s.kind
    plain = {
        "winsorize": lambda: clipped_between(number, p["low"], p["high"]),
        "log1p": lambda: F.log1p(number) if p["low"] is not None and p["low"] > -1 else F.lit(None).cast("double"),
        "box_cox": lambda: _power(k, number, s.value if s.value is not None else p["lambda"]),
        "yeo_johnson": lambda: _power(k, number, s.value if s.value is not None else p["lambda"]),
        "capped_zscore": lambda: clipped_between(_scaled(number, p["mean"], p["std"]), -(s.value or 3.0), s.value or 3.0) if p["std"] else F.lit(0.0),
        "piecewise_linear": lambda: F.when(number.isNotNull(), F.greatest(number - s.value, F.lit(0.0))),
        "standard_scale": lambda: _scaled(number, p["mean"], p["std"]),
        "robust_scale": lambda: _scaled(number, p["q"][1], p["q"][2] - p["q"][0]) if p["q"] else F.lit(None).cast("double"),
        "min_max_scale": lambda: _scaled(number, p["low"], p["high"] - p["low"]) if p["low"] is not None else F.lit(None).cast("double"),
        "percentile_rank": lambda: _interpolated(number, p["grid"]),
        "normal_score": lambda: inverse_normal(clipped_between(_interpolated(number, p["grid"]), 0.5 / max(p["n"], 1), 1 - 0.5 / max(p["n"], 1))),
        "signed_log1p": lambda: F.signum(number) * F.log1p(F.abs(number)),
        "sqrt": lambda: F.when(number >= 0, F.sqrt(number)),
        "reciprocal": lambda: divided(F.lit(1.0), number),
        "square": lambda: number * number,
        "power": lambda: F.when(~F.isnan(F.pow(number, F.lit(float(s.value)))), F.pow(number, F.lit(float(s.value)))),
        "absolute_value": lambda: F.abs(number),
        "center_mean": lambda: number - p["mean"],
        "center_median": lambda: number - p["q"],
        "ratio": lambda: divided(number, b),
        "safe_ratio": lambda: divided(number, b),
        "debt_service_ratio": lambda: divided(number, b),
        "margin_ratio": lambda: divided(number - b, F.abs(number)),
        "add": lambda: number + b,
        "subtract": lambda: number - b,
        "product": lambda: number * b,
        "interaction": lambda: number * b if s.value is None else number * F.when(F.coalesce(F.col(s.second).cast("string"), F.lit("Missing")) == s.value, 1.0).otherwise(0.0),
        "date_year": lambda: F.year(x).cast("double"),
        "date_month": lambda: F.month(x).cast("double"),
        "date_quarter": lambda: F.quarter(x).cast("double"),
        "date_month_end_flag": lambda: F.coalesce((F.to_date(x) == F.last_day(x)).cast("double"), F.lit(0.0)),
        "date_fiscal_quarter": lambda: F.floor(F.pmod(F.month(x) - F.lit(int(s.value or 1)), F.lit(12)) / 3).cast("double") + 1,
        "date_age_days": lambda: _age(x, F.col(s.second) if s.second else F.lit(p["last"])),
        "date_age_months": lambda: _age(x, F.col(s.second) if s.second else F.lit(p["last"])) / DAYS_PER_MONTH,
        "row_missing_count": lambda: _missing(s.columns),
        "row_missing_share": lambda: _missing(s.columns) / len(s.columns),
        "any_missing_flag": lambda: (_missing(s.columns) > 0).cast("double"),
    }
    if k in plain:
        return plain[k]()
    if k in TEMPORAL:
        return _temporal(s, number, entity, date, tie)
    raise ValueError(f"unknown transform {k}")


def _age(x: Column, reference: Column) -> Column:
    seconds = F.unix_timestamp(reference.cast("timestamp")) - F.unix_timestamp(x.cast("timestamp"))
    return F.floor(seconds / 86400.0).cast("double")


def _missing(columns: tuple[str, ...]) -> Column:
    return sum((F.col(c).isNull().cast("double") for c in columns), F.lit(0.0))


TEMPORAL = ("lag", "difference", "ewma", "rolling_mean", "rolling_median", "rolling_min", "rolling_max", "rolling_std", "rolling_sum", "rolling_range", "rolling_cv", "rolling_slope", "expanding_mean", "cumulative_sum", "cumulative_count", "months_since_event", "change_from_baseline", "pct_change")


def _temporal(s: Transform, x: Column, entity: str | None, date: str | None, tie: str | None) -> Column:
    """Rolling, expanding, cumulative-sum and smoothed kinds see strictly earlier rows; nulls become 0 in the end."""
    own = Window.partitionBy("split", *([entity] if entity else [])).orderBy(*(c for c in (date, tie) if c))
    past, upto, before = own.rowsBetween(-s.window, -1), own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    w = lambda f: f(x).over(past)
    filled = F.last(x, True).over(upto)
    out = {
        "lag": lambda: F.lag(x, s.lag).over(own),
        "difference": lambda: x - F.lag(x, s.lag).over(own),
        "ewma": lambda: _smoothed(x, s.source, s.window, Window.partitionBy("split", *([entity] if entity else []))),
        "rolling_mean": lambda: w(F.avg),
        "rolling_median": lambda: w(lambda c: F.percentile(c, F.lit(0.5))),
        "rolling_min": lambda: w(F.min),
        "rolling_max": lambda: w(F.max),
        "rolling_std": lambda: w(F.stddev_pop),
        "rolling_sum": lambda: w(F.sum),
        "rolling_range": lambda: w(F.max) - w(F.min),
        "rolling_cv": lambda: divided(w(F.stddev_pop), w(F.avg)),
        "rolling_slope": lambda: _slope(F.collect_list(x).over(past)),
        "expanding_mean": lambda: F.avg(x).over(before),
        "cumulative_sum": lambda: F.when(F.lag(x).over(own).isNotNull(), F.sum(x).over(before)),
        "cumulative_count": lambda: (F.row_number().over(own) - 1).cast("double"),
        "months_since_event": lambda: _age(F.last(F.when(x > 0, F.col(date)), True).over(upto), F.col(date)) / DAYS_PER_MONTH,
        "change_from_baseline": lambda: x - F.first(x, True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }
    if s.kind == "pct_change":  # a lag of a forward fill: the last value known s.lag rows ago
        earlier = F.last(x, True).over(own.rowsBetween(Window.unboundedPreceding, -s.lag))
        value = F.when(earlier != 0, filled / earlier - 1)
    else:
        value = out[s.kind]()
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _smoothed(x: Column, source: str, span: int, own: WindowSpec) -> Column:
    """Exponential smoothing, without adjustment, of the values before a row; a gap decays the weight of what came before it.

    What lies so many values back that its weight is below 1e-18 can't change a double, so each row folds the last of
    its values only, by the numbers that `_numbered` gave: the values before a row are those with a lower one.
    """
    alpha = 2.0 / (span + 1)
    values = max(2, math.ceil(math.log(1e-18) / math.log(1 - alpha))) if alpha < 1 else 1
    recent = F.collect_list(F.when(x.isNotNull(), F.struct(F.col(ROW).alias("row"), x.alias("y")))).over(own.orderBy(f"{SEEN}{source}").rangeBetween(-values, -1))

    def step(acc: Column, v: Column) -> Column:
        old = F.pow(F.lit(1 - alpha), v["row"] - acc["row"])
        return F.struct(v["row"].alias("row"), F.when(acc["y"].isNull(), v["y"]).otherwise((old * acc["y"] + alpha * v["y"]) / (old + alpha)).alias("y"))

    return F.aggregate(recent, F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("y")), step, lambda acc: acc["y"])


def _slope(values: Column) -> Column:
    """Least-squares slope of the non-null values on their positions 0..m-1."""
    m = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    weighted = F.aggregate(F.transform(values, lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(m >= 2, (weighted - total * (m - 1) / 2) / (m * (m * m - 1) / 12))


#: Columns that smoothing needs for a while: a row's number, and how many values of a source come before it.
ROW, SEEN = "__transforms_row", "__transforms_seen_"


def _numbered(table: DataFrame, sources: list[str], entity: str | None, date: str | None, tie: str | None) -> DataFrame:
    own = Window.partitionBy("split", *([entity] if entity else [])).orderBy(*(c for c in (date, tie) if c))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({ROW: F.row_number().over(own)} | {f"{SEEN}{c}": F.count(F.col(c).try_cast("double")).over(before) for c in sources})


def apply(table: DataFrame, fitted: list[Fitted], entity: str | None = None, date: str | None = None, tie: str | None = None) -> DataFrame:
    smoothed = sorted({f.spec.source for f in fitted if f.spec.kind == "ewma"})
    held = _numbered(table, smoothed, entity, date, tie) if smoothed else table
    out = held.withColumns({f.spec.output or f"{f.spec.source}_{f.spec.kind}": column(f, entity, date, tie) for f in fitted})
    return out.drop(ROW, *(f"{SEEN}{c}" for c in smoothed)) if smoothed else out
