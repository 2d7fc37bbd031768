"""Empty tables, columns of nulls, one row, ties and clashing names through the operators."""

import math

import pytest
from pyspark.sql import functions as F

from gritstone.functions.scalars import logistic
from gritstone.operators import binning, checks, credit, diagnostics, effects, explain, frameworks, hypothesis_tests, imputation, metrics, quantiles, resampling, schema, screening, selection, shape, splits
from gritstone.operators.transforms import Transform, column, fit

SCHEMA = "id bigint, a double, b double, kind string, y int, p double, split string, day timestamp"


def made(spark, rows):
    held = spark.createDataFrame(rows, SCHEMA.replace("day timestamp", "day string")).withColumn("day", F.col("day").cast("timestamp"))
    return held.withColumns({c: F.lit(f"user's {c}") for c in ("place", "range", "bin", "n", "v", "c", "key", "rank", "mixed", "x0")}).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    some = [(k, float(k % 4), None if k % 3 else float(k), "uv"[k % 2] if k % 5 else None, k % 2, (k % 7) / 7, "train" if k % 4 else "test", f"2024-01-{1 + k % 28:02d}") for k in range(60)]
    return {
        "empty": made(spark, []),
        "nulls": made(spark, [(k, None, None, None, None, None, None, None) for k in range(20)]),
        "one": made(spark, some[:1]),
        "ties": made(spark, [(k, 1.0, 2.0, "u", k % 2, 0.5, "train", "2024-01-01") for k in range(40)]),
        "some": made(spark, some),
    }


def score(x):
    return logistic(x["a"] + x["b"])


OPERATORS = {
    "rank": lambda t: splits.global_rank(t, ["a", "id"], "at"),
    "rank by": lambda t: splits.global_rank(t, ["a", "id"], "at", ("kind",)),
    "chronological": lambda t: splits.chronological(t.drop("split"), ["day", "id"], 0.6, 0.2),
    "stratified": lambda t: splits.stratified(t.drop("split"), "id", "y", 0.6, 0.2),
    "folds": lambda t: frameworks.stratified_folds(t, "id", "y", 3),
    "time folds": lambda t: frameworks.expanding_folds(t, ["day", "id"], 3),
    "bands": lambda t: binning.rank_band(t, ["p", "id"], 5),
    "backtest": lambda t: credit.backtest(binning.rank_band(t, ["p", "id"], 5), "y", "p"),
    "quantile edges": lambda t: binning.quantile_edges(t, "a", 4),
    "width edges": lambda t: binning.equal_width_edges(t, "a", 4),
    "monotone edges": lambda t: binning.monotonic_edges(t, "a", "y", 5),
    "woe": lambda t: binning.woe_table(t.where("y IS NOT NULL"), F.col("kind"), "y"),
    "floored woe": lambda t: binning.floored_woe_table(t, F.col("kind"), "y"),
    "frequency": lambda t: binning.frequency_table(t, "kind"),
    "psi": lambda t: binning.psi(t, "a", F.col("split") == "train", F.col("split") == "test"),
    "quantiles": lambda t: quantiles.exact_quantiles(t, "a", [0.0, 0.5, 1.0]),
    "describe": lambda t: diagnostics.describe(t, ["a", "b"]),
    "moments": lambda t: diagnostics.missingness(t, ["a", "kind"], "y"),
    "correlations": lambda t: diagnostics.correlations(t, ["a", "b", "p"]),
    "vif": lambda t: diagnostics.vif(t, ["a", "p"]),
    "outliers": lambda t: diagnostics.outliers(t, "id", "a"),
    "qq": lambda t: diagnostics.qq(t.drop("place"), "id", "p"),
    "cardinality": lambda t: diagnostics.cardinality(t, ["kind"]),
    "screening": lambda t: diagnostics.screening(t, ["a", "b"], "y"),
    "categories": lambda t: shape.describe_categories(t, ["kind", "split"]),
    "covariances": lambda t: shape.covariances(t, ["a", "b"]),
    "normality": lambda t: shape.normality(t, ["a", "b"]),
    "missing association": lambda t: shape.missing_association(t, ["b", "kind"], "y"),
    "segment bias": lambda t: shape.segment_bias(t, "kind", "y", "p"),
    "rows since": lambda t: shape.rows_since(t, F.col("y") == 1, ["kind"], ["day", "id"], "since"),
    "fills": lambda t: imputation.fill(t, {c: v for c, v in imputation.fit_fills(t, {"a": ("median", None), "b": ("mean", None), "kind": ("mode", None)}).items() if v is not None}),
    "carry": lambda t: t.select("id", imputation.carry("a", ["kind"], ["day", "id"])),
    "missing by": lambda t: imputation.missing_by(t, ["a", "b"], "split"),
    "rank metrics": lambda t: metrics.rank_metrics(t, "y", "p", ("split",)),
    "ks curve": lambda t: frameworks.ks_curve(t, "y", "p"),
    "isotonic": lambda t: frameworks.isotonic(t, "y", "p"),
    "multiclass": lambda t: metrics.multiclass_summary(t, "kind", "split"),
    "losses": lambda t: t.agg(*metrics.probability_losses(F.col("y"), F.col("p"))),
    "thresholds": lambda t: metrics.threshold_sweep(t, "y", "p", [0.2, 0.5]),
    "ks test": lambda t: hypothesis_tests.kolmogorov_smirnov(t, "a", F.col("split") == "train"),
    "fences": lambda t: frameworks.fence_flags(t, "id", "a") if quantiles.exact_quantiles(t, "a", [0.5]) != [None] else t,
    "quantile summary": lambda t: frameworks.quantile_summary(t, ["a", "b"]),
    "dependence": lambda t: explain.partial_dependence(t, ["a", "b"], "a", [0.0, 1.0], score, ("split",)),
    "bands of effects": lambda t: effects.resampled_bands(t, ["a", "b"], "id", "a", [0.0, 1.0], score, 3),
    "effect calibration": lambda t: effects.effect_calibration(t, ["a", "kind"], "y", "p", 3, 2),
    "shocks": lambda t: effects.deviation_shocks(t, ["a", "b"], ["a", "b"], score),
    "checks": lambda t: checks.dataset_checks(t, "y", checks.Expected(segments=["kind"])),
    "quality": lambda t: checks.quality_summary(t, ["id"], "y"),
    "workbench": lambda t: checks.workbench(t, {"a": ("plain", ["a"])}, "y"),
    "bootstrap": lambda t: resampling.bootstrap_rows(t, "id", 2),
    "scores": lambda t: selection.univariate_scores(t, ["a", "b"], ["kind"], "y"),
    "iv": lambda t: selection.information_values(t, ["a", "b"], ["kind"], "y"),
    "stability": lambda t: selection.stability(t, F.coalesce(F.col("split") == "train", F.lit(False)), ["a", "b"], ["kind"]),
    "prescreen": lambda t: selection.prescreen(t, ["a", "b"], ["kind"], "y", F.coalesce(F.col("split") == "train", F.lit(False))),
    "selection": lambda t: selection.select_features(t, ["a", "b"], ["kind"], "y", selection.Rules(most_correlation=0.9)),
    "interactions": lambda t: screening.interaction_screen(t, ["a", "b", "p"], ["kind"], "y"),
    "duplicates": lambda t: diagnostics.duplicate_keys(t, ["kind", "day"]),
    "gaps": lambda t: diagnostics.gaps(t, "kind", "day", "id"),
    "classes": lambda t: schema.multiclass_target(t, "kind", "class"),
    "transforms": lambda t: t.select("id", *(column(f, entity="kind", date="day", tie="id").alias(f.spec.kind) for f in fit(t, [Transform(k, "a") for k in ("winsorize", "robust_scale", "center_median", "percentile_rank", "normal_score", "standard_scale", "min_max_scale", "log1p", "lag", "rolling_mean")]))),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_odd_tables(tables, operator):
    for which, table in tables.items():
        try:
            out = OPERATORS[operator](table)
            rows = out.collect() if hasattr(out, "collect") else out
        except Exception as e:
            raise AssertionError(f"{operator} on the table {which}: {str(e)[:400]}") from e
        if hasattr(out, "columns"):
            assert len({c.lower() for c in out.columns}) == len(out.columns)
            for c in ("place", "mixed", "x0") if operator != "qq" else ():
                if c in out.columns and c in table.columns and rows:
                    assert rows[0][c] == f"user's {c}"
        if hasattr(rows, "__len__"):
            for r in rows:
                assert not any(isinstance(v, float) and math.isinf(v) for v in (r if isinstance(r, tuple) else ()))
