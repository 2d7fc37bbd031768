"""Effects, checks, candidates, scoring and files: odd cases beside the SQL twins of the queries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions.scalars import logistic
from gritstone.operators import binning, candidates, checks, diagnostics, effects, explain, metrics, models, resampling, robustness, scoring
from gritstone.operators.penalised import multinomial_logistic
from gritstone.sources import tables


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(41)
    a, b = rng.normal(size=500), rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-a - 0.5 * b))).astype(int)
    rows = [(k, float(a[k]), None if k % 9 == 0 else float(b[k]), "uvw"[k % 3], int(y[k]), "train" if k % 5 else "test", [k, 1]) for k in range(500)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, kind string, y int, split string, more array<bigint>").repartition(4).persist()


def score(x):
    return logistic(x["a"] + 0.5 * F.coalesce(x["b"], F.lit(0.0)) + x["a"] * F.coalesce(x["b"], F.lit(0.0)))


def test_interaction_is_none_for_a_sum(table):
    grids = {"a": [-1.0, 0.0, 1.0], "b": [-1.0, 1.0]}
    straight = lambda x: x["a"] + 2 * F.coalesce(x["b"], F.lit(0.0))
    assert effects.interaction_strength(table, ["a", "b"], [("a", "b")], grids, straight).first()["largest_absolute"] < 1e-9
    assert effects.interaction_strength(table, ["a", "b"], [("a", "b")], grids, score).first()["mean_absolute"] > 0.01


def test_effects_are_centred(table):
    rows = effects.centred_effects(table, ["a", "b"], "a", 6, score).collect()
    assert len(rows) == 6 and abs(sum(r["centred"] for r in rows)) < 1e-9


def test_bands_hold_the_mean(table):
    for r in effects.resampled_bands(table, ["a", "b"], "id", "a", [-1.0, 1.0], score, 40).collect():
        assert r["low"] < r["mean_score"] < r["high"] and r["high"] - r["low"] < 0.1
    assert effects.resampled_bands(table.limit(0), ["a", "b"], "id", "a", [1.0], score, 3).first()["low"] is None


def test_shocks_and_fills(table):
    held = table.withColumn("flat", F.lit(1.0))
    rows = {r["feature"]: r for r in effects.deviation_shocks(held, ["a", "b", "flat"], ["a", "flat"], lambda x: x["a"], 2.0).collect()}
    assert rows.keys() == {"a"} and math.isclose(rows["a"]["change"], rows["a"]["shock"], rel_tol=1e-9)
    out = effects.imputation_sensitivity(table, ["a", "b"], "b", {"mean": 0.0, "far": 5.0, "near": 0.1}, "mean", "y", lambda x: logistic(x["a"] + x["b"])).collect()
    assert [r["policy"] for r in out] == ["far", "near"] and out[0]["mean_absolute"] > out[1]["mean_absolute"] > 0


def test_calibration_by_bucket(table):
    scored = table.withColumn("p", logistic(F.col("a") + 0.5 * F.coalesce("b", F.lit(0.0))))
    rows = effects.effect_calibration(scored, ["a", "b", "kind"], "y", "p", 4, 2).collect()
    assert sum(r["n"] for r in rows) == 1500 and {r["bucket"] for r in rows if r["feature"] == "kind"} == {"u", "v", "Other"}
    assert {r["bucket"] for r in rows if r["feature"] == "b"} == {"0", "1", "2", "3", "Missing"}


def test_dataset_checks(table):
    def failed(expected, held=table, target="y"):
        return {(r["check"], r["subject"]) for r in checks.dataset_checks(held, target, expected).where("NOT passed").collect()}

    assert failed(checks.Expected()) == set()
    assert failed(checks.Expected(mode="multiclass")) == {("target_values", "y")}
    assert failed(checks.Expected(mode="continuous", model="beta_regression"), target="a") == {("target_bounds", "a")}
    assert failed(checks.Expected(mode="multiclass"), target="kind") == set()
    assert failed(checks.Expected(structure="panel", date="day", entity="id", segments=["kind", "gone"])) == {("date_column", "day"), ("segment_column", "gone")}
    assert failed(checks.Expected(segments=["id"], most_segments=10, most_missing=0.05)) == {("segments", "id"), ("missing", "b")}
    assert ("target_values", "y") in failed(checks.Expected(), table.limit(0))


def test_types_policies_and_strategy(table):
    held = table.withColumn("day", F.lit("2024-01-01").cast("date"))
    assert checks.feature_types(held, {"id": "identifier", "y": "target"}) == {"numeric": ["a", "b"], "categorical": ["kind", "split", "more"]}
    assert checks.resolved_policies(table, {"a": "mean"}, ["a", "b", "kind"]) == {"a": "mean", "b": "median", "kind": "mode"}
    assert checks.split_strategy("cross_sectional") == "random" and checks.split_strategy("panel") == "chronological"


def test_policy_checks(table):
    assert checks.is_monotone([1, 1, 2], "increasing") and not checks.is_monotone([1], "increasing") and not checks.is_monotone([1, 2, 1], "decreasing")
    assert checks.has_sign(0.0, "nonnegative") and not checks.has_sign(None, "positive") and not checks.has_sign(1.0, "other")
    policy = checks.Policy(required=["a"], excluded=["b"], signs={"a": "negative"}, monotone={"a": "increasing"})
    got = {r["check"]: r["passed"] for r in checks.policy_checks(table, ["a", "b"], policy, {}, {}, {}, {"a": 1.0}, {"a": [0.1, 0.2]}).collect()}
    assert got == {"required_feature": True, "excluded_feature": False, "expected_sign": False, "monotone": True}


def test_lineage(table):
    made = {"x": ["y1", "a"], "y1": ["b", "a"], "z": ["kind"]}
    got = {(r["feature"], r["source"]) for r in checks.lineage(table, ["x", "z", "plain"], made).collect()}
    assert got == {("x", "a"), ("x", "b"), ("z", "kind"), ("plain", "plain")}
    with pytest.raises(ValueError):
        checks.lineage(table, ["x"], {"x": ["w"], "w": ["x"]})


def test_workbench_and_quality(table):
    held = table.withColumns({"flat": F.lit(2.0), "gone": F.lit(None).cast("double")})
    rows = {r["feature"]: r for r in checks.workbench(held, {"flat": ("constant", []), "gone": ("none", ["a"]), "a": ("plain", ["a"])}, "y").collect()}
    assert rows["flat"]["relation"] is None and rows["gone"]["known"] == 0 and rows["a"]["relation"] > 0.2
    assert checks.workbench(held.limit(9), {"a": ("plain", ["a"])}, "y").first()["relation"] is None
    facts = {r["fact"]: r["value"] for r in checks.quality_summary(held, ["kind"], "y").collect()}
    assert facts["repeated_keys"] == 497 and facts["empty_columns"] == 1 and facts["missing_cells"] == 500 + 56


def test_constant_columns_have_no_correlation(table):
    held = table.withColumn("flat", F.lit(2.0))
    assert [r["r"] for r in diagnostics.correlations(held, ["a", "flat"]).collect()] == [None]
    assert diagnostics.screening(held, ["flat"], "y").first()["status"] == "constant"


def test_multiclass_summary(table):
    from collections import Counter

    held = table.withColumn("guess", F.when(F.col("id") % 4 == 0, "u").when(F.col("id") % 7 == 0, "x").otherwise(F.col("kind")))
    rows = [(r["kind"], r["guess"]) for r in held.collect()]
    f1, support = {}, Counter(t for t, _ in rows)
    for c in {x for r in rows for x in r}:
        hit = sum(t == g == c for t, g in rows)
        f1[c] = 2 * hit / (support[c] + sum(g == c for _, g in rows))
    got = metrics.multiclass_summary(held, "kind", "guess").first()
    assert got["classes"] == 4 and got["log_loss"] is None and math.isclose(got["accuracy"], sum(t == g for t, g in rows) / 500)
    assert math.isclose(got["macro_f1"], sum(f1.values()) / 4) and math.isclose(got["weighted_f1"], sum(f1[c] * n for c, n in support.items()) / 500)


def test_calibration_fit(table):
    scored = table.withColumn("p", logistic(2 * F.col("a")))
    got = metrics.calibration_fit(scored, binning.rank_band(scored, ["p", "id"], 10), "y", "p").first()
    assert 0.2 < got["slope"] < 0.8 and got["degrees"] == 8 and got["p_value"] < 0.05


# candidates
def test_frontier_frequency_redundancy(table):
    found = robustness.subset_search(table.na.drop().withColumn("c", F.col("a") + 0.1 * F.col("b")), ["a", "b", "c"], "y", range(1, 4))
    rows = {r["size"]: r["bic"] for r in candidates.frontier(found).collect()}
    assert rows == {r["size"]: r["least"] for r in found.groupBy("size").agg(F.min("bic").alias("least")).collect()}
    frequency = candidates.feature_frequency(found, 3).collect()
    assert all(math.isclose(r["share"], r["selected"] / 3) for r in frequency)
    held = table.na.drop().withColumn("c", F.col("a") + 0.1 * F.col("b"))
    assert [(r["left"], r["right"], r["risk"]) for r in candidates.redundancy(held, found, ["a", "b", "c"], 7).collect()] == [("a", "c", "high")]


def test_fold_fits_leave_the_fold_out(table):
    held = table.na.drop().withColumn("fold", F.col("id") % 4)
    rows = held.collect()
    for r in candidates.fold_fits(held, ["a", "b"], "y", "fold").where("term = 'b'").collect():
        own = [x for x in rows if x["fold"] != int(r["fold"])]
        full = np.array([[1, x["a"], x["b"]] for x in own])
        want = np.linalg.lstsq(full, np.array([x["y"] for x in own], float), rcond=None)[0][2]
        assert math.isclose(r["coefficient"], want, rel_tol=1e-8)
    fits = table.sparkSession.createDataFrame([("x", 1.0), ("x", -1.0), ("x", 2.0), ("x", 0.0), ("z", 0.0)], "term string, coefficient double")
    assert {r["term"]: r["sign_share"] for r in candidates.consistency(fits).collect()} == {"x": 2 / 3, "z": 0.0}


def test_risk_counts(spark):
    base = spark.createDataFrame([("p",), ("q",)], "k string")
    flags = spark.createDataFrame([("p", "b"), ("p", "a"), ("r", "c")], "k string, risk string")
    assert {(r["k"], r["risks"], r["risk_names"]) for r in candidates.with_risk_counts(base, flags, "k").collect()} == {("p", 2, "a,b"), ("q", 0, "")}


def test_reason_frequency(spark):
    held = spark.createDataFrame([(["x", "y"],), (["x", "z"],), (["y"],)], "reasons array<string>")
    got = {(r["place"], r["reason"]): (r["n"], round(r["share"], 6)) for r in candidates.reason_frequency(held).collect()}
    assert got == {(1, "x"): (2, 0.666667), (1, "y"): (1, 0.333333), (2, "y"): (1, 0.5), (2, "z"): (1, 0.5)}


# scoring
def test_a_kept_model_checks_its_features(spark, table, tmp_path):
    model = models.iteratively_reweighted(table, ["a", "b"], "y")
    held = scoring.kept(model, table, 0.6)
    held.save(spark, str(tmp_path / "model"))
    back = scoring.Kept.load(spark, str(tmp_path / "model"))
    assert back.types == {"a": "double", "b": "double"} and back.threshold == 0.6 and np.allclose(back.model.coefficients, model.coefficients, rtol=0, atol=0)
    with pytest.raises(ValueError, match="'b'"):
        scoring.score_binary(table.drop("b"), back)
    text = table.withColumn("a", F.when(F.col("id") == 3, "no number").otherwise(F.col("a").cast("string")))
    rows = {r["id"]: r for r in scoring.score_binary(text, back, "y").collect()}
    assert rows[3]["probability"] is None and rows[0]["probability"] is None and rows[1]["residual"] == rows[1]["y"] - rows[1]["probability"]


def test_replay_names_a_broken_step(table):
    assert scoring.replayed(table, [("x", lambda t: t.select("id"))]).columns == ["id"]
    with pytest.raises(TypeError, match="second"):
        scoring.replayed(table, [("first", lambda t: t), ("second", lambda t: t.count())])


def test_multiclass_scores(table):
    model = multinomial_logistic(table.na.drop(), ["a", "b"], "kind")
    row = scoring.score_multiclass(table.na.drop(), model, "kind").first()
    each = [row[f"probability_{k}"] for k in range(3)]
    assert abs(sum(each) - 1) < 1e-9 and row["predicted_probability"] == max(each) and row["predicted_class"] == "uvw"[each.index(max(each))]


def test_compact_and_safe(spark, table, tmp_path):
    assert scoring.compact(table, ["id"], ["y"], 7).count() == 7 and scoring.compact(table, ["id"], ["y"], 700).count() == 500
    assert scoring.compact(table, ["id"], ["y"], 7).collect() == scoring.compact(table.repartition(9), ["id"], ["y"], 7).collect()
    odd = table.withColumn("nothing", F.lit(None))
    scoring.parquet_safe(odd).write.parquet(str(tmp_path / "safe"))
    assert dict(scoring.parquet_safe(odd, True).dtypes)["more"] == "string" and dict(scoring.parquet_safe(odd).dtypes)["nothing"] == "string"


def test_user_functions(table):
    got = scoring.with_row_function(table, "z", lambda a, b: a + b.fillna(0), ["a", "b"], "double").where("id = 9").first()
    assert math.isclose(got["z"], got["a"])
    got = scoring.with_group_function(table, ["kind"], {"top": (lambda a, b: float((a * b.fillna(0)).max()), ["a", "b"], "double")}).count()
    assert got == 3


# files
def test_files_are_read_by_what_they_hold(spark, table, tmp_path):
    plain = table.drop("more")
    tables.export(plain, str(tmp_path / "t.csv"), "csv")
    assert tables.content_kind(spark, str(tmp_path / "t.csv")) == "text"
    back = tables.load_table(spark, str(tmp_path / "t.csv"))
    assert back.count() == 500 and set(back.columns) == set(plain.columns)
    tables.export(plain, str(tmp_path / "p.csv"), "parquet")
    with pytest.raises(ValueError, match="Parquet"):
        tables.load_table(spark, str(tmp_path / "p.csv"))
    for name, raw in (("x.csv", b"PK\x03\x04rest"), ("y.csv", b"a,b\n1,\x002"), ("z.csv", b"\xd0\xcf\x11\xe0")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError):
            tables.load_table(spark, str(tmp_path / name))
    assert tables.load_table(plain) is plain
    with pytest.raises(ValueError, match="rows"):
        tables.load_table(plain.limit(0))
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="rows"):
        tables.load_table(spark, str(tmp_path / "empty.csv"))


def test_projection_facts_and_hashes(spark, table, tmp_path):
    held = tables.projected(table, ["id", "a"], str(tmp_path / "narrow"))
    assert [(r["column"], r["type"], r["rows"]) for r in tables.table_facts(held).collect()] == [("id", "bigint", 500), ("a", "double", 500)]
    with pytest.raises(ValueError, match="nobody"):
        tables.projected(table, ["id", "nobody"], str(tmp_path / "none"))
    assert tables.schema_hash(held) == tables.schema_hash(table.select("id", "a")) != tables.schema_hash(table.select("a", "id"))
    mark = lambda t: tuple(tables.portable_fingerprint(t, ["id", "kind"]).first())
    assert mark(table) == mark(table.repartition(7)) != mark(table.withColumn("kind", F.lit(None).cast("string")))
    assert mark(table.limit(0)) == (0, "0")


def test_draws_are_dealt_in_parts(spark, monkeypatch):
    """A task counts a bounded number of draws, however many there are, and the draws are the same."""
    table = spark.range(500).withColumnRenamed("id", "key")
    drawn = lambda: sorted(map(tuple, resampling.bootstrap_counts(table, "key", 6).collect()))
    whole = drawn()
    monkeypatch.setattr(resampling, "TASK_DRAWS", 100)
    assert resampling.bootstrap_counts(table, "key", 6).rdd.getNumPartitions() == 30 and drawn() == whole
    assert sum(n for *_, n in whole) == 3000


def test_permuted_scores_are_ranked_together(spark, monkeypatch):
    """All features are dealt and ranked in one go, as each would be alone."""
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(k, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-a))), "u" if k % 3 else "v") for k, (a, b) in enumerate(rng.normal(size=(300, 2)))], "id long, a double, b double, y int, part string")
    score = lambda x: logistic(x["a"] + 0.1 * x["b"])
    calls, ranked = [], metrics.rank_metrics
    monkeypatch.setattr(metrics, "rank_metrics", lambda *args: calls.append(1) or ranked(*args))
    got = {(r["part"], r["feature"]): r["auc"] for r in explain.permutation_importance(table, ["a", "b"], ["a", "b"], "id", "y", score, ("part",)).collect()}
    assert len(calls) == 1 and len(got) == 4
    base = {r["part"]: r["auc"] for r in ranked(table.withColumn("s", score({"a": F.col("a"), "b": F.col("b")})), "y", "s", ("part",)).collect()}
    moved = explain.permuted(table, "id", "a").withColumn("s", score({"a": F.col("a"), "b": F.col("b")}))
    for r in ranked(moved, "y", "s", ("part",)).collect():
        assert abs(got[r["part"], "a"] - (base[r["part"]] - r["auc"])) < 1e-12
