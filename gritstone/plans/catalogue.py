"""The engine's queries over the loan-book view of the tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions.scalars import category, logistic, rounded
from gritstone.operators import binning, credit, diagnostics, explain, hypothesis_tests, imputation, metrics, models, schema, splits, transforms
from gritstone.operators.transforms import Transform
from gritstone.plans import paging
from gritstone.sources import tables
from gritstone.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BOOK_SQL = """
WITH book AS (
    SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate AS date, c_mktsegment AS segment, o_orderpriority AS state,
           o_totalprice AS amount, c_acctbal AS balance, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS sparse,
           CASE WHEN o_orderkey % 13 <> 0 THEN c_mktsegment END AS sparse_segment,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
           floor(1e6 / (1 + exp(-(-0.5 + o_totalprice / 4e5 - c_acctbal / 2e4))) + 0.5) / 1e6 AS score,
           floor(1e6 / (1 + exp(-(-0.2 - c_acctbal / 1.5e4))) + 0.5) / 1e6 AS challenger,
           CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-07-01' THEN 'validation' ELSE 'test' END AS split
    FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def fixed_score(x: dict[str, Column]) -> Column:
    return logistic(-0.5 + x["amount"] / 4e5 - x["balance"] / 2e4)


def book(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    held = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    amount, balance = F.col("o_totalprice"), F.col("c_acctbal")
    return held.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("date"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("state"),
        amount.alias("amount"), balance.alias("balance"), F.when(F.col("o_orderkey") % 11 != 0, amount).alias("sparse"), F.when(F.col("o_orderkey") % 13 != 0, F.col("c_mktsegment")).alias("sparse_segment"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"), rounded(fixed_score({"amount": amount, "balance": balance})).alias("score"), rounded(logistic(-0.2 - balance / 1.5e4)).alias("challenger"),
        splits.date_cutoff(F.col("o_orderdate"), "1999-01-01", "2000-07-01").alias("split"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("segment"), (F.col("l_discount") * 10).alias("lgd"), F.col("l_quantity").alias("quantity"), rounded(0.2 + F.col("l_quantity") / 100, 6).alias("predicted"), F.col("l_linestatus").alias("status"))


LINES_SQL = """
WITH lines AS (
    SELECT l_returnflag AS segment, l_discount * 10 AS lgd, l_quantity AS quantity, floor((0.2::DOUBLE + l_quantity / 100) * 1e6 + 0.5) / 1e6 AS predicted, l_linestatus AS status FROM lineitem
)"""


def register(name: str, sql: str | None, build: Callable[[SparkSession, str], DataFrame], base: str = BOOK_SQL) -> None:
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = base + sql


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*(rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def on_book(build: Callable[[DataFrame], DataFrame], digits: int | None = 6) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: neat(build(book(spark, sf)), digits) if digits is not None else build(book(spark, sf))


BAND_SQL = """, ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, greatest(count(*) OVER () - 1, 1) AS m FROM book{where}),
banded AS (SELECT *, CAST(greatest(1, ((rn - 1) * {q} + m - 1) // m) AS INTEGER) AS band FROM ranked)"""
banded = lambda df, q=10, descending=False: binning.rank_band(df.withColumn("risk", -F.col("score") if descending else F.col("score")), ["risk", "id"], q).drop("risk")
BANDS, LIFT = BAND_SQL.format(order="score, id", q=10, where=""), BAND_SQL.format(order="-score, id", q=10, where="")

register("risk_band_backtest", BANDS + f" SELECT band, count(*) AS n, CAST(sum(target) AS BIGINT) AS defaults, {r('avg(score)')} AS mean_score, {r('avg(CAST(target AS DOUBLE))')} AS observed_rate, min(score) AS min_score, max(score) AS max_score FROM banded GROUP BY band", on_book(lambda b: credit.backtest(banded(b), "target", "score")))

# paged queries
page = lambda b, **k: paging.query_page(b, columns=["id", "segment", "amount", "unknown"], tie_breakers=("id",), **k)
register("page_eq_sort", " SELECT id, segment, amount FROM book WHERE segment = 'BUILDING' ORDER BY amount DESC NULLS LAST, id LIMIT 20 OFFSET 20", on_book(lambda b: page(b, filters=[{"column": "segment", "op": "eq", "value": "BUILDING"}, {"column": "nothing", "op": "eq", "value": 1}], sort_by="amount", descending=True, page=2, page_size=20), None))
register("page_contains", " SELECT id, segment, amount FROM book WHERE segment ILIKE '%house%' ORDER BY amount NULLS LAST, id LIMIT 15", on_book(lambda b: page(b, filters=[{"column": "segment", "op": "contains", "value": "house"}], sort_by="amount", page_size=15), None))
register("page_in", " SELECT id, segment, amount FROM book WHERE segment IN ('BUILDING', 'FURNITURE') ORDER BY id DESC LIMIT 25", on_book(lambda b: page(b, filters=[{"column": "segment", "op": "in", "value": ["BUILDING", "FURNITURE"]}, {"column": "id", "op": "in", "value": []}], sort_by="id", descending=True, page_size=25), None))
register("page_between", " SELECT id, segment, amount FROM book WHERE amount BETWEEN 50000 AND 90000 ORDER BY amount, id LIMIT 10 OFFSET 10", on_book(lambda b: page(b, filters=[{"column": "amount", "op": "between", "value": [50000, 90000]}], sort_by="amount", page=2, page_size=10), None))
register("page_nulls_last", " SELECT id, sparse FROM book ORDER BY sparse DESC NULLS LAST, id LIMIT 30", on_book(lambda b: paging.query_page(b, columns=["id", "sparse"], sort_by="sparse", descending=True, page_size=30, tie_breakers=("id",)), None))
register("count_filtered", " SELECT count(*) AS n FROM book WHERE segment = 'BUILDING' AND amount BETWEEN 1000 AND 100000", on_book(lambda b: paging.count_rows(b, [{"column": "segment", "op": "=", "value": "BUILDING"}, {"column": "amount", "op": "between", "value": [1000, 100000]}]), None))
register("distinct_values", " SELECT DISTINCT CAST(sparse_segment AS VARCHAR) AS value FROM book WHERE sparse_segment IS NOT NULL ORDER BY value LIMIT 100", on_book(lambda b: paging.distinct_values(b, "sparse_segment"), None))
register("source_profile", " SELECT 'amount' AS \"column\", count(*) AS rows, CAST(sum(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(DISTINCT amount) AS \"distinct\", " + ", ".join(f"{r(f'quantile_cont(amount, {p})')} AS p{int(100 * p):02d}" for p in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM book UNION ALL SELECT 'sparse', count(*), CAST(sum(CASE WHEN sparse IS NULL THEN 1 ELSE 0 END) AS BIGINT), count(DISTINCT sparse), " + ", ".join(r(f"quantile_cont(sparse, {p})") for p in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM book", on_book(lambda b: tables.profile(b, ["amount", "sparse"])))
register("hash_sample", " SELECT id, amount FROM book ORDER BY (id * 7919) % 1000003, id LIMIT 200", on_book(lambda b: tables.hash_sample(b, "id", 200).select("id", "amount"), None))

# schema, cleaning, targets
RAW_SQL = ", raw AS (SELECT id, CASE id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2.0' WHEN 2 THEN '2.5' WHEN 3 THEN 'unknown' END AS number, CASE id % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'F' WHEN 2 THEN '1' ELSE 'maybe' END AS flag, CASE id % 3 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) || segment || ' ' ELSE segment END AS label FROM book)"
raw = lambda b: b.select("id", F.expr("CASE id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2.0' WHEN 2 THEN '2.5' WHEN 3 THEN 'unknown' END").alias("number"), F.expr("CASE id % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'F' WHEN 2 THEN '1' ELSE 'maybe' END").alias("flag"), F.expr("CASE id % 3 WHEN 0 THEN '  ' WHEN 1 THEN '\\t' || segment || ' ' ELSE segment END").alias("label"))
register("cast_and_clean", RAW_SQL + " SELECT id, CASE WHEN TRY_CAST(number AS DOUBLE) % 1 = 0 THEN CAST(TRY_CAST(number AS DOUBLE) AS BIGINT) END AS number, CASE WHEN lower(trim(flag)) IN ('1','true','t','yes','y') THEN TRUE WHEN lower(trim(flag)) IN ('0','false','f','no','n') THEN FALSE END AS flag, CASE WHEN NOT regexp_matches(label, '^\\s*$') THEN regexp_replace(label, '^\\s+|\\s+$', '', 'g') END AS label FROM raw", on_book(lambda b: schema.apply_specs(schema.clean_strings(raw(b)), [schema.ColumnSpec("number", kind="int"), schema.ColumnSpec("flag", kind="bool")]), None))
register("dedup_rows", " SELECT DISTINCT segment, state, split FROM book", on_book(lambda b: b.select("segment", "state", "split").dropDuplicates(), None))
register("target_multiclass", " SELECT state, CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS class, n FROM (SELECT state, count(*) AS n FROM book GROUP BY state)", on_book(lambda b: schema.multiclass_target(b, "state", "class").groupBy("state", "class").agg(F.count("*").alias("n")), None))
register("target_binary", " SELECT id, CASE WHEN sparse_segment IS NULL THEN NULL WHEN lower(sparse_segment) IN ('building', 'machinery') THEN 1 ELSE 0 END AS flag FROM book", on_book(lambda b: b.select("id", schema.binary_target(F.col("sparse_segment"), ("Building", " machinery")).alias("flag")), None))

# splits
SUMMARY = " SELECT split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM {t} GROUP BY split"
register("split_cutoff", SUMMARY.format(t="book"), on_book(lambda b: splits.summary(b, "date"), None))
register("split_chronological", ", r AS (SELECT id, row_number() OVER (ORDER BY date, id) AS p, count(*) OVER () AS n FROM book) SELECT id, CASE WHEN p <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN p <= floor(n * 0.6 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r", on_book(lambda b: splits.chronological(b.drop("split"), ["date", "id"], 0.6, 0.2).select("id", "split"), None))
register("split_windows", " SELECT CASE WHEN date <= TIMESTAMP '1998-12-31 23:59:59' THEN 'train' WHEN date <= TIMESTAMP '2000-12-31 23:59:59' THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM book GROUP BY 1", on_book(lambda b: splits.date_windows(b, "date", {"train": ("1990-01-01", "1998-12-31 23:59:59"), "validation": ("1999-01-01", "2000-12-31 23:59:59"), "test": ("2001-01-01", "2010-01-01")}).groupBy("split").agg(F.count("*").alias("n")), None))
register("split_named", " SELECT CASE id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' END AS split, count(*) AS n FROM book GROUP BY 1", on_book(lambda b: b.select(splits.named_split(F.expr("CASE id % 4 WHEN 0 THEN ' Dev' WHEN 1 THEN 'VAL' WHEN 2 THEN 'Hold-Out' ELSE 'other' END")).alias("split")).groupBy("split").agg(F.count("*").alias("n")), None))
register("split_stratified", ", r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY (id * 7919) % 1000003, id) AS p, count(*) OVER (PARTITION BY target) AS n FROM book) SELECT id, target, CASE WHEN p <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN p <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r", on_book(lambda b: splits.stratified(b.drop("split"), "id", "target", 0.7, 0.15).select("id", "target", "split"), None))
register("fold_assign", " SELECT CAST(((id * 7919) % 1000003) % 5 AS INTEGER) AS fold, count(*) AS n, CAST(sum(target) AS BIGINT) AS events FROM book GROUP BY 1", on_book(lambda b: b.groupBy(splits.fold("id", 5).alias("fold")).agg(F.count("*").alias("n"), F.sum("target").alias("events")), None))


# transforms
def transformed(b: DataFrame, specs: list[Transform], keep: tuple[str, ...] = ("id",), **own) -> DataFrame:
    fitted = transforms.fit(b.where("split = 'train'"), specs)
    return transforms.apply(b, fitted, **own).select(*keep, *(s.output for s in specs))


T = Transform
TRAIN = ", t AS (SELECT avg(sparse) AS m, stddev_pop(sparse) AS s, quantile_cont(sparse, 0.01) AS q01, quantile_cont(sparse, 0.99) AS q99, quantile_cont(sparse, 0.25) AS q25, quantile_cont(sparse, 0.5) AS q50, quantile_cont(sparse, 0.75) AS q75, min(sparse) AS lo, max(sparse) AS hi FROM book WHERE split = 'train')"
register("scale_transforms", TRAIN + f" SELECT id, {r('CASE WHEN sparse IS NOT NULL THEN least(greatest(sparse, q01), q99) END')} AS wins, {r('CASE WHEN sparse IS NOT NULL THEN least(greatest((sparse - m) / s, -2), 2) END')} AS capped, {r('(sparse - m) / s')} AS standard, {r('(sparse - q50) / (q75 - q25)')} AS robust, {r('(sparse - lo) / (hi - lo)')} AS unit, {r('sparse - q50')} AS from_median FROM book, t", on_book(lambda b: transformed(b, [T("winsorize", "sparse", "wins"), T("capped_zscore", "sparse", "capped", value=2.0), T("standard_scale", "sparse", "standard"), T("robust_scale", "sparse", "robust"), T("min_max_scale", "sparse", "unit"), T("center_median", "sparse", "from_median")])))
register("shape_transforms", f" SELECT id, {r('ln(1 + sparse)')} AS log1p, {r('sign(balance) * ln(1 + abs(balance))')} AS signed_log, {r('CASE WHEN balance >= 0 THEN sqrt(balance) END')} AS root, {r('CASE WHEN abs(balance) > 1e-12 THEN 1 / balance END', 9)} AS reciprocal, {r('(balance / 1) * balance', 2)} AS square, {r('abs(balance)')} AS absolute, {r('CASE WHEN sparse IS NOT NULL THEN greatest(sparse - 100000, 0) END')} AS hinge, {r('2 * (sqrt(sparse) - 1)', 4)} AS box_cox FROM book", on_book(lambda b: transformed(b, [T("log1p", "sparse", "log1p"), T("signed_log1p", "balance", "signed_log"), T("sqrt", "balance", "root"), T("reciprocal", "balance", "reciprocal"), T("square", "balance", "square"), T("absolute_value", "balance", "absolute"), T("piecewise_linear", "sparse", "hinge", value=1e5), T("box_cox", "sparse", "box_cox", value=0.5)]).select("id", *(rounded(c).alias(c) for c in ("log1p", "signed_log", "root", "absolute", "hinge")), rounded("reciprocal", 9).alias("reciprocal"), rounded("square", 2).alias("square"), rounded("box_cox", 4).alias("box_cox")), None))
register("pair_transforms", f" SELECT id, {r('CASE WHEN abs(balance) > 1e-12 THEN sparse / balance END', 4)} AS ratio, {r('CASE WHEN abs(sparse) > 1e-12 THEN (sparse - balance) / abs(sparse) END')} AS margin, {r('sparse + balance')} AS plus, {r('sparse - balance')} AS minus, {r('sparse * balance', 1)} AS times, {r('''sparse * CASE WHEN coalesce(sparse_segment, 'Missing') = 'Missing' THEN 1.0 ELSE 0.0 END''')} AS only_missing FROM book", on_book(lambda b: transformed(b, [T("ratio", "sparse", "ratio", second="balance"), T("margin_ratio", "sparse", "margin", second="balance"), T("add", "sparse", "plus", second="balance"), T("subtract", "sparse", "minus", second="balance"), T("product", "sparse", "times", second="balance"), T("interaction", "sparse", "only_missing", second="sparse_segment", value="Missing")]).select("id", rounded("ratio", 4).alias("ratio"), rounded("times", 1).alias("times"), *(rounded(c).alias(c) for c in ("margin", "plus", "minus", "only_missing"))), None))
register("percentile_rank", ", g AS (SELECT list_sort(list_distinct(quantile_cont(sparse, list_transform(range(0, 1001), lambda k: k / 1000.0)))) AS q FROM book WHERE split = 'train'), p AS (SELECT id, sparse, q, len(q) - 1 AS last, greatest(least(len(list_filter(q, lambda v: v <= sparse)), len(q) - 1), 1) AS k FROM book, g) " + f"SELECT id, {r('CASE WHEN sparse IS NOT NULL THEN least(greatest((k - 1 + (sparse - q[k]) / (q[k + 1] - q[k])) / last, 0), 1) END')} AS place FROM p", on_book(lambda b: transformed(b, [T("percentile_rank", "sparse", "place")])))
register("date_transforms", " SELECT id, CAST(year(date) AS DOUBLE) AS y, CAST(month(date) AS DOUBLE) AS m, CAST(quarter(date) AS DOUBLE) AS q, CASE WHEN CAST(date AS DATE) = last_day(CAST(date AS DATE)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS month_end, CAST(floor(((month(date) - 4 + 12) % 12) / 3) + 1 AS DOUBLE) AS fiscal, CAST(floor((epoch(t.last) - epoch(date)) / 86400.0) AS DOUBLE) AS age FROM book, (SELECT max(date) AS last FROM book WHERE split = 'train') t", on_book(lambda b: transformed(b, [T("date_year", "date", "y"), T("date_month", "date", "m"), T("date_quarter", "date", "q"), T("date_month_end_flag", "date", "month_end"), T("date_fiscal_quarter", "date", "fiscal", value=4), T("date_age_days", "date", "age")]), None))
register("missing_transforms", f" SELECT id, CAST((CASE WHEN sparse IS NULL THEN 1 ELSE 0 END) + (CASE WHEN sparse_segment IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS missing, {r('((CASE WHEN sparse IS NULL THEN 1 ELSE 0 END) + (CASE WHEN sparse_segment IS NULL THEN 1 ELSE 0 END)) / 3.0')} AS share, CASE WHEN sparse IS NULL OR sparse_segment IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS any FROM book", on_book(lambda b: transformed(b, [T("row_missing_count", "id", "missing", columns=("sparse", "sparse_segment")), T("row_missing_share", "id", "share", columns=("sparse", "sparse_segment", "amount")), T("any_missing_flag", "id", "any", columns=("sparse", "sparse_segment"))])))
PANEL = "OVER (PARTITION BY split, entity ORDER BY date, id{})"
past, before = PANEL.format(" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"), PANEL.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
panel = {"entity": "entity", "date": "date", "tie": "id"}
zero = lambda x, d=4: f"coalesce({r(x, d)}, 0.0::DOUBLE)"
register("lag_transforms", f" SELECT id, {zero(f'lag(sparse, 1) {PANEL.format('')}')} AS lagged, {zero(f'sparse - lag(sparse, 2) {PANEL.format('')}')} AS changed, CAST(row_number() {PANEL.format('')} - 1 AS DOUBLE) AS seen, {zero(f'CASE WHEN lag(sparse) {PANEL.format('')} IS NOT NULL THEN sum(sparse) {before} END')} AS total, {zero(f'avg(sparse) {before}')} AS expanding FROM book", on_book(lambda b: transformed(b, [T("lag", "sparse", "lagged"), T("difference", "sparse", "changed", lag=2), T("cumulative_count", "sparse", "seen"), T("cumulative_sum", "sparse", "total"), T("expanding_mean", "sparse", "expanding")], **panel), 4))
register("rolling_transforms", f" SELECT id, {zero(f'avg(sparse) {past}')} AS mean, {zero(f'min(sparse) {past}')} AS low, {zero(f'max(sparse) {past}')} AS high, {zero(f'sum(sparse) {past}')} AS total, {zero(f'max(sparse) {past} - min(sparse) {past}')} AS spread, {zero(f'quantile_cont(sparse, 0.5) {past}')} AS median FROM book", on_book(lambda b: transformed(b, [T("rolling_mean", "sparse", "mean"), T("rolling_min", "sparse", "low"), T("rolling_max", "sparse", "high"), T("rolling_sum", "sparse", "total"), T("rolling_range", "sparse", "spread"), T("rolling_median", "sparse", "median")], **panel), 4))
SLOPE = "list_transform({v}, lambda x, i: x * (i - 1))"
register("rolling_spread", f" SELECT id, {zero('std', 3)} AS std, {zero('std / mean', 5)} AS cv, {zero('CASE WHEN len(v) >= 2 THEN (list_sum(' + SLOPE.format(v='v') + ') - list_sum(v) * (len(v) - 1) / 2) / (len(v) * (len(v) * len(v) - 1) / 12.0) END', 3)} AS slope FROM (SELECT id, stddev_pop(sparse) {past} AS std, avg(sparse) {past} AS mean, list_filter(list(sparse) {past}, lambda x: x IS NOT NULL) AS v FROM book)", on_book(lambda b: transformed(b, [T("rolling_std", "sparse", "std"), T("rolling_cv", "sparse", "cv"), T("rolling_slope", "sparse", "slope")], **panel).select("id", rounded("std", 3).alias("std"), rounded("cv", 5).alias("cv"), rounded("slope", 3).alias("slope")), None))
upto = PANEL.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
register("event_transforms", f" SELECT id, {zero(f'floor((epoch(date) - epoch(last_value(CASE WHEN balance > 5000 THEN date END IGNORE NULLS) {upto})) / 86400.0) / 30.4375')} AS months, {zero(f'sparse - first_value(sparse IGNORE NULLS) OVER (PARTITION BY split, entity ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS moved, {zero(f'last_value(sparse IGNORE NULLS) {upto} / last_value(sparse IGNORE NULLS) {before} - 1')} AS pct FROM book", on_book(lambda b: transforms.apply(b.withColumn("event", F.when(F.col("balance") > 5000, 1.0).otherwise(0.0)), transforms.fit(b, [T("months_since_event", "event", "months"), T("change_from_baseline", "sparse", "moved"), T("pct_change", "sparse", "pct")]), **panel).select("id", "months", "moved", "pct"), 4))


def _yeo(x: str, p: str) -> str:
    above = f"CASE WHEN abs({p}) < 1e-9 THEN ln(1 + {x}) ELSE (pow(1 + {x}, {p}) - 1) / {p} END"
    below = f"CASE WHEN abs({p} - 2) < 1e-9 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {p}) - 1) / (2 - {p}) END"
    return f"CASE WHEN {x} >= 0 THEN {above} WHEN {x} < 0 THEN {below} END"


def _search(name: str, centre: str, step: float) -> str:
    """The best of 17 powers around a centre, by likelihood."""
    points = f"SELECT c + {step} * k AS g FROM (SELECT unnest(range(-8, 9)) AS k), (SELECT {centre} AS c)"
    likelihood = f"-count(*) / 2.0 * ln(var_pop({_yeo('balance', 'g')})) + (any_value(g) - 1) * sum(sign(balance) * ln(1 + abs(balance)))"
    return f", {name} AS (SELECT g AS c FROM (SELECT g, {likelihood} AS l FROM book, ({points}) WHERE split = 'train' GROUP BY g) ORDER BY l DESC LIMIT 1)"


YEO_POWER = _search("y1", "0.0::DOUBLE", 0.25) + _search("y2", "(SELECT c FROM y1)", 0.25 / 8) + _search("y3", "(SELECT c FROM y2)", 0.25 / 64)
SMOOTHED = """
, seq AS (SELECT split, entity, id, sparse AS v, row_number() OVER (PARTITION BY split, entity ORDER BY date, id) AS rn FROM book),
  walk AS (
    SELECT split, entity, id, rn, v AS y, 1.0::DOUBLE AS w, NULL::DOUBLE AS before FROM seq WHERE rn = 1
    UNION ALL
    SELECT r.split, r.entity, r.id, r.rn,
           CASE WHEN k.y IS NULL THEN r.v WHEN r.v IS NULL THEN k.y ELSE (k.w * 0.5 * k.y + 0.5 * r.v) / (k.w * 0.5 + 0.5) END,
           CASE WHEN k.y IS NOT NULL AND r.v IS NULL THEN k.w * 0.5 ELSE 1.0 END, k.y
    FROM walk k JOIN seq r ON r.split = k.split AND r.entity = k.entity AND r.rn = k.rn + 1
)"""
NORMAL = """
, g AS (SELECT list_sort(list_distinct(quantile_cont(sparse, list_transform(range(0, 1001), lambda k: k / 1000.0)))) AS q, count(sparse) AS n FROM book WHERE split = 'train'),
  spot AS (SELECT id, sparse, q, n, len(q) - 1 AS last, greatest(least(len(list_filter(q, lambda v: v <= sparse)), len(q) - 1), 1) AS k FROM book, g),
  placed AS (SELECT id, CASE WHEN sparse IS NOT NULL THEN least(greatest((k - 1 + (sparse - q[k]) / (q[k + 1] - q[k])) / last, 0.5 / n), 1 - 0.5 / n) END AS p FROM spot),
  normal AS (SELECT id, {score} AS z FROM placed)"""


def _normal_sql(p: str) -> str:
    """The rational approximation of the inverse normal distribution that `transforms.inverse_normal` uses."""
    a, b, c, d = transforms.NORMAL_COEFFICIENTS

    def poly(coefficients, x):
        out = f"{coefficients[0]!r}::DOUBLE"
        for k in coefficients[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    q, tail = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{poly(c, tail)} / {poly(d, tail)}"
    return f"CASE WHEN {p} > 0.02425 AND {p} < 0.97575 THEN {q} * {poly(a, f'({q} * {q})')} / {poly(b, f'({q} * {q})')} WHEN {p} <= 0.02425 THEN {outer} ELSE -({outer}) END"


register(
    "smoothed_transforms",
    SMOOTHED + YEO_POWER + NORMAL.format(score=_normal_sql("p")) + f" SELECT b.id, {zero('before', 4)} AS smoothed, {r(_yeo('balance', 'c'), 4)} AS yeo, {r('z', 4)} AS normal FROM book b JOIN walk USING (id) JOIN normal USING (id), y3",
    on_book(lambda b: transformed(b, [T("ewma", "sparse", "smoothed"), T("yeo_johnson", "balance", "yeo"), T("normal_score", "sparse", "normal")], **panel), 4),
    BOOK_SQL.replace("WITH book", "WITH RECURSIVE book"),
)
register(
    "power_transforms",
    f" SELECT id, {r('pow(amount / 1e5, 1.5)')} AS power, {r('amount - m')} AS from_mean, {r('CASE WHEN abs(balance) > 1e-12 THEN amount / balance END', 4)} AS safe, {r('amount / 1e5 * balance')} AS crossed,"
    f" {r('floor((epoch(last) - epoch(date)) / 86400.0) / 30.4375')} AS months, {r('floor((epoch(shipped) - epoch(date)) / 86400.0)')} AS days_between"
    " FROM (SELECT *, date + INTERVAL 36 HOUR AS shipped FROM book), (SELECT avg(amount) AS m, max(date) AS last FROM book WHERE split = 'train')",
    on_book(
        lambda b: transformed(
            b.withColumn("share", F.col("amount") / 1e5).withColumn("shipped", F.col("date") + F.expr("INTERVAL 36 HOUR")),
            [
                T("power", "share", "power", value=1.5),
                T("center_mean", "amount", "from_mean"),
                T("safe_ratio", "amount", "safe", second="balance"),
                T("interaction", "share", "crossed", second="balance"),
                T("date_age_months", "date", "months"),
                T("date_age_days", "date", "days_between", second="shipped"),
            ],
        ).withColumn("safe", rounded("safe", 4)),
        6,
    ),
)

# bins and encodings
EDGES = ", e AS (SELECT quantile_cont(sparse, [0.2, 0.4, 0.6, 0.8]) AS q, min(sparse) AS lo, max(sparse) AS hi FROM book WHERE split = 'train')"
register("quantile_bins", EDGES + " SELECT CASE WHEN sparse IS NULL THEN NULL WHEN sparse <= q[1] THEN 0 WHEN sparse <= q[2] THEN 1 WHEN sparse <= q[3] THEN 2 WHEN sparse <= q[4] THEN 3 ELSE 4 END AS bin, count(*) AS n FROM book, e GROUP BY 1", on_book(lambda b: b.groupBy(binning.bin_number(F.col("sparse"), binning.quantile_edges(b.where("split = 'train'"), "sparse", 5)).alias("bin")).agg(F.count("*").alias("n")), None))
register("equal_width_bins", EDGES + " SELECT CASE WHEN sparse IS NULL THEN NULL WHEN sparse <= lo + (hi - lo) * 1 / 4 THEN 0 WHEN sparse <= lo + (hi - lo) * 2 / 4 THEN 1 WHEN sparse <= lo + (hi - lo) * 3 / 4 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM book, e GROUP BY 1", on_book(lambda b: b.groupBy(binning.bin_number(F.col("sparse"), binning.equal_width_edges(b.where("split = 'train'"), "sparse", 4)).alias("bin")).agg(F.count("*").alias("n")), None))
register("manual_bins", " SELECT CASE WHEN amount <= 100000 THEN 0 WHEN amount <= 200000 THEN 1 ELSE 2 END AS bin, count(*) AS n, CAST(sum(target) AS BIGINT) AS events FROM book GROUP BY 1", on_book(lambda b: b.groupBy(binning.bin_number(F.col("amount"), [1e5, 2e5]).alias("bin")).agg(F.count("*").alias("n"), F.sum("target").alias("events")), None))
MONOTONE = f"""
    , t AS (SELECT amount, target FROM book WHERE split = 'train' AND amount IS NOT NULL),
      q AS ({' UNION ALL '.join(f"SELECT {n} AS n, list_distinct(quantile_cont(amount, [{', '.join(f'{k / n}::DOUBLE' for k in range(1, n))}])) AS q FROM t" for n in range(2, 9))}),
      m AS (SELECT n, len(list_filter(q, lambda e: amount > e)) AS b, avg(target::DOUBLE) AS r FROM t, q GROUP BY 1, 2),
      s AS (SELECT n, list(r ORDER BY b) AS r FROM m GROUP BY n),
      k AS (SELECT max(n) AS n FROM s WHERE r = list_sort(r) OR r = list_reverse_sort(r))
    SELECT len(list_filter(q, lambda e: amount > e))::INTEGER AS bin, count(*) AS n, {r('avg(target::DOUBLE)')} AS rate FROM book, q JOIN k USING (n) GROUP BY 1"""
register("monotonic_bins", MONOTONE, on_book(lambda b: b.groupBy(binning.bin_number(F.col("amount"), binning.monotonic_edges(b.where("split = 'train'"), "amount", "target", 8)).alias("bin")).agg(F.count("*").alias("n"), F.avg("target").alias("rate"))))
WOE = ", k AS (SELECT coalesce(sparse_segment, 'Missing') AS key, count(*) AS n, CAST(sum(target) AS BIGINT) AS events FROM book GROUP BY 1), w AS (SELECT *, (events + 0.5) / (sum(events) OVER () + 0.5 * count(*) OVER ()) AS bad, (n - events + 0.5) / (sum(n - events) OVER () + 0.5 * count(*) OVER ()) AS good FROM k)"
register("woe_table", WOE + f" SELECT key, n, events, {r('events / n')} AS bad_rate, {r('ln(good / bad)')} AS woe, {r('(good - bad) * ln(good / bad)', 8)} AS iv FROM w", on_book(lambda b: binning.woe_table(b, category("sparse_segment"), "target").select("key", "n", "events", rounded("bad_rate").alias("bad_rate"), rounded("woe").alias("woe"), rounded("iv", 8).alias("iv")), None))
register("woe_encoding", WOE.replace("FROM book GROUP", "FROM book WHERE split = 'train' GROUP") + f" SELECT b.id, {r('coalesce(ln(good / bad), 0)')} AS woe FROM book b LEFT JOIN w ON coalesce(b.sparse_segment, 'Missing') = w.key", on_book(lambda b: binning.encode(b, binning.woe_table(b.where("split = 'train'"), category("sparse_segment"), "target"), category("sparse_segment"), "woe", 0.0, "code").select("id", F.col("code").alias("woe"))))
register("level_encodings", ", k AS (SELECT coalesce(sparse_segment, 'Missing') AS key, count(*) AS n FROM book WHERE split = 'train' GROUP BY 1)" + f" SELECT key, {r('n / sum(n) OVER ()')} AS share, CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS code, CASE WHEN n / sum(n) OVER () >= 0.19 OR key = 'Missing' THEN key ELSE 'Other' END AS kept FROM k", on_book(lambda b: binning.frequency_table(b.where("split = 'train'"), "sparse_segment").join(binning.ordinal_table(b.where("split = 'train'"), "sparse_segment"), "key").join(binning.rare_levels(b.where("split = 'train'"), "sparse_segment", 0.19), "key").select("key", "share", F.col("code").cast("int").alias("code"), "kept")))
register("target_encoding", ", s AS (SELECT coalesce(sparse_segment, 'Missing') AS key, count(*) AS n, sum(target) AS s FROM book WHERE split = 'train' GROUP BY 1), g AS (SELECT avg(target) AS mu FROM book WHERE split = 'train')" + f" SELECT id, {r('''CASE WHEN split = 'train' THEN CASE WHEN n > 1 THEN (s - target + 20 * mu) / (n - 1 + 20) ELSE mu END ELSE coalesce(s / n, mu) END''')} AS encoded FROM g, book b LEFT JOIN s ON coalesce(b.sparse_segment, 'Missing') = s.key", on_book(lambda b: binning.target_encoding(b, "sparse_segment", "target").select("id", "encoded")))
register("psi_amount", ", e AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM book WHERE split = 'train'), c AS (SELECT CAST(len(list_filter(q, lambda v: v < amount)) AS INTEGER) AS bin, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS a FROM book, e WHERE split IN ('train', 'test') GROUP BY 1), p AS (SELECT bin, greatest(e / sum(e) OVER (), 1e-6) AS expected, greatest(a / sum(a) OVER (), 1e-6) AS actual FROM c)" + f" SELECT bin, {r('expected')} AS expected, {r('actual')} AS actual, {r('(actual - expected) * ln(actual / expected)', 8)} AS psi FROM p", on_book(lambda b: binning.psi(b, "amount", F.col("split") == "train", F.col("split") == "test").select("bin", rounded("expected").alias("expected"), rounded("actual").alias("actual"), rounded("psi", 8).alias("psi")), None))

# imputation
FILLS = ", t AS (SELECT avg(sparse) AS m, quantile_cont(sparse, 0.5) AS q FROM book WHERE split = 'train'), o AS (SELECT sparse_segment AS s FROM book WHERE split = 'train' AND sparse_segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
register("impute_scalar", FILLS + f" SELECT id, CASE WHEN sparse IS NULL THEN 1 ELSE 0 END AS sparse_missing, CASE WHEN sparse_segment IS NULL THEN 1 ELSE 0 END AS sparse_segment_missing, {r('coalesce(sparse, q)', 4)} AS sparse, coalesce(sparse_segment, s) AS sparse_segment FROM book, t, o", on_book(lambda b: imputation.fill(b, imputation.fit_fills(b.where("split = 'train'"), {"sparse": ("median", None), "sparse_segment": ("mode", None)})).select("id", "sparse_missing", "sparse_segment_missing", "sparse", "sparse_segment"), 4))
register("impute_group", ", t AS (SELECT sparse_segment AS g, avg(sparse) AS m FROM book WHERE split = 'train' GROUP BY 1)" + f" SELECT id, {r('coalesce(sparse, m, -1)', 3)} AS sparse FROM book LEFT JOIN t ON sparse_segment IS NOT DISTINCT FROM g", on_book(lambda b: imputation.fill_by_group(b, b.where("split = 'train'"), "sparse", ["sparse_segment"], "mean", -1.0).select("id", "sparse"), 3))
register("impute_carry", " SELECT id, last_value(sparse IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward, first_value(sparse IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM book", on_book(lambda b: b.select("id", imputation.carry("sparse", ["entity"], ["date", "id"]).alias("forward"), imputation.carry("sparse", ["entity"], ["date", "id"], False).alias("backward")), None))
register("missing_by_split", " SELECT split, 'sparse' AS \"column\", count(*) AS n, count(*) - count(sparse) AS missing, " + r("(count(*) - count(sparse)) / count(*)") + " AS share FROM book GROUP BY split UNION ALL SELECT split, 'sparse_segment', count(*), count(*) - count(sparse_segment), " + r("(count(*) - count(sparse_segment)) / count(*)") + " FROM book GROUP BY split", on_book(lambda b: imputation.missing_by(b, ["sparse", "sparse_segment"], "split")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
