"""Model metrics, exact and distributed.

Rank metrics first count rows per distinct score (a hash aggregate), then run over the scores in order, within ranges of
them, so that scores need not be rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import clipped_between, divided
from gritstone.operators.quantiles import running_shares


def score_counts(table: DataFrame, target: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, score, pos, neg and the counts up to each score and in total; any number of distinct scores, summed within ranges."""
    held = table.groupBy(*by, score).agg(F.sum(target).cast("bigint").alias("pos"), F.sum(1 - F.col(target)).cast("bigint").alias("neg"))
    return running_shares(held, score, ["pos", "neg"], by=by)


def rank_metrics(table: DataFrame, target: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """auc (mid-ranks), ks and average precision per group."""
    c = score_counts(table, target, score, by)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    gap = F.max(F.abs(F.col("pos_upto") / F.col("pos_all") - F.col("neg_upto") / F.col("neg_all")))
    above = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    every = above + F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    precision = F.sum(F.col("pos") / F.col("pos_all") * above / every)
    both = c.where("pos_all > 0 AND neg_all > 0")
    return both.groupBy(*by).agg((wins / (F.first("pos_all") * F.first("neg_all"))).alias("auc"), gap.alias("ks"), precision.alias("average_precision"))


def confusion(target: Column, predicted: Column) -> list[Column]:
    count = lambda t, p: F.sum(((target == t) & (predicted == p)).cast("bigint"))
    return [count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn")]


def rates(table: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc beside tp, fp, tn, fn; a ratio without a base is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.coalesce(divided(a, b), F.lit(0.0))
    return table.withColumns(
        {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}
    )


def probability_losses(target: Column, score: Column) -> list[Column]:
    p = clipped_between(score, 1e-15, 1 - 1e-15)
    return [F.avg((score - target) * (score - target)).alias("brier"), F.avg(-(target * F.log(p) + (1 - target) * F.log(1 - p))).alias("log_loss")]


def threshold_sweep(table: DataFrame, target: str, score: str, thresholds: list[float]) -> DataFrame:
    """Rates at each threshold (score >= threshold): all counts in one pass, then long."""
    counts = [c.alias(f"{n}_{k}") for k, t in enumerate(thresholds) for n, c in zip(("tp", "fp", "tn", "fn"), confusion(F.col(target), (F.col(score) >= t).cast("int")))]
    held = table.agg(*counts)
    each = (F.struct(F.lit(t).alias("threshold"), *(F.col(f"{n}_{k}").alias(n) for n in ("tp", "fp", "tn", "fn"))) for k, t in enumerate(thresholds))
    return rates(held.select(F.explode(F.array(*each)).alias("x")).select("x.*"))


def regression_metrics(table: DataFrame, target: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    e = F.col(target) - F.col(predicted)
    return table.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.avg(e * e) / F.var_pop(target)).alias("r2"), (1 - F.var_pop(e) / F.var_pop(target)).alias("explained_variance"),
    )


def multiclass_metrics(table: DataFrame, target: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1; classes that are only predicted have support 0."""
    cells = table.groupBy(target, predicted).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col(target).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.lit(0).cast("bigint").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.when(F.col(target) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")))).alias("x")).select("x.*")
    s = long.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hit")))
    ratio = lambda a, b: F.coalesce(divided(F.col(a), F.col(b)), F.lit(0.0))
    return s.select("class", "support", ratio("hit", "predicted").alias("precision"), ratio("hit", "support").alias("recall"), F.coalesce(divided(2.0 * F.col("hit"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"))


def joined_scores(primary: DataFrame, challenger: DataFrame, key: list[str], target: str, score: str) -> DataFrame:
    """key, target, primary and challenger score of the rows that both tables have; the key must be unique in each."""
    left = primary.select(*key, target, F.col(score).alias("primary"))
    return left.join(challenger.select(*key, F.col(score).alias("challenger")), key)


def comparison_table(table: DataFrame, target: str, scores: list[str], rank_by: str = "auc") -> DataFrame:
    """model (a column of scores), auc, ks, average precision, Brier score, log loss, and its place by one of them."""
    out = None
    for c in scores:
        losses = table.agg(*probability_losses(F.col(target), F.col(c)))
        one = rank_metrics(table, target, c).crossJoin(losses).select(F.lit(c).alias("model"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    order = F.asc(rank_by) if rank_by in ("brier", "log_loss") else F.desc(rank_by)
    return out.withColumn("place", F.row_number().over(Window.orderBy(order, "model")))  # a row per model


def multiclass_summary(table: DataFrame, target: str, predicted: str, probability: Column | None = None) -> DataFrame:
    """n, classes, accuracy, macro and weighted F1 (of classes seen or predicted; one without any hit counts 0), and the mean
    log loss if the probability of the row's own class is given."""
    per_class = multiclass_metrics(table, target, predicted)
    f1 = per_class.agg(F.count("*").alias("classes"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    loss = F.avg(-F.log(clipped_between(probability, 1e-15, 1.0))) if probability is not None else F.lit(None).cast("double")
    every = table.agg(F.count("*").alias("n"), F.avg((F.col(target) == F.col(predicted)).cast("double")).alias("accuracy"), loss.alias("log_loss"))
    return every.crossJoin(f1).select("n", "classes", "accuracy", "macro_f1", "weighted_f1", "log_loss")  # one row each


def calibration_fit(table: DataFrame, banded: DataFrame, target: str, score: str, band: str = "band") -> DataFrame:
    """Intercept and slope of the target on the score's logit, and the Hosmer-Lemeshow statistic over the bands with its
    p-value (as many degrees as bands less two, at least one), beside expected and largest calibration error."""
    from gritstone.functions.distributions import chi2_sf
    from gritstone.operators.frameworks import platt

    a, b, _ = platt(table, target, score)
    row = calibration_summary(calibration_table(banded, target, score, band)).first()
    degrees = max(row["bands"] - 2, 1)
    out = (float(a), float(b), row["ece"], row["mce"], row["hl"], degrees, chi2_sf(row["hl"], degrees))
    return table.sparkSession.createDataFrame([out], "intercept double, slope double, ece double, mce double, hosmer_lemeshow double, degrees int, p_value double")


def lift_table(banded: DataFrame, target: str, score: str, band: str = "band") -> DataFrame:
    """Per band (1 = highest scores): n, events, rate, mean score, capture, cumulative capture, lift."""
    held = banded.groupBy(band).agg(F.count("*").alias("n"), F.sum(target).cast("bigint").alias("events"), F.avg(score).alias("mean_score"))
    every = Window.partitionBy()
    upto = Window.orderBy(band).rowsBetween(Window.unboundedPreceding, 0)
    events, n = F.sum("events").over(every), F.sum("n").over(every)
    return held.select(band, "n", "events", "mean_score", (F.col("events") / F.col("n")).alias("rate"), (F.col("events") / events).alias("capture"), (F.sum("events").over(upto) / events).alias("cumulative_capture"), (F.col("events") / F.col("n") / (events / n)).alias("lift"))


def calibration_table(banded: DataFrame, target: str, score: str, band: str = "band") -> DataFrame:
    held = banded.groupBy(band).agg(F.count("*").alias("n"), F.avg(score).alias("expected"), F.avg(F.col(target).cast("double")).alias("observed"))
    return held.withColumn("gap", F.col("observed") - F.col("expected"))


def calibration_summary(calibration: DataFrame) -> DataFrame:
    """Expected and maximum calibration error and the Hosmer-Lemeshow statistic over the bands."""
    n, e, o = F.col("n"), F.col("expected"), F.col("observed")
    return calibration.agg((F.sum(n * F.abs(o - e)) / F.sum(n)).alias("ece"), F.max(F.abs(o - e)).alias("mce"), F.sum(n * (o - e) * (o - e) / (e * (1 - e))).alias("hl"), F.count("*").alias("bands"))
