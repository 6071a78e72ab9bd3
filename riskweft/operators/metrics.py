"""Evaluation of scores against labels, exact, from one sorted pass over distinct scores.

Rows are first summed by score, with map-side combining. Running counts go in two levels: the sums are dealt into ranges
of scores that hold as many each, and written; ranges are counted and prefixed, then each runs on its own, so no task
sorts all scores, however they crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweft.scratch import in_ranges, kept


def by_score(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg)."""
    y = F.col(label).cast("int")
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tp, fp, positives, negatives): counts at the threshold `>= score`, for every distinct score."""
    per = in_ranges(by_score(df, label, score), ["score"], "curve", "range")
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not scores
    every = Window.partitionBy(F.lit(0))
    ranges = per.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.sum("p").over(every).alias("positives"), F.sum("n").over(every).alias("negatives"))
    w = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)}).join(ranges, "range")
    return run.select("score", "pos", "neg", (F.col("tp") + F.col("p_above")).alias("tp"), (F.col("fp") + F.col("n_above")).alias("fp"), "positives", "negatives")


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _roc(points: DataFrame) -> DataFrame:
    return points.select(F.col("score").alias("threshold"), _rate(F.col("fp"), F.col("negatives")).alias("fpr"), _rate(F.col("tp"), F.col("positives")).alias("tpr"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score."""
    return _roc(curve(df, label, score))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) for every distinct score."""
    c = curve(df, label, score)
    return c.select(F.col("score").alias("threshold"), _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _rate(F.col("tp"), F.col("positives")).alias("recall"))


def _areas(points: DataFrame) -> DataFrame:
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return points.agg(F.try_divide(area, F.max("positives") * F.max("negatives")).alias("roc_auc"), F.try_divide(steps, F.max("positives")).alias("average_precision"))


def auc_ap(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: roc_auc (trapezoids, ties count half) and average_precision (steps)."""
    return _areas(curve(df, label, score))


def _recall_at(points: DataFrame, target: float) -> DataFrame:
    best = _roc(points).where(F.col("fpr") <= target).agg(F.max(F.struct("tpr", "threshold")).alias("x"))
    return best.select(F.coalesce("x.tpr", F.lit(0.0)).alias("recall"), F.when(F.coalesce("x.tpr", F.lit(0.0)) > 0, F.col("x.threshold")).otherwise(float("inf")).alias("threshold"))


def recall_at_fpr(df: DataFrame, target: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the largest recall with a false-positive rate of at most target, and the highest threshold with it.

    If no threshold has such a rate: recall 0 and an infinite threshold, which flags nothing.
    """
    return _recall_at(curve(df, label, score), target)


def tune_threshold(df: DataFrame, target: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row: threshold, precision, recall, f1. The lowest candidate (a score, 0 or 1) of the largest recall within the
    false-positive rate; all 0 if none has any recall."""
    c = kept(curve(df, label, score), "points")
    precision, recall = _rate(F.col("tp"), F.col("tp") + F.col("fp")), _rate(F.col("tp"), F.col("positives"))
    ok = c.where((F.col("fp") <= target * F.greatest(F.col("negatives"), F.lit(1))) & (F.col("tp") > 0))
    best = ok.agg(F.max(F.struct(recall.alias("recall"), (-F.col("score")).alias("minus"), precision.alias("precision"))).alias("x"))
    # 0 stands for every score if it is below all of them and all may be flagged
    low = c.agg(F.min("score").alias("low"))
    r, p = F.coalesce("x.recall", F.lit(0.0)), F.coalesce("x.precision", F.lit(0.0))
    t = F.coalesce(-F.col("x.minus"), F.lit(0.0))
    t = F.when((t > 0) & (t == F.col("low")), 0.0).otherwise(t)
    return best.crossJoin(low).select(t.alias("threshold"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    return df.agg(F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 1) & (y == 1)).alias("tp"))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy to confusion counts; 0 where undefined."""
    p, r = _rate(F.col("tp"), F.col("tp") + F.col("fp")), _rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "accuracy": _rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def evaluate(df: DataFrame, threshold: float, target_fpr: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row with all figures of a scored set at a threshold."""
    counts = precision_recall_f1(confusion(df.withColumn("predicted", F.col(score) >= threshold), label))
    points = kept(curve(df, label, score), "points")
    at = _recall_at(points, target_fpr).select(F.col("recall").alias("recall_at_fpr"), F.col("threshold").alias("threshold_at_fpr"))
    return counts.crossJoin(_areas(points)).crossJoin(at).withColumn("threshold", F.lit(threshold))  # one row each


def interpolated_recall(df: DataFrame, target: float = 0.01, label: str = "label", score: str = "score") -> DataFrame:
    """One row: recall at the target rate by linear interpolation along the curve from (0, 0), and the threshold whose
    rate is nearest the target, the highest among equals."""
    r = kept(roc_curve(df, label, score), "points")
    below = r.where(F.col("fpr") <= target).agg(F.max(F.struct("fpr", "tpr")).alias("x")).select(F.coalesce("x.fpr", F.lit(0.0)).alias("x0"), F.coalesce("x.tpr", F.lit(0.0)).alias("y0"))
    above = r.where(F.col("fpr") > target).agg(F.min(F.struct("fpr", "tpr")).alias("x")).select(F.col("x.fpr").alias("x1"), F.col("x.tpr").alias("y1"))
    near = r.agg(F.min(F.struct(F.abs(F.col("fpr") - target).alias("d"), (-F.col("threshold")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("threshold"))
    y = F.col("y0") + F.coalesce((F.col("y1") - F.col("y0")) * (target - F.col("x0")) / (F.col("x1") - F.col("x0")), F.lit(0.0))
    return below.crossJoin(above).crossJoin(near).select(y.alias("recall"), "threshold")  # one row each


def class_lift(df: DataFrame, flags: list[str], label: str = "label") -> DataFrame:
    """(feature, fraud_rate, legit_rate, lift): share of each class that has the flag."""
    y = F.col(label)
    one = df.agg(*[x for f in flags for x in (F.avg(F.when(y == 1, F.col(f).cast("double"))).alias(f"{f}__1"), F.avg(F.when(y == 0, F.col(f).cast("double"))).alias(f"{f}__0"))])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(f"{f}__1", F.lit(0.0)).alias("fraud_rate"), F.coalesce(f"{f}__0", F.lit(0.0)).alias("legit_rate")) for f in flags])).alias("x")).select("x.*")
    return rows.withColumn("lift", F.col("fraud_rate") / F.greatest("legit_rate", F.lit(1e-6)))
