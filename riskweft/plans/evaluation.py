"""Curves, thresholds, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import metrics, prepare
from riskweft.plans.risk import features
from riskweft.plans.sql import FEATURES, SCORED, sql
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import table


def scored(s, d):
    return env(s, d)["transactions"].select("txn_id", F.col("label_fraud").alias("label"), ((F.floor("amount").cast("long") % 101) / 100.0).alias("score"))


def _rounded(df, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _split_sizes(s, d):
    out = prepare.stratified_split(env(s, d)["transactions"], "label_fraud", "txn_id")
    return out.groupBy("label_fraud", "split").agg(F.count("*").alias("n"))


def _sample_sizes(s, d):
    out = prepare.tagged_sample(env(s, d)["transactions"], "scenario_tag", "txn_id", 100)
    return out.groupBy("scenario_tag").agg(F.count("*").alias("n"), F.count_distinct("txn_id").alias("ids"))


def _tag_split_sizes(s, d):
    out = prepare.tagged_split(env(s, d)["transactions"], "scenario_tag", "txn_id")
    return out.groupBy("scenario_tag", "split").agg(F.count("*").alias("n"))


def _labels(s, d):
    return table(s, d, "labels").withColumns({"label": F.col("toxic"), "predicted": F.lit(1) - F.col("quality")})


FPR = 0.05

QUERIES = {
    "roc_points": (lambda s, d: _rounded(metrics.roc_curve(scored(s, d))), sql("SELECT score AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM rt", SCORED)),
    "pr_points": (lambda s, d: _rounded(metrics.pr_curve(scored(s, d))), sql("SELECT score AS threshold, round(prec, 9) AS precision, round(tpr, 9) AS recall FROM rt", SCORED)),
    "auc_ap": (lambda s, d: _rounded(metrics.auc_ap(scored(s, d))), sql("SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / any_value(p * n), 9) AS roc_auc, round(sum(pos * prec) / any_value(p), 9) AS average_precision FROM rt", SCORED)),
    "recall_at_fpr": (lambda s, d: _rounded(metrics.recall_at_fpr(scored(s, d), FPR)), sql(f"SELECT round(tpr, 9) AS recall, score AS threshold FROM rt WHERE fpr <= {FPR} ORDER BY tpr DESC, score DESC LIMIT 1", SCORED)),
    "tune_threshold": (
        lambda s, d: _rounded(metrics.tune_threshold(scored(s, d), FPR)),
        sql(f"SELECT score AS threshold, round(prec, 9) AS precision, round(tpr, 9) AS recall, round(2 * prec * tpr / (prec + tpr), 9) AS f1 FROM rt WHERE fpr <= {FPR} ORDER BY tpr DESC, score LIMIT 1", SCORED),
    ),
    "interpolated_recall": (
        lambda s, d: _rounded(metrics.interpolated_recall(scored(s, d), 0.01)),
        sql("""SELECT round(coalesce(lo.tpr, 0) + (hi.tpr - coalesce(lo.tpr, 0)) * (0.01 - coalesce(lo.fpr, 0)) / (hi.fpr - coalesce(lo.fpr, 0)), 9) AS recall, (SELECT score FROM rt ORDER BY abs(fpr - 0.01), score DESC LIMIT 1) AS threshold
            FROM (SELECT fpr, tpr FROM rt WHERE fpr > 0.01 ORDER BY fpr, tpr LIMIT 1) hi LEFT JOIN (SELECT fpr, tpr FROM rt WHERE fpr <= 0.01 ORDER BY fpr DESC, tpr DESC LIMIT 1) lo ON true""", SCORED),
    ),
    "confusion_prf": (
        lambda s, d: _rounded(metrics.precision_recall_f1(metrics.confusion(_labels(s, d)))),
        """SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy
        FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tp FROM labels)""",
    ),
    "evaluate_all": (
        lambda s, d: _rounded(metrics.evaluate(scored(s, d), 0.5, FPR)).select("tn", "fp", "fn", "tp", "threshold", "roc_auc", "recall_at_fpr"),
        sql(f"""SELECT tn, fp, fn, tp, 0.5::DOUBLE AS threshold, (SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / any_value(p * n), 9) FROM rt) AS roc_auc, (SELECT round(max(tpr), 9) FROM rt WHERE fpr <= {FPR}) AS recall_at_fpr
            FROM (SELECT count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM sc)""", SCORED),
    ),
    "class_lift": (
        lambda s, d: _rounded(metrics.class_lift(features(s, d), ["is_new_device", "is_high_value", "country_switch"], "label_fraud"), 6),
        sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (label_fraud = 1), 6) AS fraud_rate, round(avg({c}) FILTER (label_fraud = 0), 6) AS legit_rate, round(avg({c}) FILTER (label_fraud = 1) / greatest(avg({c}) FILTER (label_fraud = 0), 1e-6), 6) AS lift FROM f" for c in ("is_new_device", "is_high_value", "country_switch")), FEATURES),
    ),
    "stratified_split_sizes": (
        _split_sizes,
        sql("""SELECT label_fraud, split, n FROM (SELECT label_fraud, round(count(*) * 0.7)::BIGINT AS a, round(count(*) * 0.85)::BIGINT AS b, count(*) AS c FROM tx GROUP BY label_fraud)
            CROSS JOIN LATERAL (VALUES ('train', a), ('val', b - a), ('test', c - b)) x(split, n)"""),
    ),
    "stratified_split": (
        lambda s, d: prepare.stratified_split(env(s, d)["transactions"].select("txn_id", "label_fraud"), "label_fraud", "txn_id"),
        sql("""SELECT txn_id, label_fraud, CASE WHEN r <= round(n * 0.7::DOUBLE) THEN 'train' WHEN r <= round(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY label_fraud ORDER BY md5('42/' || txn_id), txn_id) AS r, count(*) OVER (PARTITION BY label_fraud) AS n FROM tx)"""),
    ),
    "tagged_sample": (
        lambda s, d: prepare.tagged_sample(env(s, d)["transactions"], "scenario_tag", "txn_id", 100).select("scenario_tag", "txn_id", "copy"),
        sql("SELECT scenario_tag, txn_id, 0 AS copy FROM tx QUALIFY row_number() OVER (PARTITION BY scenario_tag ORDER BY md5('42/' || txn_id), txn_id) <= 100"),
    ),
    "tagged_split": (
        lambda s, d: prepare.tagged_split(env(s, d)["transactions"], "scenario_tag", "txn_id").select("scenario_tag", "txn_id", "split"),
        sql("""SELECT scenario_tag, txn_id, CASE WHEN r <= v THEN 'val' WHEN r <= 2 * v THEN 'test' ELSE 'train' END AS split FROM (SELECT *, CASE WHEN n >= 5 THEN greatest(1, floor(n * 0.1)) ELSE floor(n * 0.1) END AS v
            FROM (SELECT *, row_number() OVER (PARTITION BY scenario_tag ORDER BY md5('42/' || txn_id), txn_id) AS r, count(*) OVER (PARTITION BY scenario_tag) AS n FROM tx))"""),
    ),
    "tagged_sample_sizes": (_sample_sizes, sql("SELECT scenario_tag, 100::BIGINT AS n, least(count(*), 100) AS ids FROM tx GROUP BY scenario_tag")),
    "tagged_split_sizes": (
        _tag_split_sizes,
        sql("""SELECT scenario_tag, split, n FROM (SELECT scenario_tag, count(*) AS c, CASE WHEN count(*) >= 5 THEN greatest(1, floor(count(*) * 0.1)) ELSE floor(count(*) * 0.1) END::BIGINT AS v FROM tx GROUP BY scenario_tag)
            CROSS JOIN LATERAL (VALUES ('val', v), ('test', v), ('train', c - 2 * v)) x(split, n)"""),
    ),
    "shuffled": (
        lambda s, d: prepare.with_rank(env(s, d)["transactions"].withColumn("h", F.md5(F.concat(F.lit("7/"), F.col("txn_id").cast("string")).cast("binary"))), ["h", "txn_id"], "place").select("txn_id", F.col("place").cast("long").alias("place"), "amount", "ts"),
        sql("SELECT txn_id, row_number() OVER (ORDER BY md5('7/' || txn_id), txn_id) AS place, amount, ts FROM tx"),
    ),
}
