"""Rules, scores, fusion, evidence and profile scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import features as X
from riskweft.operators import fusion, profiles
from riskweft.operators.evidence import evidence_text, top_evidence
from riskweft.operators.rules import RuleEngine
from riskweft.plans.sql import FEATURES, RISK, sql
from riskweft.sources.adapters import environment as env


def features(s, d):
    return X.build_features(env(s, d))


def with_signals(df):
    """Deterministic stand-ins for the two model scores, so the fusion can be checked exactly."""
    return df.withColumns({"xgb_score": (F.floor("amount").cast("long") % 101) / 100.0, "anomaly_score": (F.col("txn_id") * 37 % 101) / 100.0})


def fused(s, d):
    return fusion.fuse(with_signals(features(s, d)))


def scored_with_text(s, d):
    df = fused(s, d)
    return df.withColumn("evidence_text", evidence_text(df))


def joined(name):
    return F.array_join(name, "; ").alias(name)


def _rules_long(s, d):
    long = RuleEngine().evaluate(features(s, d)).select("txn_id", F.explode("rules").alias("r"))
    return long.select("txn_id", "r.rule_id", "r.severity", F.col("r.triggered").cast("int").alias("triggered"))


def _rules_wide(s, d):
    df = features(s, d)
    return df.select("txn_id", *[c.cast("int").alias(n) for n, c in RuleEngine().flags(df).items()])


def _custom_rules(s, d):
    df = features(s, d)
    return RuleEngine({"vel_count_300s": 1, "zscore": 1.5, "high_value_threshold": 100}).triggered(df).select("txn_id", joined("triggered_rules"))


def _profile_scoring(s, d):
    e = env(s, d)
    tx = X.with_owner(e["transactions"], e["accounts"], e["users"])
    past = tx.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp"))  # later payments meet profiles that don't know them
    out = profiles.score_transactions(tx, profiles.build_profiles(past))
    return out.select("txn_id", F.round("z_score", 4).alias("z_score"), "is_unusual_hour", "is_new_merchant", "is_new_device", "is_new_location", "frequency_anomaly")


def _top(s, d):
    top = top_evidence(features(s, d), ["amount_zscore", "amount_log", "prior_tx_count", "is_new_device", "country_switch"], 3)
    return top.select("txn_id", F.array_join(F.transform("top", lambda x: x["feature"]), ",").alias("top"))


NAMES = ["high_velocity", "new_device_high_value", "unusual_location", "unusual_amount", "shared_device", "offhours_high_value", "burst_velocity", "new_device"]
SEVERITIES = ["medium", "high", "medium", "high", "medium", "high", "critical", "low"]

PROFILE = """,
o AS (SELECT tx.*, user_id FROM tx LEFT JOIN owner USING (account_id)),
p AS (SELECT * FROM o WHERE ts < TIMESTAMP '2024-01-03'),
st AS (SELECT user_id, avg(amount) AS m, coalesce(stddev_samp(amount), 0) AS sd, count(*)::DOUBLE / (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1) AS freq, list(DISTINCT device_id) AS devices, list(DISTINCT location_id) AS places FROM p GROUP BY user_id),
hr AS (SELECT user_id, h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS r FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM p GROUP BY ALL)) WHERE r <= 12),
mt AS (SELECT user_id, merchant_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, merchant_id) AS r FROM (SELECT user_id, merchant_id, count(*) AS n FROM p WHERE merchant_id IS NOT NULL GROUP BY ALL)) WHERE r <= 3)"""

QUERIES = {
    "rules_long": (
        _rules_long,
        sql(" UNION ALL ".join(f"SELECT txn_id, '{n}' AS rule_id, '{v}' AS severity, r{i + 1}::INTEGER AS triggered FROM g" for i, (n, v) in enumerate(zip(NAMES, SEVERITIES, strict=True))), FEATURES, RISK),
    ),
    "rules_wide": (_rules_wide, sql("SELECT txn_id, " + ", ".join(f"r{i + 1}::INTEGER AS {n}" for i, n in enumerate(NAMES)) + " FROM g", FEATURES, RISK)),
    "rules_custom_thresholds": (
        _custom_rules,
        sql("""SELECT txn_id, array_to_string(list_filter([CASE WHEN vel_count_300s >= 1 THEN 'high_velocity' END, CASE WHEN is_new_device = 1 AND amount > 100 THEN 'new_device_high_value' END, CASE WHEN r3 THEN 'unusual_location' END,
            CASE WHEN abs(amount_zscore) > 1.5 THEN 'unusual_amount' END, CASE WHEN r5 THEN 'shared_device' END, CASE WHEN r6 THEN 'offhours_high_value' END, CASE WHEN r7 THEN 'burst_velocity' END, CASE WHEN r8 THEN 'new_device' END], lambda x: x IS NOT NULL), '; ') AS triggered_rules FROM g""", FEATURES, RISK),
    ),
    "rule_score": (lambda s, d: (lambda df: df.select("txn_id", F.round(RuleEngine().score(df), 6).alias("rule_score")))(features(s, d)), sql("SELECT txn_id, round(rule_score, 6) AS rule_score FROM s", FEATURES, RISK)),
    "behavioral_score": (lambda s, d: features(s, d).select("txn_id", F.round(fusion.behavioral_score(), 6).alias("behavioral_score")), sql("SELECT txn_id, round(behavioral_score, 6) AS behavioral_score FROM s", FEATURES, RISK)),
    "graph_score": (lambda s, d: features(s, d).select("txn_id", F.round(fusion.graph_score(), 6).alias("graph_score")), sql("SELECT txn_id, round(graph_score, 6) AS graph_score FROM s", FEATURES, RISK)),
    "fusion_decision": (lambda s, d: fused(s, d).select("txn_id", F.round("risk_score", 6).alias("risk_score"), "risk_level", "decision"), sql("SELECT txn_id, round(risk_score, 6) AS risk_score, risk_level, decision FROM risk", FEATURES, RISK)),
    "fusion_evidence": (lambda s, d: fused(s, d).select("txn_id", joined("triggered_rules"), joined("evidence")), sql("SELECT txn_id, array_to_string(triggered_rules, '; ') AS triggered_rules, array_to_string(evidence, '; ') AS evidence FROM ev", FEATURES, RISK)),
    "evidence_text": (lambda s, d: (lambda df: df.select("txn_id", F.array_join(evidence_text(df), "; ").alias("texts")))(features(s, d)), sql("SELECT txn_id, array_to_string(texts, '; ') AS texts FROM tx_text", FEATURES, RISK)),
    "topk_abs": (
        _top,
        sql("""SELECT txn_id, string_agg(n, ',' ORDER BY r) AS top FROM (SELECT txn_id, n, row_number() OVER (PARTITION BY txn_id ORDER BY abs(x) DESC, i) AS r FROM (
            SELECT txn_id, unnest(['amount_zscore', 'amount_log', 'prior_tx_count', 'is_new_device', 'country_switch']) AS n, unnest([amount_zscore, amount_log, prior_tx_count, is_new_device, country_switch]) AS x, unnest([0, 1, 2, 3, 4]) AS i FROM f) WHERE x IS NOT NULL AND NOT isinf(x)) WHERE r <= 3 GROUP BY txn_id""", FEATURES),
    ),
    "profile_scoring": (
        _profile_scoring,
        sql("""SELECT txn_id, round(CASE WHEN sd > 0 THEN (amount - m) / sd ELSE 0 END, 4) AS z_score, (hr.h IS NULL)::INTEGER AS is_unusual_hour, (st.user_id IS NULL OR (o.merchant_id IS NOT NULL AND mt.merchant_id IS NULL))::INTEGER AS is_new_merchant,
            (st.user_id IS NULL OR (device_id IS NOT NULL AND NOT coalesce(list_contains(devices, device_id), false)))::INTEGER AS is_new_device, (st.user_id IS NULL OR (location_id IS NOT NULL AND NOT coalesce(list_contains(places, location_id), false)))::INTEGER AS is_new_location,
            coalesce(count(*) OVER (PARTITION BY o.user_id, o.ts::DATE) > 2 * freq, false)::INTEGER AS frequency_anomaly
            FROM o LEFT JOIN st ON st.user_id = o.user_id LEFT JOIN hr ON hr.user_id = o.user_id AND hr.h = hour(ts) LEFT JOIN mt ON mt.user_id = o.user_id AND mt.merchant_id = o.merchant_id""", PROFILE),
    ),
}
