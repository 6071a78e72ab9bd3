"""Fusion of five signals into a risk score, a level, a decision and evidence; all of it one projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.operators.rules import RuleEngine

#: Weights of the signals, thresholds of the levels.
DEFAULT_WEIGHTS = {"xgb": 0.35, "anomaly": 0.20, "behavioral": 0.15, "graph": 0.10, "rule": 0.20}
DEFAULT_LEVELS = {"red": 0.7, "yellow": 0.3}
BLOCK_AMOUNT = 1000


def weights(given: Mapping[str, float] | None = None) -> dict[str, float]:
    """Defaults with the given ones over them, scaled to a sum of 1."""
    out = DEFAULT_WEIGHTS | dict(given or {})
    total = sum(out.values())
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    return {k: v / total for k, v in out.items()}


def levels(given: Mapping[str, float] | None = None) -> dict[str, float]:
    out = DEFAULT_LEVELS | dict(given or {})
    if out["red"] <= out["yellow"]:
        out["red"] = min(1.0, out["yellow"] + 0.1)
    return out


def _num(name: str) -> Column:
    return F.coalesce(S.finite(name), F.lit(0.0))


def behavioral_score() -> Column:
    # fixed values: the steps and what each flag adds
    z = F.abs(_num("amount_zscore"))
    base = F.when(z > 3, 0.40).when(z > 2, 0.25).when(z > 1, 0.10).otherwise(0.0)
    added = {"is_new_device": 0.20, "is_unusual_location": 0.20, "is_new_user": 0.15, "country_switch": 0.15, "device_is_shared": 0.10, "is_offhours": 0.05}
    # added one by one to the base: in another order a sum at a threshold may end on its other side
    return F.least(sum((F.when(F.col(c) == 1, w).otherwise(0.0) for c, w in added.items()), base), F.lit(1.0))


def graph_score() -> Column:
    # fixed values: the steps of both signals and of the countries
    n, v, c = _num("device_account_count"), _num("vel_count_300s"), _num("prior_unique_countries")
    shared = F.when(n >= 4, 0.9).when(n >= 3, 0.7).when(n >= 2, 0.5).otherwise(0.0)
    busy = F.when(v >= 8, 0.85).when(v >= 5, 0.6).otherwise(0.0)
    return F.least(F.greatest(shared, busy) + F.when(c >= 3, 0.15).when(c >= 2, 0.08).otherwise(0.0), F.lit(1.0))


def _evidence(df: DataFrame) -> Column:
    # fixed values: the texts of the entries, their limits and their order
    amount, z, v = S.amount_of(df), F.col("amount_zscore").cast("double"), F.col("vel_count_300s").cast("int")
    on = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    fired = lambda rule: F.array_contains("triggered_rules", rule)
    text = lambda label, value, digits, tail="": F.concat(F.lit(label), S.fixed(value, digits), F.lit(tail))
    usual_z = F.coalesce(~F.isnan(z) & (F.abs(z) > 2), F.lit(False))
    large_new = on("is_new_device") & (amount > 500)
    night = on("is_offhours") & (amount > 1000)
    entries = [
        F.when(v >= 5, F.format_string("high_velocity: %d txns in 5min", v)),
        F.when(v >= 8, F.format_string("burst_velocity: %d txns in 5min", v)),
        F.when(on("device_is_shared"), F.format_string("shared_device: %d accounts", F.col("device_account_count").cast("int"))),
        F.when(large_new, text("new_device_high_value: amount=", amount, 2)).when(on("is_new_device"), F.lit("new_device")),
        F.when(on("is_unusual_location"), F.coalesce(text("unusual_location: distance=", F.col("distance_to_prev_km"), 1, "km"), F.lit("unusual_location"))),
        F.when(on("country_switch") & ~on("is_unusual_location"), F.lit("country_switch")),
        F.when(usual_z, text("unusual_amount: z=", z, 1)),
        F.when(night, text("offhours_high_value: amount=", amount, 2)),
        # a rule is named where no entry above says the same
        F.when(fired("high_velocity") & ~F.coalesce(v >= 5, F.lit(False)), F.lit("rule:high_velocity")),
        F.when(fired("new_device_high_value"), F.lit("rule:new_device_high_value")),
        F.when(fired("unusual_location") & ~on("is_unusual_location"), F.lit("rule:unusual_location")),
        F.when(fired("unusual_amount") & ~usual_z, F.lit("rule:unusual_amount")),
        F.when(fired("shared_device") & ~on("device_is_shared"), F.lit("rule:shared_device")),
        F.when(fired("offhours_high_value") & ~night, F.lit("rule:offhours_high_value")),
        F.when(fired("burst_velocity") & ~F.coalesce(v >= 8, F.lit(False)), F.lit("rule:burst_velocity")),
        F.when(fired("new_device") & ~on("is_new_device"), F.lit("rule:new_device")),
        F.when(F.col("xgb_score") > 0.6, text("ml_flagged: fraud_prob=", F.col("xgb_score"), 2)),
        F.when(F.col("anomaly_score") > 0.6, text("anomalous_pattern: score=", F.col("anomaly_score"), 2)),
        F.when((F.col("graph_score") > 0.5) & ~on("device_is_shared"), text("graph_risk: score=", F.col("graph_score"), 2)),
        F.when(on("is_new_user") & ~on("is_new_device"), F.lit("new_user")),
    ]
    return F.array_distinct(F.array_compact(F.array(*entries)))


def fuse(df: DataFrame, given_weights: Mapping[str, float] | None = None, given_levels: Mapping[str, float] | None = None, engine: RuleEngine | None = None) -> DataFrame:
    """Adds the five scores (xgb_score and anomaly_score are given, 0 if absent), risk_score, risk_level, decision,
    triggered_rules and evidence."""
    w, t, engine = weights(given_weights), levels(given_levels), engine or RuleEngine()
    for name in ("xgb_score", "anomaly_score"):
        df = df.withColumn(name, S.clip(_num(name), 0.0, 1.0) if name in df.columns else F.lit(0.0))
    df = engine.triggered(df).withColumns({"behavioral_score": behavioral_score(), "graph_score": graph_score(), "rule_score": engine.score(df)})
    risk = w["xgb"] * F.col("xgb_score") + w["anomaly"] * F.col("anomaly_score") + w["behavioral"] * F.col("behavioral_score") + w["graph"] * F.col("graph_score") + w["rule"] * F.col("rule_score")
    df = df.withColumn("risk_score", S.clip(risk, 0.0, 1.0))
    level = F.when(F.col("risk_score") > t["red"], "RED").when(F.col("risk_score") > t["yellow"], "YELLOW").otherwise("GREEN")
    df = df.withColumn("risk_level", level).withColumn("__evidence", _evidence(df))
    some = (F.col("risk_score") > t["yellow"]) | (F.col("xgb_score") > 0.5) | (F.col("anomaly_score") > 0.5) | (F.col("behavioral_score") > 0.3) | (F.col("graph_score") > 0.3) | (F.col("rule_score") > 0.2)
    elevated = F.array(F.concat(F.lit("elevated_risk: score="), S.fixed(F.col("risk_score"), 2)))
    red = F.when(S.amount_of(df) > BLOCK_AMOUNT, "BLOCK").otherwise("INVESTIGATE")
    return df.withColumns(
        {
            "decision": F.when(F.col("risk_level") == "RED", red).when(F.col("risk_level") == "YELLOW", "STEP_UP").otherwise("APPROVE"),
            "evidence": F.when((F.size("__evidence") == 0) & some, elevated).otherwise(F.col("__evidence")),
        }
    ).drop("__evidence")
