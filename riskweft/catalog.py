"""The risk engine as SQL: tables, features and functions registered in the session, so a whole risk query is one text.

`register` makes temporary views of the seven tables and of the features, and temporary SQL functions of the scores, the
level, the decision and the rules; these are inlined into the plan, so a query runs as expressions of the engine, without
Python. Thresholds, weights and levels are those given, with the defaults of the operators behind them.

    SELECT txn_id, risk_decision(risk_level(risk_score(0, 0, behavioral_score(...), graph_score(...), rule_score(...))), amount) FROM features
    SELECT txn_id, rule_id FROM features f, LATERAL risk_rules(f.vel_count_300s, ...) WHERE triggered
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from riskweft.operators import features as X
from riskweft.operators import fusion
from riskweft.operators.rules import SEVERITY_WEIGHTS, default_rules, thresholds

#: What the rules read, in the order of the arguments of risk_rules and rule_score.
RULE_INPUTS = {"vel_count_300s": "INT", "is_new_device": "INT", "amount": "DOUBLE", "is_unusual_location": "INT", "amount_zscore": "DOUBLE", "device_is_shared": "INT", "is_offhours": "INT"}
BEHAVIOUR_INPUTS = {"amount_zscore": "DOUBLE", "is_new_device": "INT", "is_unusual_location": "INT", "is_new_user": "INT", "country_switch": "INT", "device_is_shared": "INT", "is_offhours": "INT"}
GRAPH_INPUTS = {"device_account_count": "INT", "vel_count_300s": "INT", "prior_unique_countries": "INT"}


def _conditions(given: Mapping[str, float] | None) -> dict[str, str]:
    """SQL of each rule's condition over RULE_INPUTS."""
    t = {k: f"{float(v)!r}D" for k, v in thresholds(given).items()}
    amount = "coalesce(amount, 0)"
    return {
        "high_velocity": f"coalesce(vel_count_300s, 0) >= {t['high_velocity']}",
        "new_device_high_value": f"is_new_device = 1 AND {amount} > {t['new_device_high_value_amount']}",
        "unusual_location": "is_unusual_location = 1",
        "unusual_amount": f"NOT isnan(coalesce(amount_zscore, 0)) AND abs(coalesce(amount_zscore, 0)) > {t['unusual_amount_zscore']}",
        "shared_device": "device_is_shared = 1",
        "offhours_high_value": f"is_offhours = 1 AND {amount} > {t['offhours_high_value_amount']}",
        "burst_velocity": f"coalesce(vel_count_300s, 0) >= {t['burst_velocity']}",
        "new_device": "is_new_device = 1",
    }


def _finite(name: str) -> str:
    return f"CASE WHEN isnan({name}) OR abs({name}) = double('infinity') THEN 0 ELSE coalesce({name}, 0) END"


def functions(given_thresholds: Mapping[str, float] | None = None, given_weights: Mapping[str, float] | None = None, given_levels: Mapping[str, float] | None = None) -> dict[str, str]:
    """Name of each function to the text that makes it."""
    takes = lambda inputs: ", ".join(f"{n} {t}" for n, t in inputs.items())
    conditions, rules = _conditions(given_thresholds), default_rules(given_thresholds)
    fired = {r.rule_id: f"coalesce({conditions[r.rule_id]}, false)" for r in rules}
    rows = ", ".join(f"struct('{r.rule_id}' AS rule_id, '{r.severity}' AS severity, {fired[r.rule_id]} AS triggered, double({SEVERITY_WEIGHTS[r.severity]}) AS weight)" for r in rules)
    total = sum(SEVERITY_WEIGHTS[r.severity] for r in rules)
    weight = " + ".join(f"IF({fired[r.rule_id]}, {float(SEVERITY_WEIGHTS[r.severity])!r}D, 0D)" for r in rules)
    w, t = fusion.weights(given_weights), fusion.levels(given_levels)
    z = f"abs({_finite('amount_zscore')})"
    # fixed values: the steps and additions of the two scores, as in the fusion
    flags = {"is_new_device": 0.20, "is_unusual_location": 0.20, "is_new_user": 0.15, "country_switch": 0.15, "device_is_shared": 0.10, "is_offhours": 0.05}
    added = " + ".join(f"IF({c} = 1, {x}D, 0D)" for c, x in flags.items())
    n, v, c = (f"coalesce({x}, 0)" for x in GRAPH_INPUTS)
    shared, busy = f"CASE WHEN {n} >= 4 THEN 0.9D WHEN {n} >= 3 THEN 0.7D WHEN {n} >= 2 THEN 0.5D ELSE 0D END", f"CASE WHEN {v} >= 8 THEN 0.85D WHEN {v} >= 5 THEN 0.6D ELSE 0D END"
    scores = {"xgb": "xgb", "anomaly": "anomaly", "behavioral": "behavioral", "graph": "graph", "rule": "rule"}
    return {
        "risk_rules": f"({takes(RULE_INPUTS)}) RETURNS TABLE (rule_id STRING, severity STRING, triggered BOOLEAN, weight DOUBLE) RETURN SELECT x.rule_id, x.severity, x.triggered, x.weight FROM (SELECT explode(array({rows})) AS x)",
        "rule_score": f"({takes(RULE_INPUTS)}) RETURNS DOUBLE RETURN ({weight}) / {float(total)!r}D",
        "behavioral_score": f"({takes(BEHAVIOUR_INPUTS)}) RETURNS DOUBLE RETURN least(CASE WHEN {z} > 3 THEN 0.40D WHEN {z} > 2 THEN 0.25D WHEN {z} > 1 THEN 0.10D ELSE 0D END + ({added}), 1D)",
        "graph_score": f"({takes(GRAPH_INPUTS)}) RETURNS DOUBLE RETURN least(greatest({shared}, {busy}) + CASE WHEN {c} >= 3 THEN 0.15D WHEN {c} >= 2 THEN 0.08D ELSE 0D END, 1D)",
        "risk_score": f"({', '.join(f'{s} DOUBLE' for s in scores)}) RETURNS DOUBLE RETURN least(greatest({' + '.join(f'{float(w[s])!r}D * {s}' for s in scores)}, 0D), 1D)",
        "risk_level": f"(score DOUBLE) RETURNS STRING RETURN CASE WHEN score > {float(t['red'])!r}D THEN 'RED' WHEN score > {float(t['yellow'])!r}D THEN 'YELLOW' ELSE 'GREEN' END",
        "risk_decision": f"(level STRING, amount DOUBLE) RETURNS STRING RETURN CASE level WHEN 'RED' THEN IF(amount > {fusion.BLOCK_AMOUNT}, 'BLOCK', 'INVESTIGATE') WHEN 'YELLOW' THEN 'STEP_UP' ELSE 'APPROVE' END",
    }


def register(spark: SparkSession, env: Mapping[str, DataFrame], config: X.FeatureConfig = X.FeatureConfig(), given_thresholds: Mapping[str, float] | None = None, given_weights: Mapping[str, float] | None = None, given_levels: Mapping[str, float] | None = None) -> None:
    """Views of the tables and of the features, and the functions, in this session; earlier ones of these names are replaced."""
    for name, df in env.items():
        df.createOrReplaceTempView(name)
    X.build_features(env, config).createOrReplaceTempView("features")
    for name, text in functions(given_thresholds, given_weights, given_levels).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")


def call(name: str, inputs: Mapping[str, str], of: str = "f") -> str:
    """The text of a call with the columns that it reads."""
    return f"{name}({', '.join(f'{of}.{c}' for c in inputs)})"


#: A whole risk query: scores of the models come from a table of (txn_id, xgb_score, anomaly_score).
RISK_QUERY = f"""
WITH scored AS (
    SELECT f.txn_id, f.amount, risk_score(coalesce(m.xgb_score, 0), coalesce(m.anomaly_score, 0), {call('behavioral_score', BEHAVIOUR_INPUTS)}, {call('graph_score', GRAPH_INPUTS)}, {call('rule_score', RULE_INPUTS)}) AS risk_score
    FROM features f LEFT JOIN model_scores m USING (txn_id))
SELECT txn_id, risk_score, risk_level(risk_score) AS risk_level, risk_decision(risk_level(risk_score), amount) AS decision FROM scored"""
