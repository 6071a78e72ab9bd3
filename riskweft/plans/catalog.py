"""The risk query and the rules as SQL texts over registered tables and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft import catalog
from riskweft.plans.risk import QUERIES as RISK
from riskweft.plans.risk import with_signals
from riskweft.sources.adapters import environment as env


def _registered(s, d):
    e = env(s, d)
    catalog.register(s, e)
    with_signals(e["transactions"].select("txn_id", "amount")).createOrReplaceTempView("model_scores")


def _risk(s, d):
    _registered(s, d)
    return s.sql(f"SELECT txn_id, round(risk_score, 6) AS risk_score, risk_level, decision FROM ({catalog.RISK_QUERY})")


def _rules(s, d):
    _registered(s, d)
    rules = catalog.call("risk_rules", catalog.RULE_INPUTS)
    return s.sql(f"SELECT f.txn_id, r.rule_id, r.severity, r.triggered FROM features f, LATERAL {rules} r").withColumn("triggered", F.col("triggered").cast("int"))


QUERIES = {"risk_in_sql": (_risk, RISK["fusion_decision"][1]), "rules_in_sql": (_rules, RISK["rules_long"][1])}
