"""The SQL front end against the operators that it stands for."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskweft import catalog
from riskweft.operators import features as X
from riskweft.operators import fusion
from riskweft.operators.rules import RuleEngine
from riskweft.plans.risk import with_signals
from riskweft.sources.adapters import environment


@pytest.mark.parametrize(("given", "weights", "levels"), [({}, {}, {}), ({"vel_count_300s": 1, "zscore": 1.5, "high_value_threshold": 100}, {"rule": 0.6}, {"red": 0.3, "yellow": 0.1})])
def test_same_as_the_operators(spark, given, weights, levels):
    """Scores, level, decision and fired rules of every payment, with the defaults and with other settings."""
    e = environment(spark, SF)
    catalog.register(spark, e, given_thresholds=given, given_weights=weights, given_levels=levels)
    with_signals(e["transactions"].select("txn_id", "amount")).createOrReplaceTempView("model_scores")
    frame = with_signals(X.build_features(e))
    want = fusion.fuse(frame, weights, levels, RuleEngine(given)).select("txn_id", F.round("risk_score", 9), "risk_level", "decision")
    got = spark.sql(f"SELECT txn_id, round(risk_score, 9), risk_level, decision FROM ({catalog.RISK_QUERY})")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rules = spark.sql(f"SELECT f.txn_id, r.rule_id FROM features f, LATERAL {catalog.call('risk_rules', catalog.RULE_INPUTS)} r WHERE r.triggered")
    fired = RuleEngine(given).triggered(frame).select("txn_id", F.explode("triggered_rules"))
    assert sorted(map(tuple, rules.collect())) == sorted(map(tuple, fired.collect()))


def test_nulls_and_odd_numbers(spark):
    """Nulls fire nothing; an infinite deviation fires its rule and adds nothing to the behavioural score."""
    catalog.register(spark, environment(spark, SF))
    of = lambda inputs: ", ".join(f"CAST(NULL AS {t})" for t in inputs.values())
    row = spark.sql(f"SELECT rule_score({of(catalog.RULE_INPUTS)}), behavioral_score({of(catalog.BEHAVIOUR_INPUTS)}), graph_score({of(catalog.GRAPH_INPUTS)})").first()
    assert tuple(row) == (0.0, 0.0, 0.0)
    odd = spark.sql("SELECT rule_score(0, 0, 1D, 0, double('infinity'), 0, 0) > 0, rule_score(0, 0, 1D, 0, double('NaN'), 0, 0), behavioral_score(double('-infinity'), 0, 0, 0, 0, 0, 0), risk_level(0.5D), risk_decision('RED', NULL)").first()
    assert tuple(odd) == (True, 0.0, 0.0, "YELLOW", "INVESTIGATE")
