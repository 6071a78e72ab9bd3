import json
import math

import pytest
from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.functions import text
from riskweft.functions.text import record_text
from riskweft.operators import fusion, graph, instruct, metrics, prepare, profiles
from riskweft.operators import features as X
from riskweft.operators.evidence import evidence_text
from riskweft.operators.rules import Rule, RuleEngine
from riskweft.schema import FLAT_COLUMNS, TABLES, SchemaError, required, validate


def frame(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


@pytest.fixture
def mini(spark):
    """Two accounts on one device; the second has a labelled transaction."""
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    return {
        "users": frame(spark, "users", [(1, t, "US", "standard"), (2, t, "US", "standard")]),
        "accounts": frame(spark, "accounts", [(1, 1, t, "checking", "active"), (2, 2, t, "checking", "active")]),
        "devices": frame(spark, "devices", [(1, "ios", "ab", t)]),
        "merchants": frame(spark, "merchants", [(1, "m", "retail", 5000, "US", "high")]),
        "locations": frame(spark, "locations", [(1, "c", "US", "US", 0.0, 0.0)]),
        "account_devices": frame(spark, "account_devices", [(1, 1, t, t, True), (2, 1, t, t, True), (2, 1, t, t, False)]),
        "transactions": frame(spark, "transactions", [(1, 1, 1, 1, 1, t, 10.0, "USD", "online", "ok", 0, "background", None), (2, 2, 1, 1, 1, t, 2000.0, "USD", "atm", "ok", 1, "new_device", None)]),
    }


def test_graph_mini(mini):
    assert [tuple(r) for r in graph.device_share_pairs(mini["account_devices"]).collect()] == [(1, 2, 1)]
    got = {r["txn_id"]: r for r in graph.graph_features(mini).collect()}
    assert [got[i]["account_suspicious_neighbor_count"] for i in (1, 2)] == [1, 0]
    assert [got[i]["shared_device_count"] for i in (1, 2)] == [1, 1]


def test_graph_of_nothing(mini):
    out = graph.graph_features(mini | {"transactions": mini["transactions"].limit(0)})
    assert out.count() == 0 and out.columns == ["txn_id", *graph.GRAPH_COLUMNS]


def test_repeated_links_do_not_fan_out(mini):
    rows = {r["txn_id"]: r for r in X.build_features(mini).collect()}
    assert len(rows) == 2 and rows[2]["device_account_count"] == 2 and rows[2]["is_primary_device_for_account"] == 1
    assert rows[1]["prior_mean_amount"] is None and rows[2]["is_high_value"] == 1 and rows[1]["is_high_risk_merchant"] == 1


def test_features_ignore_the_future(mini, spark):
    import datetime as dt

    later = frame(spark, "transactions", [(3, 1, 1, 1, 1, dt.datetime(2026, 2, 1), 5e5, "USD", "online", "ok", 1, "x", None)])
    cols = ["txn_id", *X.feature_columns()]
    before = sorted(X.build_features(mini).select(cols).collect())
    after = sorted(r for r in X.build_features(mini | {"transactions": mini["transactions"].unionByName(later)}).select(cols).collect() if r["txn_id"] < 3)
    assert before == after


def test_accounts_without_an_owner(mini, spark):
    """Their rows have the history of their account, not of all that lack an owner."""
    import datetime as dt

    rows = [(10 + i, a, 1, 1, 1, dt.datetime(2026, 1, 2, i), 10.0, "USD", "online", "ok", 0, "x", None) for i, a in enumerate((8, 9, 8, 8, 9))]
    got = {r["txn_id"]: r["prior_tx_count"] for r in X.build_features(mini | {"transactions": mini["transactions"].unionByName(frame(spark, "transactions", rows))}).collect()}
    assert got == {1: 0, 2: 0, 10: 0, 11: 0, 12: 1, 13: 2, 14: 1}


def test_zscore_of_constant_history(spark):
    df = spark.createDataFrame([(5.0, 5.0, 0.0), (6.0, 5.0, 0.0), (4.0, 5.0, 0.0), (7.0, 5.0, 2.0), (1.0, None, None)], "a double, m double, s double")
    assert [r[0] for r in df.select(X.zscore(F.col("a"), F.col("m"), F.col("s"))).collect()] == [None, math.inf, -math.inf, 1.0, None]


BENIGN = dict(vel_count_300s=0, is_new_device=0, amount=50.0, is_unusual_location=0, amount_zscore=0.0, device_is_shared=0, is_offhours=0)


def rules_of(spark, engine=None, **changed):
    df = spark.createDataFrame([BENIGN | changed], "vel_count_300s int, is_new_device int, amount double, is_unusual_location int, amount_zscore double, device_is_shared int, is_offhours int")
    return (engine or RuleEngine()).triggered(df).first()["triggered_rules"]


@pytest.mark.parametrize(
    ("changed", "fired"),
    [
        ({}, []),
        ({"vel_count_300s": 5}, ["high_velocity"]),
        ({"vel_count_300s": 8}, ["high_velocity", "burst_velocity"]),
        ({"is_new_device": 1, "amount": 501.0}, ["new_device_high_value", "new_device"]),
        ({"is_new_device": 1, "amount": 500.0}, ["new_device"]),
        ({"amount_zscore": -3.1}, ["unusual_amount"]),
        ({"amount_zscore": math.nan}, []),
        ({"amount_zscore": math.inf}, ["unusual_amount"]),
        ({"is_offhours": 1, "amount": 1001.0}, ["offhours_high_value"]),
        ({"device_is_shared": 1, "is_unusual_location": 1}, ["unusual_location", "shared_device"]),
    ],
)
def test_rules(spark, changed, fired):
    assert rules_of(spark, **changed) == fired


def test_rule_options(spark):
    assert rules_of(spark, RuleEngine({"vel_count_300s": 2}), vel_count_300s=2) == ["high_velocity"]
    assert RuleEngine().triggered(spark.range(1)).first()["triggered_rules"] == []
    with pytest.raises(ValueError, match="severity"):
        Rule("x", "odd", "", lambda get: get("amount") > 0)
    own = RuleEngine(rules=[Rule("big", "low", "", lambda get: get("amount") > 10)])
    assert [tuple(r)[:2] for r in own.evaluate(spark.createDataFrame([(11.0,)], "amount double")).first()["rules"]] == [("big", True)]


def test_weights_and_levels():
    assert abs(sum(fusion.weights({"xgb": 3}).values()) - 1) < 1e-12
    assert fusion.levels({"red": 0.2})["red"] == pytest.approx(0.4)


def test_perfect_scores(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8), (1, 0.95)], "label int, score double")
    assert tuple(metrics.auc_ap(df).first()) == (1.0, 1.0)


def test_ap_is_a_step_sum(spark):
    y, s = [0, 1, 0, 1, 1, 0, 0, 1], [0.1, 0.9, 0.6, 0.8, 0.35, 0.35, 0.2, 0.6]
    got = metrics.auc_ap(spark.createDataFrame(list(zip(y, s, strict=True)), "label int, score double")).first()
    assert got["roc_auc"] == pytest.approx(0.875) and got["average_precision"] == pytest.approx(0.854167, abs=1e-6)


def test_thresholds(spark):
    easy = spark.createDataFrame([(0, i / 200) for i in range(99)] + [(1, 1.0)], "label int, score double")
    assert metrics.recall_at_fpr(easy, 0.05).first()["recall"] == 1.0
    df = spark.createDataFrame([(0, x / 10) for x in range(1, 6)] + [(1, 0.7), (1, 0.8)], "label int, score double")
    assert metrics.tune_threshold(df, 0.0).first()["threshold"] == 0.7
    none = metrics.recall_at_fpr(spark.createDataFrame([(0, 0.9), (1, 0.1)], "label int, score double"), 0.0).first()
    assert none["recall"] == 0.0 and none["threshold"] == math.inf


def test_confusion(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 1], [0, 1, 1, 0, 1], strict=True)), "label int, predicted int")
    assert tuple(metrics.confusion(df).first()) == (1, 1, 1, 2)


def test_splits(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = prepare.stratified_split(df, "y", "k").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in out} == {(0, "train"): 126, (0, "val"): 27, (0, "test"): 27, (1, "train"): 14, (1, "val"): 3, (1, "test"): 3}
    with pytest.raises(prepare.SplitError):
        prepare.stratified_split(df.where("y = 0"), "y", "k")
    with pytest.raises(prepare.SplitError):
        prepare.stratified_split(df, "y", "k", {"train": 0.9, "test": 0.3})


def test_sample_repeats_rare_tags(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(40)], "k long, tag string")
    got = prepare.tagged_sample(df, "tag", "k", 10).groupBy("tag").agg(F.count("*"), F.count_distinct("k")).collect()
    assert sorted(map(tuple, got)) == [("a", 10, 3), ("b", 10, 10)]


def test_scaler_and_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    scaler = prepare.Scaler(["x"])
    with pytest.raises(RuntimeError):
        scaler.transform(df)
    assert scaler.fit(df).params["x"] == (4.0, pytest.approx(3.535534, abs=1e-6))
    odd = df.unionAll(spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "x double"))
    values = prepare.medians(odd, ["x"])
    assert values == {"x": 2.5} and prepare.impute(odd, values).where("x = 2.5").count() == 3


def test_unusual_hours(spark):
    hours = [0] * 24
    hours[9], hours[10], hours[11] = 10, 20, 15
    df = spark.createDataFrame([(hours,)], "h array<long>")
    assert df.select(profiles.usual_hours(F.col("h"))).first()[0] == [10, 11, 9]
    assert df.select(profiles.absent_hour(F.col("h"), F.lit(3)), profiles.absent_hour(F.col("h"), F.lit(10))).first()[:] == (True, False)


def test_profile_of_unknown_user(spark, mini):
    tx = mini["transactions"].withColumn("user_id", F.col("account_id"))
    known = profiles.build_profiles(tx.where("user_id = 1"))
    got = {r["user_id"]: r for r in profiles.score_transactions(tx, known).collect()}
    assert (got[2]["is_new_device"], got[2]["z_score"], got[2]["frequency_anomaly"]) == (1, 0.0, 0) and got[1]["is_new_device"] == 0


def test_evidence(spark):
    df = spark.createDataFrame([(math.log1p(100), 20.0, 1)], "amount_log double, prior_mean_amount double, is_new_device int")
    assert df.select(evidence_text(df)).first()[0] == ["amount 5.0x above user mean", "new device"]
    nothing = spark.range(1)
    assert nothing.select(evidence_text(nothing)).first()[0] == []


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"transaction_amount": 5000, "historical_average": 5000, "new_device": True}, ("HIGH", "ACCOUNT_TAKEOVER")),
        ({"transaction_amount": 20, "historical_average": 25}, ("LOW", "LEGITIMATE")),
        ({"transaction_amount": 10, "recent_transaction_count": 7}, ("HIGH", "VELOCITY_ABUSE")),
        ({"transaction_amount": 10, "location_distance_km": 500}, ("MEDIUM", "UNUSUAL_LOCATION")),
        ({"graph_signals": {"shared_device_accounts": 3}}, ("HIGH", "DEVICE_COMPROMISE")),
        ({"triggered_rules": ["high_velocity"]}, ("HIGH", "VELOCITY_ABUSE")),
    ],
)
def test_mock_answer(spark, given, want):
    df = spark.createDataFrame([(json.dumps(given),)], "x string")
    assert tuple(df.select(instruct.mock_answer(F.col("x")).alias("a")).select("a.*").first()) == want


def test_accuracy_of_nothing(spark):
    df = spark.createDataFrame([], "expected string, answer struct<risk_level:string,fraud_type:string>")
    assert tuple(instruct.accuracy(df).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("answer", ['{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'so {"a": 1,} there', 'so {"a": 1} there'])
def test_lenient_json(spark, answer):
    got = spark.createDataFrame([(answer,)], "x string").select(text.lenient_json(F.col("x"))).first()[0]
    assert json.loads(got) == {"a": 1}


@pytest.mark.parametrize("answer", ["", "no", "{", "} {", None])
def test_no_json(spark, answer):
    assert spark.createDataFrame([(answer,)], "x string").select(text.lenient_json(F.col("x"))).first()[0] is None


def test_schema_checks(spark):
    df = spark.createDataFrame([(0.0,) * 30 + (1,)], ", ".join(f"{c} {'int' if c == 'Class' else 'double'}" for c in FLAT_COLUMNS))
    assert validate(df.withColumn("more", F.lit(1)), FLAT_COLUMNS) == ["more"]
    with pytest.raises(SchemaError):
        validate(df.drop("V3"), FLAT_COLUMNS)
    with pytest.raises(SchemaError):
        validate(df.withColumn("Class", F.lit(2)), FLAT_COLUMNS)
    assert required(df, ["V2", "V1"]).columns == ["V2", "V1"]


def test_scalars(spark):
    row = spark.range(1).select(S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), S.safe_div(F.lit(1.0), F.lit(0.0), 7.0), S.ordinal(F.lit("odd")), S.off_hours(F.lit(5)), S.clip(F.lit(3.0), 0.0, 1.0)).first()
    assert row[0] == pytest.approx(math.pi * 6371) and row[1:] == (7.0, 0, 0, 1.0)


def test_record_text_cuts_only_when_asked(spark):
    row = spark.range(1).select(F.repeat(F.lit("abcd"), 1000).alias("text"))
    assert row.select(*[F.length(record_text({"text": F.col("text")}, *a)) for a in ((), (128,), (None,))]).first()[:] == (2048, 512, 4000)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_of_wide_rows(spark, coalesce):
    """No row is lost or numbered twice, whatever the partitions are made of."""
    df = spark.range(60_000).select(F.xxhash64("id").alias("h"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide")).repartition(7)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, coalesce)
    try:
        out = prepare.with_rank(df, ["h", "id"], "place", "n")
        got = out.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place"), F.max("n"), F.sum(F.length("wide"))).first()
        assert tuple(got) == (60_000, 60_000, 1, 60_000, 60_000, 256 * 60_000)
        by_place = [r["h"] for r in out.where("place % 5000 = 0").orderBy("place").collect()]
    finally:
        spark.conf.set(name, before)
    hashes = sorted(r["h"] for r in df.select("h").collect())
    assert by_place == [hashes[i - 1] for i in range(5000, 60_001, 5000)]
    split = prepare.ordered_split(df, ["h", "id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 48_000, "test": 12_000}


def test_pairs_in_blocks(spark):
    """However small the blocks, each pair once, under its smallest shared device."""
    rows = [(a, d) for d in range(3) for a in range(60) if (a * 7 + d * 3) % 4 < 3] + [(1, 9), (2, 9), (None, 9), (3, None)]
    links = spark.createDataFrame(rows, "account_id long, device_id long")
    want = {}
    for a, d in rows:
        for b, e in rows:
            if a is not None and b is not None and d is not None and d == e and a < b:
                want[a, b] = min(d, want.get((a, b), d))
    for block in (5, 1000):
        got = [tuple(r) for r in graph.device_share_pairs(links, block).collect()]
        assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


def test_neighbour_counts(spark):
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 2), (4, 2), (1, 2), (5, 3)], "account_id long, device_id long")
    tx = spark.createDataFrame([(1, 1), (4, 1), (2, 0), (4, 1)], "account_id long, label_fraud int")
    got = {r["account_id"]: (r["n"], r["suspicious"]) for r in graph.neighbour_counts(links, tx).collect()}
    assert got == {1: (3, 1), 2: (2, 1), 3: (3, 2), 4: (2, 1)}
    assert {r["account_id"]: r["n"] for r in graph.suspicious_neighbours(links, tx).collect()} == {1: 1, 2: 1, 3: 2, 4: 1}


@pytest.mark.parametrize("dense", [1, 4, 64])
def test_neighbour_counts_by_bitmaps(spark, dense):
    """Whichever devices have bitmaps, the counts are those of the pairs; accounts on several devices count once."""
    import random

    r = random.Random(dense)
    rows = [(a, d) for a in range(150) for d in r.sample(range(12), r.choice([0, 1, 1, 2, 5]))]
    rows += [(1000 + i, 50) for i in range(100)] + [(1000 + i, 60 + i) for i in range(40)] + [(3, 60), (1001, 60), (None, 1), (7, None), (1, 1), (1, 1), (5000, 99)]
    marked = {a for a in [*range(150), *range(1000, 1100)] if a % 7 == 0}
    links = spark.createDataFrame(rows, "account_id long, device_id long")
    tx = spark.createDataFrame([(a, int(a in marked)) for a in [*range(150), *range(1000, 1100)]] + [(None, 1), (9999, 1)], "account_id long, label_fraud int")
    on = {}
    for a, d in rows:
        if a is not None and d is not None:
            on.setdefault(d, set()).add(a)
    want = {}
    for a in {a for a, d in rows if a is not None and d is not None}:
        near = set().union(*(x for x in on.values() if a in x)) - {a}
        if near:
            want[a] = (len(near), len(near & marked))
    got = {r["account_id"]: (r["n"], r["suspicious"]) for r in graph.neighbour_counts(links, tx, dense).collect()}
    assert got == want


def test_a_hot_device_makes_no_pairs(spark):
    """A device of 100,000 accounts, each with a device of its own too: as many sets of bits as devices, not pairs."""
    links = spark.range(100_000).selectExpr("id AS account_id", "0L AS device_id").union(spark.range(100_000).selectExpr("id", "1 + id"))
    tx = spark.range(0, 100_000, 1000).selectExpr("id AS account_id", "1 AS label_fraud")
    got = graph.neighbour_counts(links, tx).groupBy("n", "suspicious").count().collect()
    assert sorted(map(tuple, got)) == [(99_999, 99, 100), (99_999, 100, 99_900)]


def test_quantiles(spark):
    import numpy as np

    r = np.random.default_rng(1)
    values = {"a": np.round(r.normal(size=3000), 2), "b": r.lognormal(size=3000)}
    rows = [(float(x), float(y), int(i % 3)) for i, (x, y) in enumerate(zip(values["a"], values["b"], strict=True))]
    df = spark.createDataFrame([*rows, (None, float("nan"), 0), (float("inf"), None, 1)], "a double, b double, g int")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(x["column"], x["share"]): x["value"] for x in prepare.quantiles(df, ["a", "b"], shares).collect()}
    assert len(got) == 12 and all(np.isclose(got[c, p], np.quantile(values[c], p)) for c in values for p in shares)
    by = {(x["g"], x["column"], x["share"]): x["value"] for x in prepare.quantiles(df, ["a", "b"], [0.5], "g").collect()}
    assert len(by) == 6 and all(np.isclose(by[g, c, 0.5], np.median(values[c][g::3])) for g in range(3) for c in values)
    assert prepare.quantiles(df.limit(0), ["a"], [0.5]).count() == 0 and prepare.medians(df.limit(0), ["a"]) == {"a": 0.0}
    one = spark.createDataFrame([(4.0,)], "a double")
    assert [x["value"] for x in prepare.quantiles(one, ["a"], [0.0, 0.3, 1.0]).collect()] == [4.0] * 3


def test_curve_of_crowded_scores(spark):
    """Scores that crowd at one end: the same counts as by sorting."""
    df = spark.range(4000).select((F.pow(F.rand(3), 8)).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("label")).cache()
    rows = sorted(((r["score"], r["label"]) for r in df.collect()), reverse=True)
    tp = fp = 0
    want = {}
    for s, y in rows:
        tp, fp = tp + y, fp + 1 - y
        want[s] = (tp, fp)
    got = {r["score"]: (r["tp"], r["fp"]) for r in metrics.curve(df).collect()}
    assert got == want
