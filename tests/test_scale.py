"""Faults that show on larger tables only, held on small ones."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta
from functools import partial
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.ml import attribution, boosting
from riskweft.operators import features as X
from riskweft.operators import fusion, graph, incremental, instruct, prepare
from riskweft.plans import textual
from riskweft.sources.adapters import environment
from riskweft.streaming import velocity


def test_behavioral_score_is_added_in_the_order_of_its_sql(spark):
    added = {"is_new_device": 0.20, "is_unusual_location": 0.20, "is_new_user": 0.15, "country_switch": 0.15, "device_is_shared": 0.10, "is_offhours": 0.05}
    rows = [(z, *flags) for z in (0.0, 1.5, 2.5, 3.5) for flags in product((0, 1), repeat=len(added))]
    df = spark.createDataFrame(rows, ["amount_zscore", *added])
    for row in df.withColumn("score", fusion.behavioral_score()).collect():
        want = {0.0: 0.0, 1.5: 0.10, 2.5: 0.25, 3.5: 0.40}[row["amount_zscore"]]
        for name, w in added.items():
            want += w * row[name]
        assert row["score"] == min(want, 1.0), row


def test_fixed_takes_a_value_just_short_of_a_half_as_one(spark):
    row = spark.range(1).select(*[S.fixed(F.lit(x), d).alias(n) for n, x, d in (("up", 2.2499999999999996, 1), ("down", -2.2499999999999996, 1), ("below", 2.2499, 1), ("none", 0.0, 1), ("whole", 99.5, 0))]).first()
    assert row.asDict() == {"up": "2.3", "down": "-2.3", "below": "2.2", "none": "0.0", "whole": "100"}


@pytest.fixture(scope="module")
def linked(spark):
    """Links of accounts with one to nine of thirty devices, and one account with all of them."""
    rng = random.Random(3)
    rows = [(a, d) for a in range(300) for d in rng.sample(range(30), rng.randint(1, 9))] + [(300, d) for d in range(30)]
    tx = [(a, int(a % 7 == 0)) for a in range(301)]
    pairs, of = {}, {}
    for a, d in rows:
        of.setdefault(d, set()).add(a)
    for d in sorted(of):
        for a in of[d]:
            for b in of[d]:
                if a < b:
                    pairs.setdefault((a, b), d)
    return spark.createDataFrame(rows, "account_id long, device_id long"), spark.createDataFrame(tx, "account_id long, label_fraud int"), pairs


@pytest.mark.parametrize(("block", "wide"), [(4000, 256), (40, 256), (40, 8), (40, 2)])
def test_pairs_meet_once_and_are_not_shuffled(linked, block, wide):
    links, tx, pairs = linked
    out = graph.device_share_pairs(links, block, wide)
    assert sorted((r["account_a"], r["account_b"], r["device_id"]) for r in out.collect()) == sorted((a, b, d) for (a, b), d in pairs.items())
    if wide >= 30:
        assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    bad = graph.fraud_accounts(tx)
    got = sorted((r["account_id"], r["other"]) for r in graph.marked_neighbours(links, bad, block, wide).collect())
    assert got == sorted((x, y) for a, b in pairs for x, y in ((a, b), (b, a)) if y % 7 == 0)


@pytest.mark.parametrize("dense", [0, 20, 64])
def test_neighbours_are_counted_in_cells(spark, linked, dense, monkeypatch):
    links, tx, pairs = linked
    seen = []

    def counted(*args):
        seen.append(1)
        return partial(counted_in_cells, most_maps=1, most_sets=3)(*args)

    counted_in_cells = graph._counted
    monkeypatch.setattr(graph, "_counted", counted)
    got = {r["account_id"]: (r["n"], r["suspicious"]) for r in graph.neighbour_counts(links, tx, dense).collect()}
    both = [(x, y) for a, b in pairs for x, y in ((a, b), (b, a))]
    n, bad = Counter(x for x, _ in both), Counter(x for x, y in both if y % 7 == 0)
    assert seen and got == {a: (n[a], bad[a]) for a in n}


def test_leaves_at_the_depth_limit_are_not_summed_over_the_rows(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (2000, 5)).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 9, 2000) > 24).astype(float)
    asked, grow = [], boosting._Growing.grow
    monkeypatch.setattr(boosting._Growing, "grow", lambda self, ask, *rest: grow(self, lambda nodes: asked.extend(nodes) or ask(nodes), *rest))
    p = boosting.Params(trees=4, max_depth=3, rows=1.0, columns=1.0, rate=0.3)
    model = boosting.fit_arrays(x, y, list("abcde"), p)
    assert asked and max(asked).bit_length() == p.max_depth
    margin = np.full(len(y), model.base)
    for tree in model.trees:
        prob = 0.5 * (1 + np.tanh(0.5 * margin))
        at = boosting._leaf_values(tree | {"value": np.arange(len(tree["value"]))}, x)
        for leaf in np.unique(at):
            g, h = (prob - y)[at == leaf].sum(), (prob * (1 - prob))[at == leaf].sum()
            assert abs(tree["value"][leaf] + p.rate * g / (h + p.l2)) < 1e-6 and abs(tree["cover"][leaf] - h) < 1e-4
        margin += boosting._leaf_values(tree, x)


def test_the_payments_of_six_times_sf01_are_one_block():
    assert 900_000 * 36 <= boosting.Boosting(boosting.Params()).block <= 64 << 20


def test_ranks_by_hash_never_join_by_the_group_alone(spark):
    """A group of nearly all rows must not meet its size in one task, which would read it whole."""
    df = spark.range(3000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = prepare.hash_rank(df, "label", "id", 1)
        joins = [x for x in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        rows = ranked.orderBy("label", "__place").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins and all("__b#" in x for x in joins), joins
    assert [r["__place"] for r in rows] == [*range(1, 2701), *range(1, 301)] and {r["__size"] for r in rows} == {2700, 300}
    for label in (0, 1):
        want = sorted((hashlib.md5(f"1/{i}".encode()).hexdigest(), i) for i in range(3000) if (i % 10 == 0) == label)
        assert [r["id"] for r in rows if r["label"] == label] == [i for _, i in want]


def test_velocity_holds_an_account_in_one_entry(spark, tmp_path):
    """However its rows are spread over windows: entries, calls and timers of a batch are one an account."""
    schema = "txn_id long, account_id long, ts timestamp, amount double"
    rows = [(i, i % 2, datetime(2024, 1, 1) + timedelta(seconds=25 * (i // 2)), float(i)) for i in range(44)]
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = velocity.velocity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60)
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "buckets").load().select("key.account_id")
        assert sorted(r["account_id"] for r in held.collect()) == [0, 1]
    got = {r["txn_id"]: (r["vel_count"], r["vel_amount"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for i, k, at, _ in rows:
        near = [a for j, q, t, a in rows if q == k and j < i and at - t < timedelta(seconds=60)]
        assert got[i] == (len(near), sum(near))


def test_only_users_beyond_a_task_are_cut_into_segments(spark, monkeypatch):
    """Their figures are those of the plain windows, and the rows of the others stay out of the many passes."""
    env = environment(spark, "/root/testdata/sf0.001")
    cut, before = [], X._in_segments
    monkeypatch.setattr(X, "_in_segments", lambda tx, *more: cut.append(tx.count()) or before(tx, *more))
    columns = ["txn_id", *[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in X.build_features(env).select(*X.feature_columns()).dtypes]]
    read = lambda **given: sorted(tuple(r) for r in X.build_features(env, X.FeatureConfig(**given)).select(*columns).collect())
    plain = read()
    assert read(segments=True) == plain and not cut
    assert read(segments=True, task_rows=22) == plain and 0 < cut[0] < len(plain)


def test_tasks_of_the_windows_are_as_many_as_the_rows_ask_for(spark):
    """Adaptive execution merges by compressed bytes; a task's sorts hold rows."""
    env = environment(spark, "/root/testdata/sf0.001")
    out = X.build_features(env, X.FeatureConfig(task_rows=100))
    assert out.select("txn_id", "vel_count_300s", "prior_unique_countries", "distance_to_prev_km").rdd.getNumPartitions() == 15


def test_profiles_are_made_in_tasks_of_bounded_size_and_days_are_split(spark, tmp_path, monkeypatch):
    tx = spark.range(4000).select((F.col("id") % 400).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 7 * 3600).alias("ts"), (F.col("id") * 7919 % 1000 / 10).alias("amount"), *[(F.col("id") % k).alias(c) for c, k in (("merchant_id", 7), ("device_id", 5), ("location_id", 3))])
    store = incremental.ProfileStore(spark, f"file://{tmp_path}/states")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        store.add(tx)
    finally:
        for k in small:
            spark.conf.unset(k)
    assert all(len(list(day.glob("*.parquet"))) > 1 for day in (tmp_path / "states" / "counts").glob("day=*"))  # one task a day made one file
    monkeypatch.setattr(incremental, "TASK_ROWS", 1000)
    want = -(-store.counts().count() // 1000)
    out = store.profiles()
    assert want > 4 and out.rdd.getNumPartitions() == want
    assert out.count() == 400 and out.agg(F.sum("n_transactions")).first()[0] == 4000


def test_two_answers_are_compared_in_one_pass(spark):
    rows = [(f'{{"risk_level":"{r}","fraud_type":"X"}}', *a) for r, a in zip(["high", "LOW", ""] * 5, [(("HIGH", "X"), ("LOW", "X")), (None, ("LOW", "Y")), (("LOW", "X"), None)] * 5, strict=True)]
    df = spark.createDataFrame(rows, "expected string, first struct<risk_level:string,fraud_type:string>, second struct<risk_level:string,fraud_type:string>")
    got = instruct.compare_answers(df, "first", "second")
    one = lambda c: instruct.accuracy(df.withColumn("answer", F.col(c)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, instruct.compare(one("first"), one("second")).collect()))
    both = textual._compare(spark, "/root/testdata/sf0.001")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_a_device_of_thirty_thousand_accounts_is_shuffled_three_times():
    assert 2 + 31_140 // graph.BLOCK <= 3


def test_ways_along_a_path_are_valued_once(monkeypatch):
    rng = np.random.default_rng(5)
    leaves = [(float(rng.normal()), {int(f): (-0.5, 0.5 + i, 0.1 + 0.2 * i) for i, f in enumerate(rng.permutation(6)[:m])}) for m in (0, 1, 3, 4)]
    x, valued = rng.normal(size=(1000, 6)), []
    plain = attribution._values
    monkeypatch.setattr(attribution, "_values", lambda keeps, shares: (valued.append(len(keeps)), plain(keeps, shares))[1])
    by_table = attribution.shapley(x, leaves)[0]
    assert valued == [2, 8, 16]
    monkeypatch.setattr(attribution, "TABLE", 0)
    assert np.allclose(by_table, attribution.shapley(x, leaves)[0], rtol=0, atol=1e-12)


@pytest.mark.parametrize("given", [{"trees": 5, "rate": 0.3, "max_depth": 4}, {"trees": 9, "rate": 0.3, "max_depth": 0, "max_leaves": 7, "min_rows": 5, "stop_after": 2}])
def test_a_fit_in_blocks_of_files_moves_no_rows_and_equals_that_over_tasks(spark, monkeypatch, given):
    random = np.random.default_rng(3)
    x = random.normal(size=(2000, 3))
    rows = [(*map(float, r), int(r[0] + r[1] * r[2] + random.normal() > 0), i % 5 == 0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, held boolean")
    fitted, over_tasks = boosting.Boosting(boosting.Params(**given), 0), boosting._fit_over_tasks
    monkeypatch.setattr(boosting, "_fit_over_tasks", lambda *a: pytest.fail("rows went through Spark for each level"))
    by_files = fitted.fit(df, list("abc"), "y", "held")
    monkeypatch.setattr(boosting, "_fit_on_files", lambda binned, columns, cuts, p, *a: over_tasks(binned, columns, cuts, p))
    assert by_files.trees and by_files == fitted.fit(df, list("abc"), "y", "held")
