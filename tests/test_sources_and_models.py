import json

import numpy as np
import pytest
from conftest import SF
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweft.ml import attribution, boosting, iforest, models
from riskweft.ml.engine import FusionEngine
from riskweft.operators import prepare
from riskweft.plans.learning import drain
from riskweft.sources import generator, readers, writers
from riskweft.streaming import velocity


def test_flat_csv(spark, tmp_path):
    df = generator.flat_table(spark, 200).coalesce(1)
    df.write.option("header", True).csv(str(tmp_path / "flat"))
    (tmp_path / "flat" / "part-x.csv").write_text(",".join(df.columns) + "\n" + "," * 30 + "\n")
    got = readers.read_flat(spark, f"file://{tmp_path}/flat")
    assert got.count() == 200 and got.schema["Class"].dataType.simpleString() == "int"
    assert readers.profile_flat(got).agg(F.sum("n")).first()[0] == 200
    with pytest.raises(FileNotFoundError):
        readers.read_flat(spark, f"file://{tmp_path}/none")


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[\n {"a": 1},\n {"a": 2, "b": [1]}\n]')
    (tmp_path / "c.json").write_text('{\n "a": 1\n}')
    (tmp_path / "d.json").write_text("")
    read = lambda n, **k: [json.loads(r[0]) for r in readers.read_records(spark, f"file://{tmp_path}/{n}", **k).collect()]
    assert read("a.jsonl") == [{"a": 1}, {"a": 2}] and read("b.json") == [{"a": 1}, {"a": 2, "b": [1]}]
    assert read("c.json") == [{"a": 1}] and read("d.json") == [] and read("none") == [] and len(read("a.jsonl", limit=1)) == 1


def test_records_of_each_file(spark, tmp_path):
    """A bad first line costs that line only; the files of a folder may differ."""
    (tmp_path / "a.jsonl").write_text('not json\n{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[\n {"a": 3},\n 7, {"a": 4, "b": [1]}\n]')
    (tmp_path / "c.json").write_text('\n{\n "a": 5\n}')
    (tmp_path / "d.jsonl").write_text('{"a": \n{"a": 6}\n[1]\n')
    (tmp_path / "e.json").write_text('[{"a": 9},\n{"a": 7}\n{"a": 8}\n')
    (tmp_path / "f.jsonl").write_text("\n\n")
    got = sorted((json.loads(r[0]) for r in readers.read_records(spark, f"file://{tmp_path}").collect()), key=lambda x: x["a"])
    assert got == [{"a": 1}, {"a": 2}, {"a": 3}, {"a": 4, "b": [1]}, {"a": 5}, {"a": 6}, {"a": 7}, {"a": 8}]


def plain_records(text):
    """One file as Python takes it: a list, an object, or lines."""
    try:
        whole = json.loads(text)
        return whole if isinstance(whole, list) else [whole] if isinstance(whole, dict) else [whole]
    except ValueError:
        out = []
        for line in text.split("\n"):
            try:
                out.append(json.loads(line))
            except ValueError:
                pass
        return out


ODD_FILES = [
    '{"a": 1, "a": 2}\n{"b": NaN}\n{"c": -Infinity}\n{"d": [{"x": 1, "x": 2}]}\n7\n"text"\nnull\n',
    '[{"a": 1, "a": 2}, {"b": NaN}, 5, "x", [1, {"y": 2}], null]',
    '[\n{"t": "a } b ] c { \\" } , [ \\\\"},\n{"t": "}"}, {"u": {"v": [{}, {"w": "\\\\"}]}}\n]\n',
    "[]", "[1, 2, 3]", '[[1, 2], [{"x": 1}]]', '["}", "]", {"a": "[{"}]', '{\n"a": {"b": "}"}\n}', '{"a": "}{"}', '{\n"a": 1}  ',
    '{"open": \n{"a": 1}\n{"a": 2}\n', '[{"a": 1},\n{"a": 2}\n', '[{"a": 1}\n{"a": 2}]\n', '[{"a": 1},,{"a": 2}]', '[{"a": 1}, ]', '[{"a": 1}] x', '[,{"a": 1}]', '{"a": 1\n}\n{"b": 2}\n', '[{"a": "\\u00e9\\ud83d é🙂 }"}]',
]


@pytest.mark.parametrize("split", [None, "60"])
def test_records_as_python_takes_them(spark, tmp_path, split):
    """Repeated keys, NaN, items of any kind, braces in strings; whole files or splits of a few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i, text in enumerate(ODD_FILES):
        (tmp_path / f"{i:02}.json").write_text(text)
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        key = lambda x: json.dumps(x, sort_keys=True)
        got = [json.loads(r[0]) for r in readers.read_records(spark, f"file://{tmp_path}", any_value=True).collect()]
        want = [x for text in ODD_FILES for x in plain_records(text)]
        assert sorted(map(key, got)) == sorted(map(key, want))
        some = [json.loads(r[0]) for r in readers.read_records(spark, f"file://{tmp_path}").collect()]
        assert sorted(map(key, some)) == sorted(key(x) for x in want if isinstance(x, dict))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_large_array_is_many_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = "[" + ",\n ".join(json.dumps({"id": i, "t": "} " * (i % 7), "in": {"x": [i]}}) for i in range(5000)) + "]"
    (tmp_path / "a.json").write_text(text)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 10))
        got = readers.read_records(spark, f"file://{tmp_path}/a.json")
        assert sorted(json.loads(r[0])["id"] for r in got.collect()) == list(range(5000))
        cuts = readers._cut(spark, [f"file://{tmp_path}/a.json"])
        assert cuts.select(F.size("values").alias("n")).agg(F.max("n")).first()[0] == 1 and cuts.count() == 5001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_config(tmp_path):
    """The first file that there is; none gives no settings."""
    (tmp_path / "b.yaml").write_text("model: {depth: 6}\npaths: [x, y]\n")
    (tmp_path / "empty.yaml").write_text("")
    assert readers.config(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml")) == {"model": {"depth": 6}, "paths": ["x", "y"]}
    assert readers.config(str(tmp_path / "a.yaml")) == {} and readers.config(str(tmp_path / "empty.yaml")) == {} and readers.config() == {}


def test_late_rows_find_their_neighbours(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", 1.0), (2, 1, "2024-01-01 00:03:00", 2.0), (3, 1, "2024-01-01 00:14:00", None), (4, 1, "2024-01-01 00:09:00", 8.0), (5, 1, "2024-01-01 00:14:00", 16.0)]
    df = spark.createDataFrame(rows, "txn_id long, account_id long, t string, amount double").withColumn("ts", F.to_timestamp("t")).drop("t")
    for k in (1, 2, 3, 4, 5):
        df.where(f"txn_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["txn_id"]: (r["vel_count"], r["vel_amount"]) for r in drain(spark, velocity.velocity(stream, 600), "late").collect()}
    assert got == {1: (0, 0.0), 2: (1, 1.0), 3: (0, 0.0), 4: (2, 3.0), 5: (2, 8.0)}


def test_examples_fail_fast(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "x", "input": "{}", "output": "{}"}\n')
    assert readers.read_examples(spark, f"file://{tmp_path}").count() == 1
    (tmp_path / "b.jsonl").write_text('{"instruction": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.read_examples(spark, f"file://{tmp_path}").collect()


def test_export(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    model = models.fit(df, ["x"], "y", "logreg")
    at = f"file://{tmp_path}/out"
    assert writers.missing_exports(spark, at) == list(writers.EXPORT_LAYOUT)
    assert writers.export_all(spark, at, model, {"x": [0, 1]}, 0.5, ["x"], {"auc": 1.0}) == []
    assert json.loads(writers.read_text(spark, f"{at}/threshold.json")) == {"threshold": 0.5}
    p = models.Predictor(PipelineModel.load(f"{at}/model"), ["x"])
    assert p.predict_record(spark, {"x": 6.0})["prediction"] == 1 and p.predict_record(spark, {"x": 0.0})["prediction"] == 0
    with pytest.raises(ValueError, match="missing"):
        p.predict_record(spark, {})
    with pytest.raises(KeyError):
        models.build("odd")


def test_generator_invariants(spark):
    c = generator.EnvironmentConfig(transactions=800)
    env = {k: v.cache() for k, v in generator.generate(spark, c).items()}
    tx = env["transactions"]
    n = tx.count()
    assert [tuple(r) for r in tx.agg(F.min("txn_id"), F.max("txn_id"), F.count_distinct("txn_id")).collect()] == [(1, n, n)]
    for key, table in (("account_id", "accounts"), ("device_id", "devices"), ("merchant_id", "merchants"), ("location_id", "locations")):
        assert tx.join(env[table], key, "left_anti").count() == 0, key
    assert env["account_devices"].groupBy("account_id", "device_id").count().where("count > 1").count() == 0
    tags = {r["scenario_tag"]: r for r in writers.scenario_breakdown(tx).collect()}
    assert tags["background"]["n_fraud"] == 0 and tags["account_takeover"]["n_fraud"] == 30 and tags["transaction_velocity"]["n_total"] == tags["transaction_velocity"]["n_fraud"] >= 320
    nights = tx.where("scenario_tag = 'unusual_amount_time'").select(F.hour("ts")).distinct()
    assert {r[0] for r in nights.collect()} <= {2, 3, 4, 5}
    strange = tx.where("scenario_tag = 'unusual_location'").join(env["accounts"], "account_id").join(env["users"], "user_id").join(env["locations"], "location_id")
    assert strange.where("country = home_country").count() == 0
    linked = tx.join(env["account_devices"], ["account_id", "device_id"], "left_semi").groupBy("scenario_tag").count().collect()
    linked = {r["scenario_tag"]: r["count"] for r in linked}
    assert "new_device" not in linked and linked["background"] == 800
    assert tx.where("scenario_tag = 'background'").join(env["accounts"].where("status = 'active'"), "account_id", "left_anti").count() == 0
    assert tx.where("scenario_tag = 'unusual_merchant'").join(env["merchants"].where("risk_band = 'high'"), "merchant_id", "left_anti").count() == 0
    again = generator.generate(spark, c)["transactions"]
    assert again.exceptAll(tx).count() == 0


def test_generator_at_some_size(spark):
    """Gapless numbers over several partitions; high-risk merchants as often as their weight says."""
    env = generator.generate(spark, generator.EnvironmentConfig(accounts=20_000, users=15_000, transactions=60_000))
    tx = env["transactions"].cache()
    n = tx.count()
    assert n > 60_000 and tuple(tx.agg(F.min("txn_id"), F.max("txn_id"), F.count_distinct("txn_id")).first()) == (1, n, n)
    assert tx.withColumn("before", F.lag("ts").over(Window.orderBy("txn_id"))).where("before > ts").count() == 0
    bands = {r["risk_band"]: r["n"] for r in env["merchants"].groupBy("risk_band").agg(F.count("*").alias("n")).collect()}
    want = 0.05 * bands["high"] / (0.05 * bands["high"] + sum(v for k, v in bands.items() if k != "high"))
    share = tx.where("scenario_tag = 'background'").join(env["merchants"], "merchant_id").agg(F.avg((F.col("risk_band") == "high").cast("int"))).first()[0]
    assert abs(share - want) < 0.003


def test_hard_overlap(spark):
    env = generator.generate(spark, generator.EnvironmentConfig.hard_overlap())
    tx = env["transactions"].cache()
    tags = {r["scenario_tag"]: (r["n_total"], r["n_fraud"]) for r in writers.scenario_breakdown(tx).collect()}
    assert tags == {"background": (9000, 0), **dict.fromkeys(generator.HARD_SCENARIOS, (20, 20))}
    assert tx.where("currency IS NULL OR ts IS NULL OR device_id IS NULL").count() == 0
    high = tx.join(env["merchants"], "merchant_id").where("scenario_tag = 'background'").agg(F.avg((F.col("risk_band") == "high").cast("int"))).first()[0]
    assert abs(high - 0.2) < 0.02
    mine = tx.where("label_fraud = 1").withColumn("known", F.lit(1)).join(env["account_devices"].select("account_id", "device_id", F.lit(1).alias("linked")), ["account_id", "device_id"], "left")
    linked = {r["scenario_tag"]: r["n"] for r in mine.groupBy("scenario_tag").agg(F.count("linked").alias("n")).collect()}
    assert linked["hard_moderate_amo_dev"] == linked["hard_normal_amount_new_device_merchant"] == 0 and linked["hard_high_amount_normal_location_velocity"] == 20
    signals = {r[0] for r in tx.where("scenario_tag = 'hard_mixed_signals'").select(F.get_json_object("scenario_extra", "$.signal")).distinct().collect()}
    assert signals <= {"combo_0", "combo_1", "combo_2", "combo_3"} and len(signals) > 1
    repeated = tx.groupBy("account_id", "ts").agg(F.count("*").alias("n"), F.max("label_fraud").alias("y")).where("n > 1 AND y = 1")
    assert repeated.count() == 0


def test_isolation_forest(spark):
    random = np.random.default_rng(0)
    rows = [(i, *map(float, random.normal(0, 1, 3)), 0) for i in range(400)] + [(1000 + i, *map(float, random.normal(6, 1, 3)), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    forest = iforest.IsolationForest(["a", "b", "c"], trees=50).fit(df.where("y = 0"), "id")
    odd = df.unionByName(spark.createDataFrame([(5000, None, float("nan"), float("inf"), 2)], df.schema))
    got = {r["y"]: (r["m"], r["low"], r["high"]) for r in forest.transform(odd).groupBy("y").agg(F.avg("anomaly_score").alias("m"), F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high")).collect()}
    assert got[1][0] > got[0][0] + 0.3 and all(0 <= x[1] <= x[2] <= 1 for x in got.values())
    back = iforest.IsolationForest.from_json(forest.to_json())
    assert back.transform(df).exceptAll(forest.transform(df)).count() == 0
    with pytest.raises(RuntimeError):
        iforest.IsolationForest(["a"])._raw(df)


def test_attributions_sum_to_the_margin(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(200, 3))
    df = spark.createDataFrame([(*map(float, r), int(r[0] + r[1] * r[2] > 0)) for r in x], "a double, b double, c double, y int")
    for model in (models.fit(df, ["a", "b", "c"], "y", "fusion_gb", trees=4, rows=1.0), GBTClassifier(maxIter=4, maxDepth=4, seed=1, labelCol="y", featuresCol="f").fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df))):
        leaves = attribution.ensemble_paths(model)
        phi, base = attribution.shapley(x, leaves)
        margin = np.zeros(len(x))
        for value, path in leaves:
            margin += value * np.all([(x[:, f] > lo) & (x[:, f] <= hi) for f, (lo, hi, _) in path.items()] or [np.ones(len(x))], axis=0)
        assert np.allclose(phi.sum(1) + base, margin)
        if isinstance(model, boosting.BoostedTrees):
            assert np.allclose(margin + model.base, model.margin(x))
        got = attribution.attribute(df, model, ["a", "b", "c"]).limit(3).collect()
        assert np.allclose([r["attributions"] for r in got], phi[:3])


def plain_tree(x, g, h, depth, p):
    """Values of a tree by trying every split of every feature on the raw rows."""
    out = np.full(len(g), -p.rate * g.sum() / (h.sum() + p.l2))
    best = (1e-9, None)
    if depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                side = x[:, f] <= t
                if h[side].sum() >= p.min_weight and h[~side].sum() >= p.min_weight:
                    gain = (g[side].sum() ** 2 / (h[side].sum() + p.l2) + g[~side].sum() ** 2 / (h[~side].sum() + p.l2) - g.sum() ** 2 / (h.sum() + p.l2)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, side)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], g[side], h[side], depth - 1, p)
    return out


def test_boosting_against_plain_trees():
    random = np.random.default_rng(5)
    x = random.integers(0, 12, size=(300, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 5) + random.normal(size=300) > 9).astype(float)
    p = boosting.Params(trees=5, rate=0.3, max_depth=3, rows=1.0, columns=1.0)
    model = boosting.fit_arrays(x, y, list("abcd"), p)
    margin = np.full(300, np.log(y.mean() / (1 - y.mean())))
    for _ in range(5):
        prob = 1 / (1 + np.exp(-margin))
        margin += plain_tree(x, prob - y, prob * (1 - prob), 3, p)
    assert np.allclose(model.margin(x), margin) and np.isclose(sum(model.importances), 1)


def test_boosting_options(spark):
    random = np.random.default_rng(6)
    x = random.normal(size=(4000, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.7 * random.normal(size=4000) > 1.2).astype(float)
    leafy = boosting.fit_arrays(x, y, list("abcde"), boosting.Params(trees=20, max_depth=0, max_leaves=7, min_rows=50, l2=0.0, min_weight=1e-3))
    assert all(sum(f < 0 for f in t["feature"]) <= 7 for t in leafy.trees)
    early = boosting.fit_arrays(x[:3000], y[:3000], list("abcde"), boosting.Params(trees=400, rate=0.3, stop_after=10), x[3000:], y[3000:])
    scores = [boosting.average_precision(y[3000:], boosting.BoostedTrees(early.columns, early.base, early.trees[:k]).margin(x[3000:])) for k in range(len(early.trees) + 1)]
    assert 0 < len(early.trees) < 300 and scores[-1] == max(scores)
    df = spark.createDataFrame([(*map(float, r), int(k), i) for i, (r, k) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, e double, y int, i long")
    one, two = (boosting.Boosting(boosting.Params(trees=5)).fit(df.repartition(n), list("abcde"), "y") for n in (2, 5))
    assert one == two and boosting.BoostedTrees.from_json(one.to_json()) == one
    got = [r["probability"] for r in one.transform(df).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-one.margin(x))))
    with pytest.raises(TypeError):
        boosting.BoostedTrees.from_json("[]")
    assert boosting.fit_arrays(x[:0], y[:0], ["a"], boosting.Params()).trees == []


@pytest.mark.parametrize("given", [{"trees": 3, "max_depth": 3}, {"trees": 6, "max_depth": 0, "max_leaves": 9, "min_rows": 20, "l2": 0.0, "min_weight": 1e-3, "stop_after": 3, "rate": 0.5}])
def test_boosting_over_tasks_equals_one_block(spark, monkeypatch, given):
    """Sums of many tasks give the trees of one block, with sampled rows and columns, gaps, unlabelled and validation rows."""
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    random = np.random.default_rng(8)
    x = np.column_stack([random.normal(size=(3000, 3)), random.integers(0, 5, 3000)])
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + x[:, 3] + 0.7 * random.normal(size=3000) > 2.5).astype(float)
    rows = [(*map(float, r), None if i % 50 == 0 else int(k), i % 4 == 0) for i, (r, k) in enumerate(zip(x, y, strict=True))]
    rows += [(None, float("nan"), 1.0, 2.0, 1, False)] * 3 + rows[:200]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int, held boolean").repartition(5)
    p = boosting.Params(**given)
    one, many = (boosting.Boosting(p, block).fit(df, list("abcd"), "y", "held") for block in (boosting.BLOCK, 0))
    assert one == many and one.trees and sum(t["cover"][0] for t in one.trees[:1]) > 0
    assert len(one.trees) <= given["trees"] and ("max_leaves" not in given or max(sum(f < 0 for f in t["feature"]) for t in one.trees) <= 9)
    none = boosting.Boosting(p, 0).fit(df.where("y = 1"), list("abcd"), "y")
    assert none.trees == [] and none.columns == list("abcd")
    assert boosting.Boosting(p).fit(df.limit(0), list("abcd"), "y").trees == []


def test_cuts_come_from_all_rows(spark):
    """Few values are told apart however rare; many are cut at quantiles of all rows."""
    df = spark.range(20_000).select((F.col("id") % 10_000 == 7).cast("double").alias("x0"), F.col("id").cast("double").alias("x1"), F.lit(float("nan")).alias("x2"), F.when(F.col("id") % 3 == 0, 1.0).alias("x3")).repartition(6)
    rare, many, none, gaps = boosting.cuts_of(df, ["x0", "x1", "x2", "x3"])
    assert rare.tolist() == [0.5] and len(none) == 0 and len(gaps) == 0
    assert len(many) == boosting.BINS - 1 and np.abs(many - np.linspace(0, 19_999, boosting.BINS)[:-1] - 159).max() < 10


def test_average_precision():
    y, s = np.array([0, 1, 0, 1, 1, 0, 0, 1]), np.array([0.1, 0.9, 0.6, 0.8, 0.35, 0.35, 0.2, 0.6])
    assert np.isclose(boosting.average_precision(y, s), 0.8541666)


def test_course_learns_nothing_from_test_rows(spark):
    """Values of test rows that would move medians, if they counted, leave the model and its figures as they are."""
    random = np.random.default_rng(9)
    rows = [(i, None if i % 7 == 0 else float(a), float(b), int(a + b > 1.2)) for i, (a, b) in enumerate(random.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    split = {r["id"]: r["split"] for r in prepare.stratified_split(df, "y", "id").collect()}
    odd = spark.createDataFrame([(i, 1e6 if split[i] == "test" and a is not None else a, b, y) for i, a, b, y in rows], df.schema)
    one, two = (models.train(x, ["a", "b"], "y", "id", "xgboost", trees=5, fill=True) for x in (df, odd))
    assert one.predictor.model == two.predictor.model and one.validation == two.validation


def test_course_and_export(spark, tmp_path):
    random = np.random.default_rng(7)
    rows = [(i, *map(float, random.normal(size=3) * [1, 100, 1])) for i in range(1500)]
    df = spark.createDataFrame([(*r, int(r[1] + r[2] / 100 + 0.3 * r[3] > 1.3)) for r in rows], "id long, a double, b double, c double, y int")
    for name, options in (("logreg", {}), ("lightgbm", {"trees": 40})):
        folder = f"file://{tmp_path}/{name}"
        done = models.train(df, ["a", "b", "c"], "y", "id", name, scale=["b"], target_fpr=0.05, folder=folder, **options)
        assert done.test["roc_auc"] > 0.9 and done.validation["fp"] <= 0.05 * (done.validation["fp"] + done.validation["tn"]) and done.test["threshold"] == done.predictor.threshold
        assert writers.missing_exports(spark, folder) == []
        scaler = json.loads(writers.read_text(spark, f"{folder}/scaler.json"))
        back = models.Predictor.load(spark, f"{folder}/model", ["a", "b", "c"], done.predictor.threshold, scaler)
        assert back.predict(df).columns == [*df.columns, "fraud_probability", "prediction"]
        assert back.predict(df).exceptAll(done.predictor.predict(df)).count() == 0 and back.predict(df).select(df.columns).exceptAll(df).count() == 0
    with pytest.raises(FileNotFoundError):
        models.load(spark, f"file://{tmp_path}/none")
    with pytest.raises(TypeError):
        models.load(spark, f"file://{tmp_path}")
    with pytest.raises(TypeError):
        models.Predictor("no model", ["a"])


def test_engine(spark, tmp_path):
    from riskweft.plans.risk import features

    frame = features(spark, SF).cache()
    engine = FusionEngine(boosted_params={"trees": 5}, forest_params={"trees": 10}).fit(frame)
    out = engine.predict(frame)
    assert out.count() == frame.count() and out.where("xgb_score IS NULL OR anomaly_score NOT BETWEEN 0 AND 1").count() == 0
    engine.save(spark, f"file://{tmp_path}/engine")
    again = FusionEngine.load(spark, f"file://{tmp_path}/engine").predict(frame)
    assert again.select("txn_id", "risk_score", "decision").exceptAll(out.select("txn_id", "risk_score", "decision")).count() == 0
    given = FusionEngine(model=engine.model, forest=engine.forest, levels={"red": 0.2, "yellow": 0.1}).fit(frame)
    assert given.model is engine.model and given.predict(frame).where("risk_level = 'RED'").count() >= out.where("risk_level = 'RED'").count()
    with pytest.raises(RuntimeError):
        FusionEngine().predict(frame)


def test_collisions(spark):
    """Greedy, row by row: each takes the first free second around its own."""
    random = np.random.default_rng(9)
    times = {i: (int(random.integers(0, 3)), int(random.integers(0, 40))) for i in range(120)}
    fixed = [(1000 + i, int(random.integers(0, 3)), int(random.integers(0, 40))) for i in range(30)]
    schema, epoch = "id long, a int, s long", 1_700_000_000
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + epoch))
    for offsets in (generator.JITTER, generator.HARD_JITTER):
        used, want = {(a, s) for _, a, s in fixed}, {}
        for i, (a, s) in times.items():
            free = [s + x for x in offsets if (a, s + x) not in used]
            want[i] = free[0] if free else s
            used.add((a, want[i]))
        rows = frame([(i, a, s) for i, (a, s) in times.items()])
        out = generator.spread_collisions(rows, ("a",), "ts", "id", frame(fixed), offsets)
        assert out.columns == rows.columns
        assert {r["id"]: r["t"] - epoch for r in out.select("id", F.unix_seconds("ts").alias("t")).collect()} == want


def test_attributions_against_subsets():
    """Exact Shapley values by all subsets of a small path."""
    from itertools import combinations
    from math import factorial

    path, x = {0: (-np.inf, 1.0, 0.3), 1: (0.0, np.inf, 0.6), 2: (-1.0, 2.0, 0.5)}, np.array([[0.5, -1.0, 0.0]])
    game = lambda s: np.prod([float(path[f][0] < x[0, f] <= path[f][1]) if f in s else path[f][2] for f in path])
    want = [sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (game({*s, i}) - game(set(s))) for k in range(3) for s in combinations([f for f in path if f != i], k)) for i in path]
    assert np.allclose(attribution.shapley(x, [(1.0, path)])[0][0], want)


def test_stream_over_several_batches(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{i:02d}:00", 1.0 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "txn_id long, account_id long, t string, amount double").withColumn("ts", F.to_timestamp("t")).drop("t")
    for k in range(5):
        df.where(F.floor(F.col("txn_id") / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["txn_id"]: (r["vel_count"], r["vel_amount"]) for r in drain(spark, velocity.velocity(stream, 600), "t").collect()}
    for i, k, _, _ in rows:
        near = [a for j, q, _, a in rows if q == k and i - 10 < j < i]
        assert got[i] == (len(near), sum(near))


def put(spark, tmp_path, name, rows, schema="txn_id long, account_id long, t string, amount double"):
    """One more file of a stream."""
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def run_stream(spark, df, tmp_path, name):
    """What a stream gives from here on, from its checkpoint."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}/out")


def test_velocity_restarts_and_expires(spark, tmp_path):
    """A restart goes on from the checkpoint, a late row within the lateness finds its neighbours, one behind the watermark
    is left out, and buckets that nothing can look back on any more are gone."""
    schema = "txn_id long, account_id long, amount double, ts timestamp"
    started = lambda: velocity.velocity(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 600)
    held = lambda: {(r["key"]["account_id"], r["user_map_key"]["bucket"]) for r in spark.read.format("statestore").option("path", f"{tmp_path}/v/state").option("stateVarName", "buckets").load().selectExpr("key", "user_map_key").distinct().collect()}
    put(spark, tmp_path, "in", [(1, 1, "2024-01-01 00:00:00", 1.0), (2, 1, "2024-01-01 00:05:00", 2.0), (3, 2, "2024-01-01 00:05:00", 4.0)])
    run_stream(spark, started(), tmp_path, "v")
    first = held()
    assert len(first) == 2
    put(spark, tmp_path, "in", [(4, 1, "2024-01-01 00:09:00", 8.0)])
    put(spark, tmp_path, "in", [(5, 1, "2024-01-01 00:04:00", 16.0)])  # late, not behind the watermark
    got = {r["txn_id"]: (r["vel_count"], r["vel_amount"]) for r in run_stream(spark, started(), tmp_path, "v").collect()}
    assert got == {1: (0, 0.0), 2: (1, 1.0), 3: (0, 0.0), 4: (2, 3.0), 5: (1, 1.0)}
    put(spark, tmp_path, "in", [(6, 1, "2024-01-01 05:00:00", 1.0)])
    run_stream(spark, started(), tmp_path, "v")
    put(spark, tmp_path, "in", [(7, 1, "2024-01-01 00:06:00", 1.0), (8, 1, "2024-01-01 05:01:00", 1.0)])  # the first is behind the watermark
    got = {r["txn_id"]: (r["vel_count"], r["vel_amount"]) for r in run_stream(spark, started(), tmp_path, "v").collect()}
    assert len(got) == 7 and got[6] == (0, 0.0) and got[8] == (1, 1.0)
    assert len(held()) == 1 and not held() & first  # account 2 and the old buckets of account 1


def test_streams_joined_within(spark, tmp_path):
    """Pairs come whichever side comes first, also late ones; a row behind the watermark makes none."""
    schema = "txn_id long, account_id long, amount double, ts timestamp"
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def started():
        pay = read("pay").select("account_id", F.col("txn_id").alias("pay_id"), F.col("ts").alias("pay_ts"))
        login = read("login").select("account_id", F.col("txn_id").alias("login_id"), F.col("ts").alias("login_ts"))
        return velocity.joined_within(pay, login, ["account_id"], "pay_ts", "login_ts", 600, 60).select("pay_id", "login_id")

    put(spark, tmp_path, "pay", [(1, 1, "2024-01-01 00:10:00", 1.0), (2, 2, "2024-01-01 00:10:00", 1.0)])
    put(spark, tmp_path, "login", [(11, 1, "2024-01-01 00:00:00", 1.0), (12, 1, "2024-01-01 00:11:00", 1.0), (13, 1, "2024-01-01 00:12:00", 1.0), (14, 3, "2024-01-01 00:10:00", 1.0)])
    pairs = lambda: sorted(tuple(r) for r in run_stream(spark, started(), tmp_path, "j").collect())
    assert pairs() == [(1, 11), (1, 12)]
    put(spark, tmp_path, "login", [(15, 2, "2024-01-01 00:05:00", 1.0)])  # late, within the lateness
    put(spark, tmp_path, "pay", [(3, 1, "2024-01-01 00:12:30", 1.0)])
    assert pairs() == [(1, 11), (1, 12), (2, 15), (3, 12), (3, 13)]
    put(spark, tmp_path, "pay", [(4, 9, "2024-01-01 09:00:00", 1.0)])
    put(spark, tmp_path, "login", [(16, 9, "2024-01-01 09:00:00", 1.0)])
    pairs()
    put(spark, tmp_path, "login", [(17, 1, "2024-01-01 00:10:00", 1.0)])  # behind both watermarks
    assert pairs() == [(1, 11), (1, 12), (2, 15), (3, 12), (3, 13), (4, 16)]
