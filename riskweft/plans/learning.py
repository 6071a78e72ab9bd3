"""Models, attributions, the generator and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riskweft.ml import attribution, iforest, models
from riskweft.ml.engine import FusionEngine
from riskweft.operators import features as X
from riskweft.operators import instruct, prepare
from riskweft.plans.risk import features, scored_with_text
from riskweft.plans.sql import FEATURES, sql
from riskweft.plans.textual import MOCK
from riskweft.scratch import kept, scratch_path
from riskweft.sources import generator, writers
from riskweft.sources.adapters import environment as env
from riskweft.streaming import velocity

COLUMNS = X.feature_columns()


def training(s, d):
    """(txn_id, label_fraud, split, features) without gaps: medians of the training rows stand in. Written once."""
    df = features(s, d).select("txn_id", "label_fraud", *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    split = kept(prepare.stratified_split(kept(df, "features"), "label_fraud", "txn_id"), "split")
    return prepare.impute(split, prepare.medians(split.where("split = 'train'"), COLUMNS))


def scaled(df):
    """The frame scaled by its training rows."""
    scaler = prepare.Scaler(COLUMNS).fit(df.where("split = 'train'"))
    return scaler, scaler.transform(df)


def _proba(name):
    def run(s, d):
        df = training(s, d)
        ready = scaled(df)[1] if name == "logreg" else df
        model = models.fit(ready.where("split <> 'test'").withColumn("held", F.col("split") == "val"), COLUMNS, "label_fraud", name, "held")
        return models.predict_proba(model, ready).select("txn_id", "label_fraud", "split", F.round("probability", 6).alias("probability"))

    return run


def _iforest(s, d):
    df = training(s, d)
    forest = iforest.IsolationForest(COLUMNS).fit(df.where("label_fraud = 0 AND split = 'train'"), "txn_id")
    return forest.transform(df).select("txn_id", "label_fraud", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


def _treeshap(s, d):
    df = training(s, d)
    model = models.fit(df.where("split = 'train'"), COLUMNS, "label_fraud", "fusion_gb")
    out = attribution.attribute(df, model, COLUMNS)
    return out.select("txn_id", *[F.round(F.get("attributions", i), 6).alias(c) for i, c in enumerate(COLUMNS)])


def _predictor(s, d):
    df = training(s, d)
    scaler, ready = scaled(df)
    p = models.Predictor(models.fit(ready.where("split = 'train'"), COLUMNS, "label_fraud", "logreg"), COLUMNS, 0.1, scaler)
    return p.predict(df).select("txn_id", F.round("fraud_probability", 6).alias("fraud_probability"), "prediction")


def _exported(s, d):
    """The probability of a model before and after its export: equal for every row."""
    df = training(s, d)
    folder = f"{scratch_path(s, 'export')}/out"
    model = models.fit(df.where("split = 'train'"), COLUMNS, "label_fraud", "fusion_gb")
    missing = writers.export_all(s, folder, model, {}, 0.5, COLUMNS, {"rows": 1})
    back = models.Predictor.load(s, f"{folder}/model", COLUMNS, json.loads(writers.read_text(s, f"{folder}/threshold.json"))["threshold"])
    both = back.predict(models.predict_proba(model, df, "before"))
    return both.select("txn_id", F.abs(F.col("fraud_probability") - F.col("before")).alias("difference"), F.lit(len(missing)).alias("missing_parts"))


def _course(s, d):
    """The whole course of training on the features, in one row of test figures."""
    df = features(s, d).select("txn_id", "label_fraud", *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    done = models.train(df, COLUMNS, "label_fraud", "txn_id", "lightgbm", scale=["amount_log"], fill=True, folder=f"{scratch_path(s, 'course')}/out")
    return s.createDataFrame([(done.predictor.threshold, *[float(done.test[c]) for c in ("roc_auc", "average_precision", "precision", "recall", "f1")])], "threshold double, roc_auc double, average_precision double, precision double, recall double, f1 double")


def _proxy(s, d):
    weights = [0.5, 0.3, 0.2]
    out = attribution.importance_proxy(features(s, d), weights, ["amount", "prior_tx_count", "is_new_device"])
    return out.select("txn_id", *[F.round(F.get("attributions", i), 6).alias(f"a{i}") for i in range(3)])


def _jitter(s, d):
    tx = env(s, d)["transactions"].select("txn_id", "account_id", F.date_trunc("hour", "ts").alias("ts"))
    out = generator.spread_collisions(tx, ("account_id",), "ts", "txn_id")
    return out.select("txn_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _texts(records):
    """Stands in for a language model: fenced, bare and broken answers in turn."""
    body = F.to_json(instruct.mock_answer(F.col("input")))
    k = F.col("o_orderkey")
    return instruct.resolve(records).withColumn("text", F.when(k % 5 == 0, "I can't tell.").when(k % 5 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(k % 5 == 2, F.regexp_replace(body, r"\}$", ",}")).otherwise(body))


def _answers(s, d):
    from riskweft.plans.textual import records

    a = instruct.accuracy(instruct.model_answers(records(s, d), _texts))
    return a.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])


def _fitted_fusion(s, d):
    frame = kept(features(s, d), "features")
    out = FusionEngine().fit(frame).predict(frame)
    return out.select("txn_id", F.round("risk_score", 6).alias("risk_score"), "risk_level", "decision")


def _dataset(s, d):
    return instruct.build_dataset(scored_with_text(s, d), 50)


def _episodes(s, d):
    """An environment as large as the given one."""
    tx = generator.generate(s, generator.EnvironmentConfig().like(env(s, d)))["transactions"]
    background = F.count(F.when(F.col("scenario_tag") == "background", 1)).alias("payments")
    return tx.groupBy("scenario_tag").agg(F.count_distinct("scenario_extra").alias("episodes"), F.count_distinct(F.when(F.col("label_fraud") == 1, F.col("scenario_extra"))).alias("labelled"), background, F.min("currency").alias("currency"), F.min("status").alias("status"))


def _hard(s, d):
    tx = generator.generate(s, generator.EnvironmentConfig.hard_overlap().like(env(s, d)))["transactions"]
    return tx.groupBy("scenario_tag").agg(F.count("*").alias("n"), F.sum("label_fraud").alias("labelled"))


def _flat(s, d):
    """As many rows as there are line items."""
    return generator.flat_table(s, s.read.parquet(f"{d}/lineitem.parquet").count()).groupBy("Class").agg(F.count("*").alias("n"))


def _scenarios(names, background, each):
    """SQL rows of the background and of each scenario, whose episodes grow with the payments."""
    rows = " UNION ALL ".join(f"SELECT '{k}' AS scenario_tag, {n} * times AS e FROM t" for k, n in names.items())
    return sql(f"SELECT 'background' AS scenario_tag, {background} FROM tx UNION ALL SELECT scenario_tag, {each} FROM ({rows})", f", t AS (SELECT greatest(1, count(*) // {generator.EPISODES_PER}) AS times FROM tx)")


def stream(s, d, *more):
    """Events as a stream of files, with more of their columns."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    at = d.rstrip("/").rsplit("/", 1)
    raw = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{at[0]}/{at[1]}/events.parquet*")
    return raw.select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"), *more)


def drain(s, df, label, mode="append"):
    """Runs a stream over all that there is, into Parquet, and reads it back."""
    folder = scratch_path(s, label)
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(df.schema).parquet(f"{folder}/out")


def drain_totals(s, df, label):
    """Runs an aggregation of a stream over all that there is and gives its state after the last batch, so open windows count too."""
    folder = scratch_path(s, label)

    def put(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/out")  # complete mode: each batch has all windows

    query = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(df.schema).parquet(f"{folder}/out")


def _stream_velocity(s, d):
    out = drain(s, velocity.velocity(stream(s, d), 3600), "velocity")
    return out.select("txn_id", "vel_count", F.round("vel_amount", 4).alias("vel_amount"))


def _stream_first(s, d):
    return drain(s, velocity.first_seen(stream(s, d)), "first").select("txn_id", "account_id")


def _stream_windows(s, d):
    out = drain_totals(s, velocity.windowed_totals(stream(s, d), "1 day", lateness="0 seconds"), "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "account_id", "n", F.round("total", 4).alias("total"))


def _stream_sessions(s, d):
    return drain_totals(s, velocity.sessions(stream(s, d), "1 hour"), "sessions").select("account_id", "n", F.round("total", 4).alias("total"))


def _stream_joined(s, d):
    """Purchases with the account's views of the ten hours before."""
    raw = stream(s, d, "event_type")
    bought = raw.where("event_type = 'purchase'").select("account_id", F.col("txn_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    came = stream(s, d, "event_type").where("event_type = 'view'").select("account_id", F.col("txn_id").alias("login_id"), F.col("ts").alias("login_ts"))
    return drain(s, velocity.joined_within(bought, came, ["account_id"], "purchase_ts", "login_ts", 36_000).select("purchase_id", "login_id"), "joined")


VEL = """SELECT x.event_id AS txn_id, count(y.event_id)::INTEGER AS vel_count, round(coalesce(sum(y.value), 0), 4) AS vel_amount FROM events x
LEFT JOIN events y ON x.user_id = y.user_id AND (y.ts < x.ts OR (y.ts = x.ts AND y.event_id < x.event_id)) AND y.ts > x.ts - INTERVAL 3600 SECOND GROUP BY x.event_id"""
SESSIONS = """SELECT account_id, count(*) AS n, round(sum(value), 4) AS total FROM (
    SELECT *, sum(begins) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT event_id, user_id AS account_id, ts, value, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR)::INTEGER, 1) AS begins FROM events))
GROUP BY account_id, k"""

QUERIES = {
    "logreg_scores": (_proba("logreg"), None),
    "gbt_scores": (_proba("xgboost"), None),
    "gbt_early_stop_scores": (_proba("lightgbm"), None),
    "training_course": (_course, None),
    "export_roundtrip": (_exported, sql("SELECT txn_id, 0.0::DOUBLE AS difference, 0 AS missing_parts FROM tx")),
    "iforest_scores": (_iforest, None),
    "treeshap": (_treeshap, None),
    "fitted_fusion": (_fitted_fusion, None),
    "predictor_scores": (_predictor, None),
    "importance_proxy": (
        _proxy,
        sql("SELECT txn_id, " + ", ".join(f"round({w}::DOUBLE * (0.95::DOUBLE + 0.1::DOUBLE * t / (t + 1)), 6) AS a{i}" for i, w in enumerate((0.5, 0.3, 0.2))) + " FROM (SELECT txn_id, amount + prior_tx_count + is_new_device AS t FROM f)", FEATURES),
    ),
    "model_evaluation": (
        _answers,
        MOCK + """SELECT count(*) AS n_total, count(*) FILTER (k % 5 <> 0) AS n_valid, round(avg((k % 5 <> 0)::INTEGER), 9) AS json_valid_rate, round(avg((k % 5 <> 0 AND risk = want_risk)::INTEGER), 9) AS risk_level_accuracy,
            round(avg((want_type = '' OR (k % 5 <> 0 AND kind = want_type))::INTEGER), 9) AS fraud_type_accuracy, round(avg((want_type <> '' AND k % 5 <> 0 AND risk = want_risk AND kind = want_type)::INTEGER), 9) AS exact_match_rate FROM b""",
    ),
    "collision_jitter": (
        _jitter,
        sql("""SELECT unnest(ids) AS txn_id, strftime(make_timestamp(unnest(list_reduce(hs, lambda done, x: list_append(done, coalesce(list_filter([x[1], x[1] + 1, x[1] - 1, x[1] + 2, x[1] - 2], lambda t: NOT list_contains(done, t))[1], x[1])))) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts
            FROM (SELECT account_id, list(txn_id ORDER BY h, txn_id) AS ids, list([epoch(h)::BIGINT] ORDER BY h, txn_id) AS hs FROM (SELECT txn_id, account_id, date_trunc('hour', ts) AS h FROM tx) GROUP BY account_id)"""),
    ),
    "instruction_dataset": (_dataset, None),
    "synthetic_environment": (_episodes, _scenarios(generator.SCENARIOS, "1 AS episodes, 0 AS labelled, count(*) AS payments, 'USD' AS currency, 'settled' AS status", "e, e, 0, 'USD', 'settled'")),
    "synthetic_hard_overlap": (_hard, _scenarios(dict.fromkeys(generator.HARD_SCENARIOS, generator.HARD_EPISODES), "count(*) AS n, 0 AS labelled", "e, e")),
    "synthetic_flat_table": (_flat, "SELECT unnest([0, 1]) AS \"Class\", unnest([n - fraud, fraud]) AS n FROM (SELECT count(*) AS n, greatest(2, floor(count(*) * 0.0172::DOUBLE)::BIGINT) AS fraud FROM lineitem)"),
    "stream_velocity": (_stream_velocity, VEL),
    "stream_first_seen": (_stream_first, "SELECT event_id AS txn_id, user_id AS account_id FROM events"),
    "stream_joined_within": (
        _stream_joined,
        "SELECT x.event_id AS purchase_id, y.event_id AS login_id FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts - INTERVAL 10 HOUR AND x.ts WHERE x.event_type = 'purchase' AND y.event_type = 'view'",
    ),
    "stream_windows": (_stream_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id AS account_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_sessions": (_stream_sessions, SESSIONS),
}
