"""Scalar functions, text, JSON, instruction examples and their evaluation, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.functions import text
from riskweft.operators import instruct
from riskweft.plans.risk import scored_with_text
from riskweft.plans.sql import FEATURES, RISK, fixed, sql
from riskweft.scratch import scratch_path
from riskweft.sources import readers, writers
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import table


def _scalars(s, d):
    t = env(s, d)["transactions"]
    a = F.col("amount")
    return t.select("txn_id", F.round(F.log1p(a), 6).alias("log1p"), F.round(F.expm1(a / 10000), 6).alias("expm1"), F.round(F.sqrt(a), 6).alias("sqrt"), F.round(S.sigmoid(a / 1000), 6).alias("sigmoid"), F.greatest(a, F.lit(100.0)).alias("most"), F.round(S.safe_div(a, F.col("txn_id") % 5), 6).alias("ratio"), F.round(S.haversine_km(F.lit(0.0), F.lit(0.0), a / 100, a / 50), 4).alias("km"))


def _times(s, d):
    t = env(s, d)["transactions"]
    return t.select("txn_id", S.hour_of_day("ts").alias("hour"), S.day_of_week("ts").alias("weekday"), S.off_hours(F.hour("ts")).alias("off"), *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for n, c in (("day", F.date_trunc("day", "ts")), ("hour_start", F.date_trunc("hour", "ts")), ("later", F.col("ts") + F.expr("INTERVAL 90 MINUTES")))])


def _strings(s, d):
    return table(s, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.initcap("p_type").alias("title"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.split("p_type", " ")[0].alias("first"), F.col("p_name").startswith("a").cast("int").alias("a"), F.array_join(F.split("p_type", " "), "_").alias("joined"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"))


def _orders_json(s, d):
    o = table(s, d, "orders")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))
    kinds = F.when(F.col("o_orderkey") % 4 == 0, body).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("answer "), F.regexp_replace(body, r"\}$", ",}"), F.lit(" end"))).otherwise("no json")
    return o.select("o_orderkey", kinds.alias("text")).select("o_orderkey", F.coalesce(F.get_json_object(text.lenient_json(F.col("text")), "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object(text.lenient_json(F.col("text")), "$.s"), F.lit("")).alias("s"))


def _casts(s, d):
    e = table(s, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    return e.select("event_id", F.coalesce(raw.try_cast("long"), F.lit(0)).alias("n"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _chat(max_len):
    def run(s, d):
        c = table(s, d, "conversations")
        m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))  # the turns of one conversation
        return m.select("conv_id", text.record_text({"messages": F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))}, max_len).alias("text"))

    return run


def _prompt(s, d):
    return table(s, d, "events").select("event_id", text.prompt(F.col("props")).alias("prompt"))


def _examples(s, d):
    x = instruct.build_examples(scored_with_text(s, d))
    i, o = (lambda k: F.get_json_object("input", f"$.{k}")), (lambda k: F.get_json_object("output", f"$.{k}"))
    return x.select("txn_id", i("transaction_amount").cast("double").alias("amount"), i("recent_count").cast("long").alias("recent"), i("new_device").alias("new_device"), i("triggered_rules").alias("rules"), i("graph_signals.shared_device_accounts").cast("long").alias("shared"), o("risk_level").alias("risk_level"), o("fraud_type").alias("fraud_type"), o("recommended_action").alias("action"), F.regexp_replace(o("summary"), r" vs avg \$[0-9.]+", "").alias("summary"))


def _rules(s, d):
    return scored_with_text(s, d).select("txn_id", F.array_join(text.rules_of_evidence(F.col("evidence")), ",").alias("rules"))


def records(s, d):
    """JSON records under varying key names, from orders."""
    o = table(s, d, "orders")
    k, amount = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    given = F.to_json(F.struct(amount.alias("transaction_amount"), (amount / 4 + k % 7 * 20000).cast("long").alias("historical_average"), (k % 5 == 0).alias("new_device"), (k % 9).alias("vel_count_300s"), F.struct((k % 4).alias("shared_device_accounts")).alias("graph_signals"), (k % 100 / 100.0).alias("xgboost_score"), (k % 400).alias("distance_km")))
    want = F.to_json(F.struct(F.element_at(F.array(F.lit("HIGH"), F.lit("medium"), F.lit("LOW")), (k % 3 + 1).cast("int")).alias("risk_level"), F.when(k % 2 == 0, "VELOCITY_ABUSE").alias("fraud_type")))
    named = lambda a, b: F.concat(F.lit('{"' + a + '":'), given, F.lit(',"' + b + '":'), want, F.lit("}"))
    return o.select("o_orderkey", F.when(k % 3 == 0, named("input", "output")).when(k % 3 == 1, named("prompt", "expected")).otherwise(named("evidence", "label")).alias("record"))


def answered(s, d):
    return instruct.resolve(records(s, d)).withColumn("answer", instruct.mock_answer(F.col("input")))


def _accuracy(s, d):
    a = instruct.accuracy(answered(s, d))
    return a.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])


def _compare(s, d):
    base = answered(s, d)
    both = base.withColumn("tuned", F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.upper(F.get_json_object("expected", "$.risk_level")).alias("risk_level"), F.coalesce(F.get_json_object("expected", "$.fraud_type"), F.lit("LEGITIMATE")).alias("fraud_type"))).otherwise(F.col("answer")))
    c = instruct.compare_answers(both, "answer", "tuned")
    return c.select("metric", F.round("base", 9).alias("base"), F.round("tuned", 9).alias("tuned"), F.round("delta", 9).alias("delta"))


def _roundtrip(fmt):
    def run(s, d):
        tx = env(s, d)["transactions"].select("txn_id", "amount", "channel", F.when(F.col("txn_id") % 10 < 8, "train").when(F.col("txn_id") % 10 == 8, "val").otherwise("test").alias("split"))
        folder = scratch_path(s, f"splits-{fmt}")
        if fmt == "json":
            writers.save_dataset(tx.withColumn("_hidden", F.lit(1)), folder)
            return readers.read_examples(s, folder, tx.schema).select("txn_id", "amount", "channel", "split")
        writers.save_splits(tx, folder, fmt)
        schema = "txn_id long, amount double, channel string"
        parts = [(s.read.schema(schema).option("header", True).csv(f"{folder}/{n}") if fmt == "csv" else s.read.schema(schema).parquet(f"{folder}/{n}")).withColumn("split", F.lit(n)) for n in ("train", "val", "test")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return run


def _environment(s, d):
    folder = scratch_path(s, "environment")
    writers.save_environment(env(s, d), folder)
    back = readers.read_environment(s, folder)
    out = None
    for name in sorted(back):
        one = back[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


ROUNDTRIP = sql("SELECT txn_id, amount, channel, CASE WHEN txn_id % 10 < 8 THEN 'train' WHEN txn_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM tx")
EXTRACTED = """,
ru AS (SELECT txn_id, list_sort(list_distinct(list_filter(list_transform(evidence, lambda e: CASE WHEN starts_with(e, 'rule:') THEN upper(substr(e, 6)) WHEN starts_with(e, 'high_velocity') THEN 'HIGH_VELOCITY' WHEN starts_with(e, 'burst_velocity') THEN 'BURST_VELOCITY'
  WHEN starts_with(e, 'shared_device') THEN 'SHARED_DEVICE' WHEN starts_with(e, 'new_device') THEN 'NEW_DEVICE' WHEN starts_with(e, 'unusual_location') THEN 'UNUSUAL_LOCATION' WHEN starts_with(e, 'country_switch') THEN 'COUNTRY_SWITCH' WHEN starts_with(e, 'unusual_amount') THEN 'UNUSUAL_AMOUNT'
  WHEN starts_with(e, 'offhours') THEN 'OFFHOURS_HIGH_VALUE' WHEN starts_with(e, 'graph_risk') THEN 'GRAPH_RISK' WHEN starts_with(e, 'ml_flagged') THEN 'ML_FLAGGED' WHEN starts_with(e, 'anomalous') THEN 'ANOMALOUS_PATTERN' WHEN starts_with(e, 'elevated_risk') THEN 'ELEVATED_RISK' WHEN starts_with(e, 'new_user') THEN 'NEW_USER' END), lambda x: x IS NOT NULL))) AS rules FROM ev)"""
MOCK = """WITH q AS (
  SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS amount, trunc(floor(o_totalprice) / 4::DOUBLE + o_orderkey % 7 * 20000)::BIGINT AS mean, o_orderkey % 9 AS vel, o_orderkey % 4 AS shared, (o_orderkey % 100) / 100.0::DOUBLE AS xgb, o_orderkey % 400 AS dist,
    ['HIGH', 'MEDIUM', 'LOW'][o_orderkey % 3 + 1] AS want_risk, CASE WHEN o_orderkey % 2 = 0 THEN 'VELOCITY_ABUSE' ELSE '' END AS want_type FROM orders),
a AS (SELECT *, CASE WHEN shared >= 3 THEN ['HIGH', 'DEVICE_COMPROMISE'] WHEN k % 5 = 0 AND amount > 1000 THEN ['HIGH', 'ACCOUNT_TAKEOVER'] WHEN mean > 0 AND amount > 3 * mean THEN ['HIGH', 'UNUSUAL_AMOUNT'] WHEN vel >= 5 THEN ['HIGH', 'VELOCITY_ABUSE'] WHEN xgb > 0.7 THEN ['HIGH', 'ACCOUNT_TAKEOVER']
  WHEN dist > 300 THEN ['MEDIUM', 'UNUSUAL_LOCATION'] WHEN vel >= 2 OR xgb > 0.4 THEN ['MEDIUM', 'VELOCITY_ABUSE'] WHEN mean > 0 AND amount > 1.5 * mean THEN ['MEDIUM', 'UNUSUAL_AMOUNT'] ELSE ['LOW', 'LEGITIMATE'] END AS ans FROM q),
b AS (SELECT *, ans[1] AS risk, ans[2] AS kind FROM a),
t AS (SELECT *, CASE WHEN k % 2 = 0 THEN want_risk ELSE risk END AS risk2, CASE WHEN k % 2 = 0 THEN 'VELOCITY_ABUSE' ELSE kind END AS kind2 FROM b)
"""
_rate = lambda c: f"round(avg(({c})::INTEGER), 9)"

QUERIES = {
    "scalar_math": (
        _scalars,
        sql("""SELECT txn_id, round(ln(1 + amount), 6) AS log1p, round(exp(amount / 10000) - 1, 6) AS expm1, round(sqrt(amount), 6) AS sqrt, round(1 / (1 + exp(-amount / 1000)), 6) AS sigmoid, greatest(amount, 100) AS most, round(coalesce(amount / nullif(txn_id % 5, 0), 0), 6) AS ratio,
            round(2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(pow(sin(radians(amount / 100) / 2), 2) + cos(radians(amount / 100)) * pow(sin(radians(amount / 50) / 2), 2), 0), 1))), 4) AS km FROM tx"""),
    ),
    "time_parts": (_times, sql("SELECT txn_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS weekday, (hour(ts) >= 2 AND hour(ts) < 5)::INTEGER AS off, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later FROM tx")),
    "string_functions": (
        _strings,
        """SELECT p_partkey, upper(p_name) AS up, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, replace(p_brand, '#', '-') AS brand, string_split(p_type, ' ')[1] AS first, starts_with(p_name, 'a')::INTEGER AS a,
        array_to_string(string_split(p_type, ' '), '_') AS joined, trim('  ' || p_brand || ' ') AS trimmed FROM part""",
    ),
    "node_ids_and_hashes": (
        lambda s, d: table(s, d, "customer").select("c_custkey", S.node_id("user", "c_custkey").alias("node"), F.substring(F.sha2("c_name", 256), 1, 16).alias("fingerprint"), F.md5("c_name").alias("digest")),
        "SELECT c_custkey, 'user:' || c_custkey AS node, substr(sha256(c_name), 1, 16) AS fingerprint, md5(c_name) AS digest FROM customer",
    ),
    "lenient_json": (_orders_json, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey ELSE -1 END AS k, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderstatus ELSE '' END AS s FROM orders"),
    "safe_casts": (_casts, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END AS n, (props::JSON->>'k')::BIGINT AS k FROM events"),
    "enum_map": (
        lambda s, d: env(s, d)["transactions"].select("txn_id", S.mapped("channel", {"online": "REMOTE", "mobile": "REMOTE", "atm": "CASH"}, F.lit("STORE")).alias("kind"), instruct.fraud_type(F.col("scenario_tag")).alias("fraud_type")),
        sql("SELECT txn_id, CASE channel WHEN 'online' THEN 'REMOTE' WHEN 'mobile' THEN 'REMOTE' WHEN 'atm' THEN 'CASH' ELSE 'STORE' END AS kind, upper(scenario_tag) AS fraud_type FROM tx"),
    ),
    "chat_to_text": (_chat(None), "SELECT conv_id, string_agg(coalesce(role, 'user') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"),
    "chat_to_whole_text": (_chat(None), "SELECT conv_id, string_agg(coalesce(role, 'user') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"),
    "prompt_template": (_prompt, "SELECT event_id, '" + text.PROMPT[0] + "' || props || '" + text.PROMPT[1] + "' AS prompt FROM events"),
    "latest_checkpoint": (
        lambda s, d: table(s, d, "orders").select(F.col("o_custkey"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "checkpoint-").otherwise("other-"), F.col("o_orderkey").cast("string")).alias("name")).groupBy("o_custkey").agg(F.coalesce(F.max(text.checkpoint_step(F.col("name"))), F.lit(-1)).alias("step")),
        "SELECT o_custkey, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), -1) AS step FROM orders GROUP BY o_custkey",
    ),
    "rule_extract": (_rules, sql("SELECT txn_id, array_to_string(rules, ',') AS rules FROM ru", FEATURES, RISK, EXTRACTED)),
    "llm_example_json": (
        _examples,
        sql("""SELECT txn_id, round(amount, 2) AS amount, vel_count_300s::BIGINT AS recent, CASE WHEN is_new_device = 1 THEN 'true' ELSE 'false' END AS new_device, '[' || array_to_string(list_transform(rules, lambda x: '"' || x || '"'), ',') || ']' AS rules, device_account_count::BIGINT AS shared,
            risk_level, upper(scenario_tag) AS fraud_type, CASE decision WHEN 'APPROVE' THEN 'Approve transaction – no further action required.' WHEN 'STEP_UP' THEN 'Require step-up authentication (OTP/biometric).' WHEN 'INVESTIGATE' THEN 'Flag for manual investigation.' ELSE 'Block transaction and freeze account pending review.' END AS action,
            array_to_string(list_transform(string_split(lower(replace(scenario_tag, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' suspected: amount $' || """ + fixed("amount", 2) + """ || ', new_device=' || CASE WHEN is_new_device = 1 THEN 'True' ELSE 'False' END
            || ', distance ' || """ + fixed("round(distance_to_prev_km, 1)", 0) + """ || 'km, recent_count ' || vel_count_300s || ', xgb ' || """ + fixed("xgb_score", 2) + """ || ' anomaly ' || """ + fixed("anomaly_score", 2) + """ || '. Evidence: ' || array_to_string((CASE WHEN len(texts) > 0 THEN texts ELSE evidence END)[1:3], '; ') || '. Risk ' || risk_level || '.' AS summary
            FROM ev JOIN ru USING (txn_id) JOIN tx_text USING (txn_id)""", FEATURES, RISK, EXTRACTED),
    ),
    "key_resolution": (
        lambda s, d: instruct.resolve(records(s, d)).select("o_orderkey", F.get_json_object("input", "$.vel_count_300s").cast("long").alias("vel"), F.get_json_object("expected", "$.risk_level").alias("risk")),
        "SELECT o_orderkey, o_orderkey % 9 AS vel, ['HIGH', 'medium', 'LOW'][o_orderkey % 3 + 1] AS risk FROM orders",
    ),
    "mock_classifier": (lambda s, d: answered(s, d).select("o_orderkey", "answer.risk_level", "answer.fraud_type"), MOCK + "SELECT k AS o_orderkey, risk AS risk_level, kind AS fraud_type FROM b"),
    "eval_accuracy": (
        _accuracy,
        MOCK + f"SELECT count(*) AS n_total, count(*) AS n_valid, 1.0::DOUBLE AS json_valid_rate, {_rate('risk = want_risk')} AS risk_level_accuracy, {_rate(chr(40) + 'want_type = ' + chr(39) * 2 + ' OR kind = want_type)')} AS fraud_type_accuracy, {_rate('risk = want_risk AND kind = want_type')} AS exact_match_rate FROM b",
    ),
    "compare_delta": (
        _compare,
        MOCK + " UNION ALL ".join(f"SELECT '{n}' AS metric, {_rate(a)} AS base, {_rate(b)} AS tuned, round(avg(({b})::INTEGER) - avg(({a})::INTEGER), 9) AS delta FROM t" for n, a, b in (
            ("json_valid_rate", "true", "true"), ("risk_level_accuracy", "risk = want_risk", "risk2 = want_risk"), ("fraud_type_accuracy", "want_type = '' OR kind = want_type", "want_type = '' OR kind2 = want_type"), ("exact_match_rate", "risk = want_risk AND kind = want_type", "risk2 = want_risk AND kind2 = want_type"))),
    ),
    "jsonl_roundtrip": (_roundtrip("json"), ROUNDTRIP),
    "csv_roundtrip": (_roundtrip("csv"), ROUNDTRIP),
    "parquet_roundtrip": (_roundtrip("parquet"), ROUNDTRIP),
    "environment_roundtrip": (
        _environment,
        sql("""SELECT 'accounts' AS name, count(*) AS n FROM owner UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'merchants', count(*) FROM merchants UNION ALL SELECT 'locations', count(*) FROM locations
            UNION ALL SELECT 'transactions', count(*) FROM tx UNION ALL SELECT 'account_devices', count(*) FROM links UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM links"""),
    ),
}
