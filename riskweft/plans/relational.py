"""Sources, projections, joins, aggregations and set operations on the payment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.operators import features as X
from riskweft.operators import graph, prepare, profiles
from riskweft.plans.sql import sql
from riskweft.sources import writers
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import event_transactions as events
from riskweft.sources.adapters import table


def _counts(s, d):
    out = None
    for name, df in sorted(env(s, d).items()):
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def _linked(s, d):
    e = env(s, d)
    return X.with_links(e["transactions"], e["account_devices"])


def _placed(s, d):
    e = env(s, d)
    return X.with_place(X.with_owner(e["transactions"], e["accounts"], e["users"]), e["locations"])


def _owned(s, d):
    e = env(s, d)
    return X.with_owner(e["transactions"], e["accounts"], e["users"])


def _new_devices(s, d):
    e = env(s, d)
    return e["transactions"].join(e["account_devices"], ["account_id", "device_id"], "left_anti").where("device_id IS NOT NULL").select("txn_id", "account_id", "device_id")


def _foreign(s, d):
    e = env(s, d)
    per = e["locations"].groupBy("country").agg(F.count("*").alias("here"))
    total = e["locations"].agg(F.count("*").alias("n"))
    users = e["users"].join(per, F.col("home_country") == F.col("country"), "left")
    return users.join(F.broadcast(total)).select("user_id", (F.col("n") - F.coalesce("here", F.lit(0))).alias("n_foreign"))  # total is one row


def _suspicious(s, d):
    e = env(s, d)
    return graph.suspicious_neighbours(e["account_devices"], e["transactions"])


def _union(s, d):
    tx = env(s, d)["transactions"]
    a, b = tx.where("label_fraud = 0").select("txn_id", "amount"), tx.where("label_fraud = 1").select("txn_id", "amount", "scenario_tag")
    return a.unionByName(b, allowMissingColumns=True).select("txn_id", "amount", "scenario_tag")


def _key_sets(s, d):
    e = env(s, d)
    a, b = e["accounts"].select("account_id"), e["transactions"].select("account_id").distinct()
    one = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return one("minus", a.subtract(b)).unionAll(one("intersect", a.intersect(b))).unionAll(one("union", a.union(b).distinct()))


def _boxplot(s, d):
    b = prepare.boxplot(env(s, d)["transactions"], "amount", "label_fraud")
    return b.select("label_fraud", *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


def _percentiles(s, d):
    names = {"p01": 0.01, "p25": 0.25, "p75": 0.75, "p99": 0.99}
    found = prepare.quantiles(env(s, d)["transactions"], ["amount"], list(names.values()))
    return found.agg(*[F.round(F.max(F.when(F.col("share") == x, F.col("value"))), 6).alias(n) for n, x in names.items()])


def _duplicates(s, d):
    per = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def _scaled(s, d):
    tx = env(s, d)["transactions"]
    params = prepare.Scaler(["amount"]).params_frame(tx)
    return tx.join(F.broadcast(params)).select("txn_id", F.round((F.col("amount") - F.col("mean")) / F.col("std"), 6).alias("scaled"))  # params is one row


def _imputed(s, d):
    tx = env(s, d)["transactions"].withColumn("x", F.when(F.col("txn_id") % 7 == 0, F.lit(None)).when(F.col("txn_id") % 11 == 0, F.lit(float("nan"))).when(F.col("txn_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("amount")))
    return prepare.impute(tx, prepare.medians(tx, ["x"])).select("txn_id", "x")


def _profile(s, d):
    return profiles.amount_stats(events(s, d)).select("user_id", "n_transactions", *[F.round(c, 6).alias(c) for c in ("mean_amount", "median_amount", "std_amount")])


def _graph_nodes(s, d):
    e = graph.node_degrees(env(s, d))
    return e.select("node", F.col("degree").cast("long").alias("degree"))


EDGES = """,
ad AS (SELECT DISTINCT account_id, device_id FROM links),
pairs AS (SELECT a.account_id AS account_a, b.account_id AS account_b, min(a.device_id) AS device_id FROM ad a JOIN ad b ON a.device_id = b.device_id AND a.account_id < b.account_id GROUP BY ALL),
both_ways AS (SELECT account_a AS account_id, account_b AS other FROM pairs UNION ALL SELECT account_b, account_a FROM pairs),
edges AS (SELECT 'user:' || user_id AS src, 'account:' || account_id AS dst, 'owns' AS kind FROM owner
  UNION ALL SELECT 'account:' || account_id, 'device:' || device_id, 'uses' FROM ad
  UNION ALL SELECT DISTINCT 'account:' || account_id, 'merchant:' || merchant_id, 'transacts' FROM tx WHERE merchant_id IS NOT NULL
  UNION ALL SELECT 'account:' || account_a, 'account:' || account_b, 'shares' FROM pairs),
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node),
bad AS (SELECT DISTINCT account_id FROM tx WHERE label_fraud = 1),
sus AS (SELECT account_id, count(*) AS n FROM both_ways WHERE other IN (SELECT account_id FROM bad) GROUP BY account_id)"""

QUERIES = {
    "scan_filter_project": (
        lambda s, d: env(s, d)["transactions"].where((F.col("amount") > 1000) & (F.col("channel") == "online")).select("txn_id", "account_id", "amount"),
        sql("SELECT txn_id, account_id, amount FROM tx WHERE amount > 1000 AND channel = 'online'"),
    ),
    "schema_validate_counts": (
        _counts,
        sql("""SELECT 'accounts' AS name, count(*) AS n FROM owner UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'merchants', count(*) FROM merchants UNION ALL SELECT 'locations', count(*) FROM locations
            UNION ALL SELECT 'transactions', count(*) FROM tx UNION ALL SELECT 'account_devices', count(*) FROM links UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM links"""),
    ),
    "null_drop": (
        lambda s, d: env(s, d)["transactions"].na.drop(subset=["merchant_id", "device_id", "location_id"]).groupBy("channel").agg(F.count("*").alias("n")),
        sql("SELECT channel, count(*) AS n FROM tx WHERE merchant_id IS NOT NULL AND device_id IS NOT NULL AND location_id IS NOT NULL GROUP BY channel"),
    ),
    "dup_count": (_duplicates, "SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"),
    "value_counts": (
        lambda s, d: (lambda t: t.groupBy("channel").agg(F.count("*").alias("n")).join(F.broadcast(t.agg(F.count("*").alias("all"))))  # one row
                      .select("channel", "n", F.round(F.col("n") / F.col("all"), 6).alias("share")))(events(s, d)),
        "SELECT event_type AS channel, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type",
    ),
    "channel_onehot": (
        lambda s, d: env(s, d)["transactions"].select("txn_id", *[c.alias(n) for n, c in S.one_hot("channel", S.CHANNELS).items()]),
        sql("SELECT txn_id, (channel = 'online')::INTEGER AS is_online, (channel = 'pos')::INTEGER AS is_pos, (channel = 'atm')::INTEGER AS is_atm, (channel = 'mobile')::INTEGER AS is_mobile FROM tx"),
    ),
    "risk_band_ordinal": (
        lambda s, d: env(s, d)["merchants"].select("merchant_id", S.ordinal("risk_band").alias("ord")),
        sql("SELECT merchant_id, CASE risk_band WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END::INTEGER AS ord FROM merchants"),
    ),
    "clip_and_between": (
        lambda s, d: env(s, d)["transactions"].select("txn_id", S.clip(F.col("amount") / 1000, 0.0, 1.0).alias("clipped"), F.col("amount").between(500, 1500).cast("int").alias("inside")),
        sql("SELECT txn_id, least(greatest(amount / 1000, 0), 1) AS clipped, (amount BETWEEN 500 AND 1500)::INTEGER AS inside FROM tx"),
    ),
    "conditional_overwrite": (
        lambda s, d: env(s, d)["transactions"].select("txn_id", F.when(F.col("status") == "F", 0.0).otherwise(F.col("amount")).alias("amount")),
        sql("SELECT txn_id, CASE WHEN status = 'F' THEN 0.0 ELSE amount END AS amount FROM tx"),
    ),
    "amount_fallback": (
        lambda s, d: (lambda t: t.select("txn_id", F.round(S.amount_of(t), 6).alias("amount")))(env(s, d)["transactions"].select("txn_id", F.when(F.col("txn_id") % 2 == 0, F.col("amount")).alias("amount_x"), F.when(F.col("txn_id") % 3 != 0, F.log1p("amount")).alias("amount_log"))),
        sql("SELECT txn_id, round(coalesce(CASE WHEN txn_id % 2 = 0 THEN amount END, CASE WHEN txn_id % 3 <> 0 THEN exp(ln(1 + amount)) - 1 END, 0), 6) AS amount FROM tx"),
    ),
    "dim_left_join": (
        lambda s, d: X.with_merchant(env(s, d)["transactions"], env(s, d)["merchants"]).select("txn_id", "risk_band", S.flag(F.col("risk_band") == "high").alias("is_high_risk_merchant")),
        sql("SELECT txn_id, risk_band, coalesce(risk_band = 'high', false)::INTEGER AS is_high_risk_merchant FROM tx LEFT JOIN merchants USING (merchant_id)"),
    ),
    "lookup_chain_join": (
        lambda s, d: _placed(s, d).select("txn_id", "user_id", "home_country", "tx_country", "lat", "lon"),
        sql("SELECT txn_id, user_id, home_country, l.country AS tx_country, lat, lon FROM tx LEFT JOIN owner USING (account_id) LEFT JOIN users USING (user_id) LEFT JOIN locations l USING (location_id)"),
    ),
    "account_user_join": (
        lambda s, d: env(s, d)["accounts"].join(env(s, d)["users"], "user_id", "left").select("account_id", "user_id", "home_country"),
        sql("SELECT account_id, user_id, home_country FROM owner LEFT JOIN users USING (user_id)"),
    ),
    "preaggregated_join": (
        lambda s, d: _linked(s, d).select("txn_id", F.coalesce("device_accounts", F.lit(1)).cast("int").alias("device_account_count")),
        sql("SELECT txn_id, coalesce(n, 1)::INTEGER AS device_account_count FROM tx LEFT JOIN (SELECT device_id, count(DISTINCT account_id) AS n FROM links GROUP BY device_id) USING (device_id)"),
    ),
    "composite_link_join": (
        lambda s, d: _linked(s, d).select("txn_id", S.flag(F.col("is_primary")).alias("is_primary_device_for_account")),
        sql("SELECT txn_id, coalesce(is_primary, false)::INTEGER AS is_primary_device_for_account FROM tx LEFT JOIN links USING (account_id, device_id)"),
    ),
    "temporal_link_flag": (
        lambda s, d: X.device(_linked(s, d)).select("txn_id", "is_new_device"),
        sql("SELECT txn_id, (first_used_ts IS NULL OR first_used_ts > ts)::INTEGER AS is_new_device FROM tx LEFT JOIN links USING (account_id, device_id)"),
    ),
    "device_share_pairs": (lambda s, d: graph.device_share_pairs(env(s, d)["account_devices"]), sql("SELECT * FROM pairs", EDGES)),
    "semi_fraud_neighbors": (
        lambda s, d: (lambda e: graph.marked_neighbours(e["account_devices"], graph.fraud_accounts(e["transactions"])))(env(s, d)),
        sql("SELECT account_id, other FROM both_ways WHERE other IN (SELECT account_id FROM bad)", EDGES),
    ),
    "anti_new_devices": (_new_devices, sql("SELECT txn_id, account_id, device_id FROM tx WHERE device_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.account_id = tx.account_id AND l.device_id = tx.device_id)")),
    "noneq_foreign_candidates": (_foreign, sql("SELECT user_id, count(location_id) AS n_foreign FROM users LEFT JOIN locations ON country <> home_country GROUP BY user_id")),
    "scenario_breakdown": (lambda s, d: writers.scenario_breakdown(env(s, d)["transactions"]), sql("SELECT scenario_tag, count(*) AS n_total, sum(label_fraud)::BIGINT AS n_fraud FROM tx GROUP BY scenario_tag")),
    "fraud_rate": (lambda s, d: writers.fraud_rate(env(s, d)["transactions"]).select(F.round("fraud_rate", 9).alias("fraud_rate")), sql("SELECT round(coalesce(avg(label_fraud), 0), 9) AS fraud_rate FROM tx")),
    "nunique_per_group": (
        lambda s, d: env(s, d)["account_devices"].groupBy("device_id").agg(F.count_distinct("account_id").alias("n_accounts")),
        sql("SELECT device_id, count(DISTINCT account_id) AS n_accounts FROM links GROUP BY device_id"),
    ),
    "profile_stats": (_profile, "SELECT user_id, count(*) AS n_transactions, round(avg(value), 6) AS mean_amount, round(median(value), 6) AS median_amount, round(coalesce(stddev_samp(value), 0), 6) AS std_amount FROM events GROUP BY user_id"),
    "hour_histogram": (
        lambda s, d: profiles.hour_histogram(events(s, d)).select("user_id", F.array_join(F.col("hours").cast("array<string>"), ",").alias("hours")),
        "SELECT user_id, array_to_string([count(*) FILTER (hour(ts) = h) FOR h IN range(0, 1)], '') AS hours FROM events GROUP BY user_id".replace("array_to_string([count(*) FILTER (hour(ts) = h) FOR h IN range(0, 1)], '')", "concat_ws(',', " + ", ".join(f"count(*) FILTER (hour(ts) = {h})" for h in range(24)) + ")"),
    ),
    "top3_merchants": (
        lambda s, d: profiles.top_values(_owned(s, d), "merchant_id").select("user_id", F.array_join(F.col("top").cast("array<string>"), ",").alias("top")),
        sql("SELECT user_id, string_agg(merchant_id::VARCHAR, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, merchant_id) AS r FROM (SELECT user_id, merchant_id, count(*) AS n FROM tx JOIN owner USING (account_id) WHERE merchant_id IS NOT NULL GROUP BY user_id, merchant_id)) WHERE r <= 3 GROUP BY user_id"),
    ),
    "known_sets": (
        lambda s, d: profiles.known_values(_owned(s, d), "device_id", "known").select("user_id", F.array_join(F.col("known").cast("array<string>"), ",").alias("known")),
        sql("SELECT user_id, coalesce(string_agg(DISTINCT device_id::VARCHAR, ',' ORDER BY device_id::VARCHAR), '') AS known FROM (SELECT DISTINCT user_id, device_id FROM tx JOIN owner USING (account_id)) GROUP BY user_id").replace("DISTINCT device_id::VARCHAR, ',' ORDER BY device_id::VARCHAR", "device_id::VARCHAR, ',' ORDER BY device_id"),
    ),
    "daily_frequency": (
        lambda s, d: profiles.daily_frequency(events(s, d)).select("user_id", F.round("avg_daily_frequency", 6).alias("avg_daily_frequency")),
        "SELECT user_id, round(count(*)::DOUBLE / (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1), 6) AS avg_daily_frequency FROM events GROUP BY user_id",
    ),
    "min_class_count": (
        lambda s, d: env(s, d)["transactions"].groupBy("label_fraud").agg(F.count("*").alias("n")).agg(F.min("n").alias("least")),
        sql("SELECT min(n) AS least FROM (SELECT count(*) AS n FROM tx GROUP BY label_fraud)"),
    ),
    "account_device_array": (
        lambda s, d: env(s, d)["account_devices"].groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_list("device_id")).cast("array<string>"), ",").alias("devices")),
        sql("SELECT account_id, string_agg(device_id::VARCHAR, ',' ORDER BY device_id) AS devices FROM links GROUP BY account_id"),
    ),
    "scaler_params": (
        lambda s, d: prepare.Scaler(["amount", "label_fraud"]).params_frame(env(s, d)["transactions"]).select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")),
        sql("SELECT 'amount' AS \"column\", round(avg(amount), 6) AS mean, round(stddev_pop(amount), 6) AS std FROM tx UNION ALL SELECT 'label_fraud', round(avg(label_fraud), 6), round(stddev_pop(label_fraud), 6) FROM tx"),
    ),
    "scaled_values": (_scaled, sql("SELECT txn_id, round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 6) AS scaled FROM tx")),
    "median_impute": (
        _imputed,
        sql("SELECT txn_id, CASE WHEN txn_id % 7 = 0 OR txn_id % 11 = 0 OR txn_id % 13 = 0 THEN (SELECT median(amount) FROM tx WHERE txn_id % 7 <> 0 AND txn_id % 11 <> 0 AND txn_id % 13 <> 0) ELSE amount END AS x FROM tx"),
    ),
    "percentiles_iqr": (
        _percentiles,
        sql("SELECT round(quantile_cont(amount, 0.01), 6) AS p01, round(quantile_cont(amount, 0.25), 6) AS p25, round(quantile_cont(amount, 0.75), 6) AS p75, round(quantile_cont(amount, 0.99), 6) AS p99 FROM tx"),
    ),
    "hist_bins": (lambda s, d: prepare.histogram(env(s, d)["transactions"], "amount", 0, 5000, 40), sql("SELECT least(floor(amount / (5000.0::DOUBLE / 40)), 39)::INTEGER AS bin, count(*) AS n FROM tx WHERE amount BETWEEN 0 AND 5000 GROUP BY ALL")),
    "corr_pairs": (
        lambda s, d: prepare.correlations(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", F.round("corr", 6).alias("corr")),
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount"]) for b in ["l_quantity", "l_extendedprice", "l_discount"][i:]),
    ),
    "boxplot_summary": (_boxplot, sql("SELECT label_fraud, round(min(amount), 6) AS low, round(quantile_cont(amount, 0.25), 6) AS q1, round(quantile_cont(amount, 0.5), 6) AS median, round(quantile_cont(amount, 0.75), 6) AS q3, round(max(amount), 6) AS high FROM tx GROUP BY label_fraud")),
    "graph_edges": (lambda s, d: graph.edges(env(s, d)), sql("SELECT * FROM edges", EDGES)),
    "graph_degrees": (_graph_nodes, sql("SELECT node, degree FROM deg", EDGES)),
    "node_edge_counts": (
        lambda s, d: graph.edge_counts(env(s, d)),
        sql("SELECT kind, count(*) AS n FROM edges GROUP BY kind", EDGES),
    ),
    "suspicious_neighbors": (_suspicious, sql("SELECT account_id, n FROM sus", EDGES)),
    "graph_features": (
        lambda s, d: graph.graph_features(env(s, d)),
        sql(
            """SELECT txn_id, coalesce(a.degree, 0)::INTEGER AS account_degree, coalesce(dd.n, 0)::INTEGER AS device_degree, coalesce(m.n, 0)::INTEGER AS merchant_degree, greatest(coalesce(dd.n, 0) - 1, 0)::INTEGER AS shared_device_count, coalesce(sus.n, 0)::INTEGER AS account_suspicious_neighbor_count
            FROM tx LEFT JOIN deg a ON a.node = 'account:' || tx.account_id LEFT JOIN (SELECT device_id, count(DISTINCT account_id) AS n FROM links GROUP BY device_id) dd ON dd.device_id = tx.device_id
            LEFT JOIN (SELECT merchant_id, count(DISTINCT account_id) AS n FROM tx GROUP BY merchant_id) m ON m.merchant_id = tx.merchant_id LEFT JOIN sus ON sus.account_id = tx.account_id""",
            EDGES,
        ),
    ),
    "union_background": (_union, sql("SELECT txn_id, amount, CASE WHEN label_fraud = 1 THEN scenario_tag END AS scenario_tag FROM tx")),
    "distinct_pairs": (lambda s, d: env(s, d)["transactions"].where("merchant_id IS NOT NULL").select("account_id", "merchant_id").dropDuplicates(), sql("SELECT DISTINCT account_id, merchant_id FROM tx WHERE merchant_id IS NOT NULL")),
    "key_set_diff": (
        _key_sets,
        sql("""SELECT 'minus' AS op, count(*) AS n FROM (SELECT account_id FROM owner EXCEPT SELECT account_id FROM tx) UNION ALL SELECT 'intersect', count(*) FROM (SELECT account_id FROM owner INTERSECT SELECT account_id FROM tx)
            UNION ALL SELECT 'union', count(*) FROM (SELECT account_id FROM owner UNION SELECT account_id FROM tx)"""),
    ),
    "head_rows": (lambda s, d: env(s, d)["transactions"].orderBy(F.desc("amount"), "txn_id").limit(25).select("txn_id", "amount"), sql("SELECT txn_id, amount FROM tx ORDER BY amount DESC, txn_id LIMIT 25")),
}
