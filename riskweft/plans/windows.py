"""Window features: strict history, trailing ranges, previous rows, and the whole feature matrix."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweft.functions import windows as W
from riskweft.operators import features as X
from riskweft.operators import prepare
from riskweft.operators.profiles import hour_histogram, usual_hours
from riskweft.plans.sql import FEATURES, sql
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import event_transactions as events

ROUNDED = {"amount_log": 6, "prior_total_amount": 2, "prior_mean_amount": 6, "prior_std_amount": 4, "amount_zscore": 4, "amount_log_ratio": 6, "distance_to_prev_km": 4, "vel_amount_300s": 2, "vel_amount_3600s": 2, "vel_amount_86400s": 2}


def spark_cols(names):
    return [F.round(n, ROUNDED[n]).alias(n) if n in ROUNDED else F.col(n) for n in names]


def sql_cols(names):
    return ", ".join(f"round({n}, {ROUNDED[n]}) AS {n}" if n in ROUNDED else n for n in names)


def part(*names):
    """A query of some features of every transaction, and its SQL."""
    return lambda s, d: X.build_features(env(s, d)).select("txn_id", *spark_cols(names)), sql(f"SELECT txn_id, {sql_cols(names)} FROM f", FEATURES)


def _history(s, d):
    e = env(s, d)
    tx = X.with_place(X.with_owner(e["transactions"], e["accounts"], e["users"]), e["locations"])
    return X.with_history(tx.repartition("user_id"))


def _events_velocity(s, d):
    tx = events(s, d).withColumn("us", W.micros("ts"))
    w = {f"vel_count_{k}": W.trailing_count(["account_id"], "us", "txn_id", n) for k, n in (("1h", 3600), ("24h", 86400))}
    return tx.select("txn_id", *[c.alias(n) for n, c in w.items()])


def _events_amount(s, d):
    tx = events(s, d).withColumn("us", W.micros("ts"))
    return tx.select("txn_id", F.round(W.trailing_sum(["account_id"], "us", "txn_id", 86400, "amount"), 2).alias("vel_amount_24h"))


def _events_high(s, d):
    tx = events(s, d).withColumn("us", W.micros("ts"))
    high = F.col("amount") > 100
    return tx.select("txn_id", F.when(high, W.trailing_count(["account_id"], "us", "txn_id", 86400, high)).otherwise(0).cast("int").alias("n"))


def _ordered(s, d):
    return prepare.ordered_split(env(s, d)["transactions"], ["ts", "txn_id"]).select("txn_id", "amount", "channel", "split")


VEL = """WITH v AS (SELECT x.event_id AS txn_id, x.value AS amount, y.value AS other, y.event_id AS y_id, x.ts - y.ts AS gap FROM events x
  LEFT JOIN events y ON x.user_id = y.user_id AND (y.ts < x.ts OR (y.ts = x.ts AND y.event_id < x.event_id)) AND y.ts > x.ts - INTERVAL 86400 SECOND)
"""

QUERIES = {
    "prior_count_sum_mean": part("prior_tx_count", "prior_total_amount", "prior_mean_amount"),
    "prior_std_zscore": part("prior_std_amount", "amount_zscore"),
    "amount_log_ratio": part("amount_log", "amount_log_ratio", "is_new_user"),
    "prior_unique": part("prior_unique_merchants", "prior_unique_devices", "prior_unique_locations"),
    "prior_unique_countries": (lambda s, d: _history(s, d).select("txn_id", "prior_unique_countries"), sql("SELECT txn_id, prior_unique_countries FROM f", FEATURES)),
    "velocity_1h_24h": (_events_velocity, VEL + "SELECT txn_id, count(y_id) FILTER (gap < INTERVAL 3600 SECOND)::INTEGER AS vel_count_1h, count(y_id)::INTEGER AS vel_count_24h FROM v GROUP BY txn_id"),
    "velocity_amount": (_events_amount, VEL + "SELECT txn_id, round(coalesce(sum(other::DECIMAL(18,2)), 0)::DOUBLE, 2) AS vel_amount_24h FROM v GROUP BY txn_id"),
    "high_value_velocity": (_events_high, VEL + "SELECT txn_id, CASE WHEN any_value(amount) > 100 THEN count(y_id) FILTER (other > 100) ELSE 0 END::INTEGER AS n FROM v GROUP BY txn_id"),
    "velocity_features": part("vel_count_300s", "vel_amount_300s", "vel_count_3600s", "vel_amount_3600s", "vel_count_86400s", "vel_amount_86400s", "vel_high_value_count_3600s"),
    "prev_location_switch": (
        lambda s, d: X.build_features(env(s, d)).select("txn_id", F.coalesce("prev_location_id", F.lit(-1)).alias("prev_location_id"), "country_switch", "is_unusual_location"),
        sql("SELECT txn_id, coalesce(prev_location_id, -1) AS prev_location_id, country_switch, is_unusual_location FROM f", FEATURES),
    ),
    "haversine_prev": part("distance_to_prev_km"),
    "device_features": part("is_new_device", "device_account_count", "device_is_shared", "is_primary_device_for_account"),
    "transactional_features": part("hour", "day_of_week", "is_offhours", "is_high_value", "is_high_risk_merchant", "merchant_risk_band_ord"),
    "first_txn_per_user": (
        lambda s, d: events(s, d).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "txn_id"))).where("r = 1").select("user_id", "txn_id"),
        "SELECT user_id, event_id AS txn_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    ),
    "unusual_hour_top12": (
        lambda s, d: hour_histogram(events(s, d)).select("user_id", F.array_join(F.array_sort(usual_hours(F.col("hours"))).cast("array<string>"), ",").alias("hours")),
        "SELECT user_id, string_agg(h::VARCHAR, ',' ORDER BY h) AS hours FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS r FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 12 GROUP BY user_id",
    ),
    "sequence_ids": (
        lambda s, d: prepare.with_rank(env(s, d)["transactions"], ["ts", "txn_id"], "seq").select("txn_id", F.col("seq").cast("long").alias("seq"), "amount", "channel", "device_id"),
        sql("SELECT txn_id, row_number() OVER (ORDER BY ts, txn_id) AS seq, amount, channel, device_id FROM tx"),
    ),
    "ordered_split": (
        _ordered,
        sql("SELECT txn_id, amount, channel, CASE WHEN row_number() OVER (ORDER BY ts, txn_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM tx"),
    ),
    "feature_matrix_36": part(*X.feature_columns()),
}
