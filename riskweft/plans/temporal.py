"""As-of and interval joins, and history of events by segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import features as X
from riskweft.operators import temporal as T
from riskweft.plans.sql import FEATURES, sql
from riskweft.plans.windows import spark_cols, sql_cols
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import event_transactions as events

KEYS = ["account_id"]


def _asof(s, d, exact=True, tolerance=None):
    """The last error of the account up to each event."""
    e = events(s, d)
    errors = e.where("label_fraud = 1").select("account_id", F.col("ts").alias("error_ts"), F.col("txn_id").alias("error_id"), F.col("amount").alias("error_amount"))
    out = T.asof_join(e.select("txn_id", "account_id", "ts"), errors, KEYS, "ts", "error_ts", ["error_id", "error_amount"], "error_id", exact, tolerance)
    return out.select("txn_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"), F.round(F.coalesce("error_amount", F.lit(0.0)), 4).alias("error_amount"))


def _previous_link(s, d):
    """The device that the account's devices were first used at last before each transaction."""
    e = env(s, d)
    links = e["account_devices"].select("account_id", F.col("first_used_ts").alias("used_ts"), F.col("device_id").alias("last_device"))
    out = T.asof_join(e["transactions"].select("txn_id", "account_id", "ts"), links, KEYS, "ts", "used_ts", ["last_device"], "last_device")
    return out.select("txn_id", F.coalesce("last_device", F.lit(-1)).alias("last_device"))


def _interval(s, d):
    """Events of the account in the six hours before an error and the hour after it."""
    e = events(s, d)
    errors = e.where("label_fraud = 1").select("account_id", F.col("txn_id").alias("error_id"), F.col("ts").alias("error_ts"))
    met = T.interval_join(errors, e.select("account_id", "txn_id", "ts"), KEYS, "error_ts", "ts", 6 * 3600, 3600)
    return met.select("error_id", "txn_id")


def _history(s, d):
    out = T.with_prior(events(s, d), KEYS, ["ts", "txn_id"], "amount", distinct={"prior_channels": "channel", "prior_devices": "props"})
    return out.select("txn_id", "prior_tx_count", F.round("prior_total_amount", 2).alias("prior_total_amount"), F.round("prior_mean_amount", 6).alias("prior_mean_amount"), F.round("prior_std_amount", 4).alias("prior_std_amount"), "prior_channels", "prior_devices")


def _trailing(s, d):
    windows = {"n_1h": (3600, None), "n_24h": (86_400, None), "amount_24h": (86_400, "amount"), "high_24h": (86_400, F.col("amount") > 100)}
    out = T.with_trailing(events(s, d), KEYS, "ts", "txn_id", windows)
    return out.select("txn_id", "n_1h", "n_24h", F.round("amount_24h", 2).alias("amount_24h"), "high_24h")


def _matrix(s, d):
    """The features of every transaction, users cut into segments."""
    return X.build_features(env(s, d), X.FeatureConfig(segments=True)).select("txn_id", *spark_cols(X.feature_columns()))


ASOF = """WITH e AS (SELECT user_id, ts AS error_ts, max(event_id) AS error_id, arg_max(value, event_id) AS error_amount FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT event_id AS txn_id, coalesce(error_id, -1) AS error_id, round(coalesce(error_amount, 0), 4) AS error_amount FROM events x ASOF LEFT JOIN e ON x.user_id = e.user_id AND x.ts """

QUERIES = {
    "feature_matrix_segments": (_matrix, sql(f"SELECT txn_id, {sql_cols(X.feature_columns())} FROM f", FEATURES)),
    "asof_last_error": (_asof, ASOF + ">= error_ts"),
    "asof_strictly_before": (lambda s, d: _asof(s, d, exact=False), ASOF + "> error_ts"),
    "asof_within_a_day": (
        lambda s, d: _asof(s, d, tolerance=86_400),
        ASOF.replace("coalesce(error_id", "coalesce(CASE WHEN x.ts - error_ts <= INTERVAL 1 DAY THEN error_id END").replace("coalesce(error_amount", "coalesce(CASE WHEN x.ts - error_ts <= INTERVAL 1 DAY THEN error_amount END") + ">= error_ts",
    ),
    "asof_last_device": (
        _previous_link,
        sql("SELECT txn_id, coalesce(last_device, -1) AS last_device FROM tx ASOF LEFT JOIN (SELECT account_id, first_used_ts AS used_ts, max(device_id) AS last_device FROM links GROUP BY ALL) k ON tx.account_id = k.account_id AND tx.ts >= used_ts"),
    ),
    "interval_join": (
        _interval,
        "SELECT x.event_id AS error_id, y.event_id AS txn_id FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts - INTERVAL 6 HOUR AND x.ts + INTERVAL 1 HOUR WHERE x.event_type = 'error'",
    ),
    "segmented_history": (
        _history,
        """WITH f AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)::INTEGER AS c, (props IS NOT NULL AND row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) = 1)::INTEGER AS p FROM events)
        SELECT event_id AS txn_id, (count(*) OVER w)::INTEGER AS prior_tx_count, round(coalesce(sum(value::DECIMAL(18,2)) OVER w, 0)::DOUBLE, 2) AS prior_total_amount,
            round((sum(value::DECIMAL(18,2)) OVER w)::DOUBLE / nullif(count(value) OVER w, 0), 6) AS prior_mean_amount, round(CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(value) OVER w END, 4) AS prior_std_amount,
            coalesce(sum(c) OVER w, 0)::INTEGER AS prior_channels, coalesce(sum(p) OVER w, 0)::INTEGER AS prior_devices
        FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "segmented_velocity": (
        _trailing,
        """SELECT x.event_id AS txn_id, count(y.event_id) FILTER (y.ts > x.ts - INTERVAL 1 HOUR)::INTEGER AS n_1h, count(y.event_id)::INTEGER AS n_24h, round(coalesce(sum(y.value::DECIMAL(18,2)), 0)::DOUBLE, 2) AS amount_24h, count(y.event_id) FILTER (y.value > 100)::INTEGER AS high_24h
        FROM events x LEFT JOIN events y ON x.user_id = y.user_id AND (y.ts < x.ts OR (y.ts = x.ts AND y.event_id < x.event_id)) AND y.ts > x.ts - INTERVAL 1 DAY GROUP BY x.event_id""",
    ),
}
