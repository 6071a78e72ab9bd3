"""The 36 leakage-safe features, on one frame without self-joins.

History windows go by user, velocity and location windows by account within user, so one shuffle by user serves all.
That keeps a user's rows in one task; tasks are as many as the rows ask for. With `segments` in the configuration, users
with more rows than a task should hold are cut into segments instead: the same values from more passes over their rows,
for tables in which a few users have a large share of all rows. The rows of the others take the one shuffle either way.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.functions import windows as W
from riskweft.operators import temporal as T
from riskweft.schema import tables
from riskweft.scratch import dealt, kept


@dataclass(frozen=True)
class FeatureConfig:
    velocity_windows_seconds: tuple[int, ...] = (300, 3600, 86_400)
    history_min_events: int = 5
    high_value_threshold: float = 1000.0
    high_value_window_seconds: int = 3600
    label_col: str = "label_fraud"
    segments: bool = False
    task_rows: int = 100_000


def feature_columns(config: FeatureConfig = FeatureConfig()) -> list[str]:
    """Names of the features in canonical order."""
    return [
        "amount_log", "hour", "day_of_week", "is_offhours", "is_high_value", "is_online", "is_pos", "is_atm", "is_mobile",
        "is_high_risk_merchant", "merchant_risk_band_ord", "prior_tx_count", "prior_total_amount", "prior_mean_amount",
        "prior_std_amount", "amount_zscore", "amount_log_ratio", "is_new_user", "prior_unique_merchants",
        "prior_unique_devices", "prior_unique_locations", "prior_unique_countries",
        *[f"vel_{kind}_{w}s" for w in config.velocity_windows_seconds for kind in ("count", "amount")],
        f"vel_high_value_count_{config.high_value_window_seconds}s", "is_new_device", "device_account_count",
        "device_is_shared", "is_primary_device_for_account", "country_switch", "distance_to_prev_km", "is_unusual_location",
    ]


def with_owner(tx: DataFrame, accounts: DataFrame, users: DataFrame) -> DataFrame:
    """Adds user_id and home_country."""
    owners = accounts.select("account_id", "user_id").join(users.select("user_id", "home_country"), "user_id", "left")
    return tx.join(owners, "account_id", "left")


def with_place(tx: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds tx_country, lat, lon."""
    return tx.join(locations.select("location_id", F.col("country").alias("tx_country"), "lat", "lon"), "location_id", "left")


def with_merchant(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    return tx.join(merchants.select("merchant_id", "risk_band"), "merchant_id", "left")


def with_links(tx: DataFrame, links: DataFrame) -> DataFrame:
    """Adds the account's link to the device and the number of accounts on the device; the link table may repeat."""
    per_link = links.groupBy("account_id", "device_id").agg(F.min("first_used_ts").alias("first_used_ts"), F.max("is_primary").alias("is_primary"))
    per_device = links.groupBy("device_id").agg(F.count_distinct("account_id").alias("device_accounts"))
    return tx.join(per_link, ["account_id", "device_id"], "left").join(per_device, "device_id", "left")


def transactional(config: FeatureConfig) -> dict[str, Column]:
    hour = S.hour_of_day("ts")
    return {
        "amount_log": F.log1p("amount"),
        "hour": hour,
        "day_of_week": S.day_of_week("ts"),
        "is_offhours": S.off_hours(hour),
        "is_high_value": S.flag(F.col("amount") > config.high_value_threshold),
        **S.one_hot("channel", S.CHANNELS),
        "is_high_risk_merchant": S.flag(F.col("risk_band") == "high"),
        "merchant_risk_band_ord": S.ordinal("risk_band"),
    }


def zscore(amount: Column, mean: Column, std: Column) -> Column:
    """Null where undefined; a deviation from constant history is infinite."""
    diff = amount - mean
    return F.when(std.isNull(), F.lit(None)).when(std == 0, F.when(diff == 0, F.lit(None)).otherwise(F.signum(diff) * float("inf"))).otherwise(F.try_divide(diff, std))


def with_history(tx: DataFrame, config: FeatureConfig = FeatureConfig(), partition: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Adds what the user's prior transactions say."""
    w = W.prior(partition, ["ts", "txn_id"])
    tx = tx.withColumns(
        {
            "prior_tx_count": W.prior_count(w).cast("int"),
            "prior_total_amount": W.prior_sum("amount", w),
            "prior_mean_amount": W.prior_mean("amount", w),
            "prior_std_amount": W.prior_std("amount", w),
        }
    )
    tx = W.with_prior_distinct(tx, partition, ["ts", "txn_id"], {"prior_unique_merchants": "merchant_id", "prior_unique_devices": "device_id", "prior_unique_locations": "location_id"})
    tx = W.with_prior_distinct(tx, partition, ["txn_id"], {"prior_unique_countries": "tx_country"})
    return _of_history(tx, config)


def _of_history(tx: DataFrame, config: FeatureConfig) -> DataFrame:
    return tx.withColumns(
        {
            "amount_zscore": zscore(F.col("amount"), F.col("prior_mean_amount"), F.col("prior_std_amount")),
            "amount_log_ratio": F.log1p("amount") - F.log1p("prior_mean_amount"),
            "is_new_user": S.flag(F.col("prior_tx_count") < config.history_min_events),
        }
    )


def with_velocity(tx: DataFrame, config: FeatureConfig = FeatureConfig(), partition: tuple[str, ...] = ("user_id", "account_id")) -> DataFrame:
    """Adds trailing counts and sums per account."""
    tx = tx.withColumn("__us", W.micros("ts"))
    new = {}
    for seconds in config.velocity_windows_seconds:
        new[f"vel_count_{seconds}s"] = W.trailing_count(partition, "__us", "txn_id", seconds)
        new[f"vel_amount_{seconds}s"] = W.trailing_sum(partition, "__us", "txn_id", seconds, "amount")
    high = F.col("amount") > config.high_value_threshold
    seconds = config.high_value_window_seconds
    new[f"vel_high_value_count_{seconds}s"] = F.when(high, W.trailing_count(partition, "__us", "txn_id", seconds, high)).otherwise(0).cast("int")
    return tx.withColumns(new).drop("__us")


def _in_segments(tx: DataFrame, config: FeatureConfig, own: tuple[str, ...], per_account: tuple[str, ...]) -> DataFrame:
    """What with_history, with_velocity and with_location add, without a task that holds a whole user."""
    tx = tx.withColumns({"__own": F.struct(*own), "__each": F.struct(*per_account)})  # names without gaps
    tx = T.with_prior(tx, ["__own"], ["ts", "txn_id"], "amount", distinct={"prior_unique_merchants": "merchant_id", "prior_unique_devices": "device_id", "prior_unique_locations": "location_id"})
    tx = _of_history(T.with_distinct(tx, ["__own"], ["txn_id"], {"prior_unique_countries": "tx_country"}), config)
    high, seconds = F.col("amount") > config.high_value_threshold, config.high_value_window_seconds
    windows = {f"vel_{kind}_{s}s": (s, what) for s in config.velocity_windows_seconds for kind, what in (("count", None), ("amount", "amount"))}
    windows[name := f"vel_high_value_count_{seconds}s"] = (seconds, high)
    tx = T.with_trailing(tx, ["__each"], "ts", "txn_id", windows)
    tx = tx.withColumn(name, F.when(high, F.col(name)).otherwise(0).cast("int"))
    return _of_location(T.with_previous(tx, ["__each"], ["ts", "txn_id"], _PREVIOUS)).drop("__own", "__each")


def device(tx: DataFrame) -> DataFrame:
    count = F.coalesce("device_accounts", F.lit(1)).cast("int")
    return tx.withColumns(
        {
            "is_new_device": F.when(F.col("first_used_ts").isNull() | (F.col("first_used_ts") > F.col("ts")), 1).otherwise(0),
            "device_account_count": count,
            "device_is_shared": (count >= 2).cast("int"),
            "is_primary_device_for_account": S.flag(F.col("is_primary")),
        }
    )


#: What is taken from the account's previous transaction.
_PREVIOUS = {"__prev_id": "txn_id", "prev_location_id": "location_id", "__prev_country": "tx_country", "__prev_lat": "lat", "__prev_lon": "lon"}


def with_location(tx: DataFrame, partition: tuple[str, ...] = ("user_id", "account_id")) -> DataFrame:
    """Adds what changed since the account's previous transaction."""
    w = Window.partitionBy(*partition).orderBy("ts", "txn_id")
    return _of_location(tx.withColumns({name: F.lag(c).over(w) for name, c in _PREVIOUS.items()}))


def _of_location(tx: DataFrame) -> DataFrame:
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    unknown_or_other = F.col("tx_country").isNull() | F.col("__prev_country").isNull() | (F.col("tx_country") != F.col("__prev_country"))
    return tx.withColumns(
        {
            "country_switch": S.flag(F.col("__prev_id").isNotNull() & unknown_or_other),
            "distance_to_prev_km": F.when(F.col("__prev_id").isNull(), 0.0).otherwise(S.haversine_km(at("__prev_lat"), at("__prev_lon"), at("lat"), at("lon"))),
            "is_unusual_location": S.flag(F.col("home_country").isNotNull() & (F.col("tx_country").isNull() | (F.col("tx_country") != F.col("home_country")))),
        }
    ).drop("__prev_id", "__prev_country", "__prev_lat", "__prev_lon")


def build_features(env: Mapping[str, DataFrame], config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """txn_id, account_id, user_id, ts, amount, label, ids and the features, one row a transaction.

    A transaction of an account without an owner has the history of its account, so such rows are no single group.
    """
    tx, accounts, users, merchants, locations, links = tables(env, "transactions", "accounts", "users", "merchants", "locations", "account_devices")
    frame = with_links(with_merchant(with_place(with_owner(tx, accounts, users), locations), merchants), links)
    frame = frame.withColumns(transactional(config))
    frame = frame.withColumn("__lone", F.when(F.col("user_id").isNull(), F.col("account_id")))
    own, per_account = ("user_id", "__lone"), ("user_id", "__lone", "account_id")
    given = ["txn_id", "account_id", "user_id", "ts", "amount", config.label_col, "scenario_tag", "merchant_id", "device_id", "location_id", "tx_country", "prev_location_id", "channel"]
    needed = [*given, "__lone", "home_country", "lat", "lon", "first_used_ts", "is_primary", "device_accounts", *transactional(config)]
    frame = kept(frame.select(*[c for c in frame.columns if c in needed]), "payments")  # written, so its rows are counted for nothing
    large = _large(frame, own, config.task_rows) if config.segments else None
    if large is None:
        frame = _by_user(frame, config, own, per_account)
    else:
        same = F.col("user_id").eqNullSafe(F.col("__large_user")) & F.col("__lone").eqNullSafe(F.col("__large_lone"))
        few = F.broadcast(large)
        frame = _by_user(frame.join(few, same, "left_anti"), config, own, per_account).unionByName(_in_segments(frame.join(few, same, "left_semi"), config, own, per_account))
    frame = device(frame)
    return frame.select(*[c for c in given if c in frame.columns], *feature_columns(config))


def _by_user(frame: DataFrame, config: FeatureConfig, own: tuple[str, ...], per_account: tuple[str, ...]) -> DataFrame:
    """What with_history, with_velocity and with_location add, from one shuffle."""
    frame = dealt(frame, frame.count(), config.task_rows, *own)
    return with_location(with_velocity(with_history(frame, config, own), config, per_account), per_account)


def _large(frame: DataFrame, own: tuple[str, ...], rows: int) -> DataFrame | None:
    """(__large_user, __large_lone) of more rows than a task should hold, of which there are few; None if there are none."""
    n = frame.groupBy(*own).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)
    found = kept(n.select(*[F.col(c).alias(a) for c, a in zip(own, ("__large_user", "__large_lone"), strict=True)]), "large")
    return found if found.limit(1).count() else None
