"""The payment tables from TPC-H-like ones.

| payment table | made from |
| --- | --- |
| users, accounts | customers; two accounts a user, the user's country is that of the smaller account |
| merchants | suppliers; the risk band comes from the balance |
| locations | nations; latitude and longitude are linear in the key |
| transactions | orders, with the smallest supplier key of their line items, the smallest part key modulo 200 as device, a day of orders lasting two minutes |
| account_devices | devices of orders whose key is no multiple of three |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channel of each order priority.
CHANNEL = {"1-URGENT": "online", "2-HIGH": "pos", "3-MEDIUM": "atm", "4-NOT SPECIFIED": "mobile", "5-LOW": "online"}

#: Devices that the parts stand for, so some are shared by hundreds of accounts.
DEVICES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def environment(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    get = lambda name: table(spark, sf_dir, name)
    nation = get("nation")
    named = nation.select(F.col("n_nationkey").alias("__n"), F.col("n_name").alias("country"))
    customer = get("customer")
    epoch = F.lit("1992-01-01").cast("timestamp")
    owner = customer.select(F.col("c_custkey").alias("account_id"), F.floor(F.col("c_custkey") / 2).cast("long").alias("user_id"), F.col("c_nationkey").alias("__n"), "c_mktsegment")
    first = owner.groupBy("user_id").agg(F.min(F.struct("account_id", "__n", "c_mktsegment")).alias("x")).select("user_id", F.col("x.__n").alias("__n"), F.col("x.c_mktsegment").alias("risk_segment"))
    users = first.join(named, "__n", "left").select("user_id", epoch.alias("signup_ts"), F.col("country").alias("home_country"), "risk_segment")
    accounts = owner.select("account_id", "user_id", epoch.alias("opened_ts"), F.lit("checking").alias("account_type"), F.lit("active").alias("status"))
    supplier = get("supplier").join(named, F.col("s_nationkey") == F.col("__n"), "left")
    band = F.when(F.col("s_acctbal") < 1000, "high").when(F.col("s_acctbal") < 5000, "medium").otherwise("low")
    merchants = supplier.select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"), F.lit("retail").alias("category"), (1000 + F.col("s_suppkey") % 9000).cast("int").alias("mcc_code"), "country", band.alias("risk_band"))
    key = F.col("n_nationkey").cast("long")
    locations = nation.select(key.alias("location_id"), F.col("n_name").alias("city"), F.col("n_name").alias("country"), F.col("n_name").alias("region"), (key * 7 % 121 - 60).cast("double").alias("lat"), (key * 29 % 341 - 170).cast("double").alias("lon"))
    lines = get("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("merchant_id"), (F.min("l_partkey") % DEVICES).alias("device_id"))
    places = get("supplier").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_nationkey").cast("long").alias("location_id"))
    orders = get("orders")
    channel = F
    for name, value in CHANNEL.items():
        channel = channel.when(F.col("o_orderpriority") == name, value)
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    ts = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + day * 120 + F.col("o_orderkey") * 7919 % 3600)
    tx = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").join(places, "merchant_id", "left")
    tx = tx.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("account_id"), "device_id", "merchant_id", "location_id", ts.alias("ts"), (F.floor("o_totalprice") / 100.0).cast("double").alias("amount"),
        F.lit("USD").alias("currency"), channel.alias("channel"), F.col("o_orderstatus").alias("status"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("label_fraud"), F.col("o_orderpriority").alias("scenario_tag"), F.lit(None).cast("string").alias("scenario_extra"),
    )
    known = tx.where("txn_id % 3 <> 0 AND device_id IS NOT NULL").groupBy("account_id", "device_id").agg(F.min("ts").alias("first_used_ts"), F.max("ts").alias("last_used_ts"))
    least = known.groupBy("account_id").agg(F.min("device_id").alias("__d"))
    links = known.join(least, "account_id").select("account_id", "device_id", "first_used_ts", "last_used_ts", (F.col("device_id") == F.col("__d")).alias("is_primary"))
    devices = known.groupBy("device_id").agg(F.min("first_used_ts").alias("first_seen_ts")).select("device_id", F.lit("mobile").alias("device_type"), F.substring(F.sha2(F.col("device_id").cast("string"), 256), 1, 16).alias("fingerprint_hash"), "first_seen_ts")
    return {"users": users, "accounts": accounts, "devices": devices, "merchants": merchants, "locations": locations, "account_devices": links, "transactions": tx}


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions of their users: dense in time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"), F.col("event_type").alias("channel"), "props", (F.col("event_type") == "error").cast("int").alias("label_fraud"))
