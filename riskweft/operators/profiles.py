"""Behavioural profiles: one row a user; and the score of a transaction against its user's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweft.functions import scalars as S

USUAL_HOURS, TOP = 12, 3


def amount_stats(tx: DataFrame) -> DataFrame:
    """user_id, n, mean, exact median and sample deviation (0 with fewer than two)."""
    return tx.groupBy("user_id").agg(
        F.count("*").alias("n_transactions"),
        F.avg("amount").alias("mean_amount"),
        F.median("amount").alias("median_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"),
    )


def hour_histogram(tx: DataFrame) -> DataFrame:
    """user_id, hours: 24 counts."""
    per = tx.where("ts IS NOT NULL").groupBy("user_id", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    counts = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    return counts.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0).cast("long"))).alias("hours"))


def top_values(tx: DataFrame, value: str, k: int = TOP) -> DataFrame:
    """user_id, top: the k most frequent values, ties to the smaller."""
    per = tx.where(F.col(value).isNotNull()).groupBy("user_id", value).agg(F.count("*").alias("n"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), value))).where(F.col("r") <= k)
    return ranked.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias("top"))


def known_values(tx: DataFrame, value: str, out: str) -> DataFrame:
    """user_id, sorted distinct values."""
    return tx.groupBy("user_id").agg(F.array_sort(F.collect_set(value)).alias(out))


def daily_frequency(tx: DataFrame) -> DataFrame:
    """user_id, avg_daily_frequency: transactions over the days from first to last, both included."""
    days = F.date_diff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1
    return tx.groupBy("user_id").agg((F.count("*") / days).alias("avg_daily_frequency"))


def build_profiles(tx: DataFrame) -> DataFrame:
    """All of it. tx has user_id, ts, amount, merchant_id, device_id, location_id; rows without an amount are left out."""
    tx = tx.where("amount IS NOT NULL").repartition("user_id")
    out = amount_stats(tx).join(hour_histogram(tx).withColumnRenamed("hours", "hour_histogram"), "user_id", "left")
    out = out.join(top_values(tx, "merchant_id").withColumnRenamed("top", "top_merchants"), "user_id", "left")
    for value, name in (("device_id", "known_devices"), ("location_id", "known_locations")):
        out = out.join(known_values(tx, value, name), "user_id", "left")
    return out.join(daily_frequency(tx), "user_id", "left")


def usual_hours(hours: Column) -> Column:
    """The twelve hours with most transactions, ties to the earlier; hours without any are not usual."""
    ranked = F.array_sort(F.transform(hours, lambda n, h: F.struct((-n).alias("minus"), h.alias("h"))))
    return F.transform(F.filter(F.slice(ranked, 1, USUAL_HOURS), lambda x: x["minus"] < 0), lambda x: x["h"])


def score_transactions(tx: DataFrame, profiles: DataFrame, daily_count: str | None = None) -> DataFrame:
    """Adds z_score and five flags. Without daily_count the user's transactions of the day are counted."""
    if daily_count is None:
        tx, daily_count = tx.withColumn("daily_count", F.count("*").over(Window.partitionBy("user_id", F.to_date("ts")))), "daily_count"
    known = F.col("n_transactions").isNotNull()
    z = F.when(F.col("std_amount") > 0, S.finite((F.col("amount") - F.col("mean_amount")) / F.col("std_amount")))
    absent = lambda value, where: F.coalesce(~F.array_contains(where, F.col(value)), F.lit(True))
    joined = tx.join(profiles, "user_id", "left")
    return joined.select(
        *tx.columns,
        F.when(known, F.coalesce(z, F.lit(0.0))).otherwise(0.0).alias("z_score"),
        S.flag(~known | F.when(F.col("ts").isNull(), False).otherwise(absent_hour(F.col("hour_histogram"), F.hour("ts")))).alias("is_unusual_hour"),
        S.flag(~known | F.when(F.col("merchant_id").isNull(), False).otherwise(absent("merchant_id", F.col("top_merchants")))).alias("is_new_merchant"),
        S.flag(~known | F.when(F.col("device_id").isNull(), False).otherwise(absent("device_id", F.col("known_devices")))).alias("is_new_device"),
        S.flag(~known | F.when(F.col("location_id").isNull(), False).otherwise(absent("location_id", F.col("known_locations")))).alias("is_new_location"),
        S.flag(known & (F.col(daily_count) > 2 * F.col("avg_daily_frequency"))).alias("frequency_anomaly"),
    )


def absent_hour(hours: Column, hour: Column) -> Column:
    return F.coalesce(~F.array_contains(usual_hours(hours), hour), F.lit(True))
