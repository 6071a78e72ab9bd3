"""Stored profiles against one pass over all payments; sketches against exact figures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskweft.operators import incremental as I
from riskweft.operators.profiles import build_profiles


@pytest.fixture(scope="module")
def payments(spark):
    r = random.Random(4)
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice([1, 1, 1, 2, 3, 4]), begin + dt.timedelta(seconds=r.randint(0, 6 * 86_400 - 1)), r.choice([None, 1e9 + r.random(), round(r.uniform(1, 500), 2), 7.25]), r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, *range(9)]), r.choice([None, 7, 8])) for i in range(500)]
    rows.append((900, 9, begin, 5.0, None, None, None))
    return spark.createDataFrame(rows, "txn_id long, user_id long, ts timestamp, amount double, merchant_id long, device_id long, location_id long")


def rows_of(profiles):
    def plain(x):
        return None if x is None else tuple(x) if isinstance(x, list) else x

    return {r["user_id"]: {k: plain(v) for k, v in r.asDict().items()} for r in profiles.collect()}


def same(got, want):
    assert set(got) == set(want)
    for user, row in want.items():
        for name, x in row.items():
            y = got[user][name]
            assert y == pytest.approx(x, rel=1e-9, abs=1e-6) if isinstance(x, float) else (y or None) == (x or None), (user, name, x, y)


def test_days_one_by_one(spark, payments, tmp_path):
    """Equal to one pass after every day; a day added again changes nothing; compaction neither."""
    store = I.ProfileStore(spark, f"file://{tmp_path}/states")
    assert store.profiles().count() == 0
    for n in range(6):
        day = dt.date(2024, 1, 1 + n)
        for _ in range(2 if n in (0, 3) else 1):
            store.add(payments.where(F.to_date("ts") == F.lit(day)))
        if n == 2:
            before = rows_of(store.profiles())
            store.compact("2024-01-02")
            assert sorted(p.name for p in (tmp_path / "states" / "counts").iterdir() if p.is_dir()) == ["day=2024-01-02", "day=2024-01-03"]
            same(rows_of(store.profiles()), before)
        if n in (2, 5):
            same(rows_of(store.profiles()), rows_of(build_profiles(payments.where(F.to_date("ts") <= F.lit(day)))))


def test_a_corrected_day_replaces_itself(spark, payments, tmp_path):
    store = I.ProfileStore(spark, f"file://{tmp_path}/states")
    store.add(payments)  # all days at once
    day = dt.date(2024, 1, 4)
    corrected = payments.withColumn("amount", F.when(F.to_date("ts") == F.lit(day), F.col("amount") + 1).otherwise(F.col("amount")))
    store.add(corrected.where(F.to_date("ts") == F.lit(day)))
    same(rows_of(store.profiles()), rows_of(build_profiles(corrected)))


def test_sketches_of_days_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 17).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(9000))).alias("v"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(100_000)).cast("double").alias("x"))
    days = I.daily_sketches(df, ["g"], "ts", "v", "x")
    assert days.count() > 30
    quantiles = (0.05, 0.5, 0.95)
    got = {r["g"]: r for r in I.from_sketches(days, ["g"], quantiles).collect()}
    exact = {r["g"]: (r["n"], r["d"]) for r in df.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).collect()}
    for g, (n, d) in exact.items():
        assert got[g]["n"] == n and abs(got[g]["distinct_estimate"] - d) <= I.DISTINCT_ERROR * d
        for p, q in zip(quantiles, got[g]["quantiles"], strict=True):
            assert abs(df.where((F.col("g") == g) & (F.col("x") <= q)).count() / n - p) <= I.RANK_ERROR
