import datetime as dt
import random

from pyspark.sql import functions as F

from riskweft.functions import windows as W


def test_ties_and_window_edge(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 299), (4, 1, 300)]
    df = spark.createDataFrame(rows, "txn_id long, account_id long, s long").withColumn("us", F.col("s") * 1_000_000).withColumn("amount", F.lit(1.5))
    out = df.select("txn_id", W.trailing_count(["account_id"], "us", "txn_id", 300).alias("n"), W.trailing_sum(["account_id"], "us", "txn_id", 300, "amount").alias("t"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0.0), (2, 1, 1.5), (3, 2, 3.0), (4, 1, 1.5)]


def test_history_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.randint(1, 4), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 4000)), round(r.uniform(1, 50), 2), r.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "txn_id long, k long, ts timestamp, amount double, v long").withColumn("us", W.micros("ts"))
    w = W.prior(["k"], ["ts", "txn_id"])
    out = W.with_prior_distinct(df, ["k"], ["ts", "txn_id"], {"d": "v"}).select("txn_id", W.prior_count(w).alias("n"), W.prior_sum("amount", w).alias("s"), W.prior_std("amount", w).alias("sd"), "d", W.trailing_count(["k"], "us", "txn_id", 600).alias("c"))
    got = {x["txn_id"]: x for x in out.collect()}
    for i, k, ts, _, _ in rows:
        before = [x for x in rows if x[1] == k and (x[2], x[0]) < (ts, i)]
        a = [x[3] for x in before]
        x = got[i]
        assert x["n"] == len(a) and abs(x["s"] - sum(a)) < 1e-6 and x["d"] == len({y[4] for y in before} - {None})
        assert x["c"] == sum((ts - y[2]).total_seconds() < 600 for y in before)
        if len(a) < 2:
            assert x["sd"] is None
        else:
            m = sum(a) / len(a)
            assert abs(x["sd"] - (sum((y - m) ** 2 for y in a) / len(a)) ** 0.5) < 1e-6
