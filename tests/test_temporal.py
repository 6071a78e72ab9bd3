"""Joins in time and segmented history, against plain recomputation and against the windows that they stand for."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweft.functions import windows as W
from riskweft.operators import temporal as T
from riskweft.scratch import in_ranges

BEGIN = dt.datetime(2024, 1, 1)


def made(spark, n, keys, seed, span=4000, partitions=6):
    """Rows with ties in time, gaps, null keys and one key with most of the rows; partitions are not joined again."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice([0] * 6 + [*range(1, keys), None])
        ts = None if r.random() < 0.03 else BEGIN + dt.timedelta(seconds=r.randint(0, span))
        rows.append((i, k, ts, None if r.random() < 0.05 else round(r.uniform(1, 50), 2), r.choice([None, "a", "b", "c", f"v{i % 40}"])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return rows, spark.createDataFrame(rows, "id long, k long, ts timestamp, amount double, v string").repartition(partitions)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("exact", "tolerance"), [(True, None), (False, None), (True, 60), (False, 60)])
def test_asof(spark, exact, tolerance):
    left, l = made(spark, 400, 4, 1)
    right, r = made(spark, 150, 5, 2)
    got = T.asof_join(l, r.select("k", F.col("ts").alias("at"), F.col("id").alias("found"), F.col("v").alias("value")), ["k"], "ts", "at", ["found", "value"], "found", exact, tolerance).collect()
    want = set()
    for i, k, ts, a, v in left:
        before = [x for x in right if k is not None and ts is not None and x[1] == k and x[2] is not None and (x[2] <= ts if exact else x[2] < ts)]
        last = max(before, key=lambda x: (x[2], x[0]), default=None)
        if last and tolerance is not None and (ts - last[2]).total_seconds() > tolerance:
            last = None
        want.add((i, k, ts, a, v, last and last[0], last and last[4]))
    assert len(got) == len(left) and {tuple(x) for x in got} == want and any(w[5] is None for w in want)


def test_asof_without_rows(spark):
    rows, l = made(spark, 30, 3, 3)
    none = l.limit(0).select("k", F.col("ts").alias("at"), F.col("v").alias("value"))
    assert {tuple(x) for x in T.asof_join(l, none, ["k"], "ts", "at", ["value"]).collect()} == {(*r, None) for r in rows}
    assert T.asof_join(l.limit(0), l.select("k", F.col("ts").alias("at"), F.col("v").alias("value")), ["k"], "ts", "at", ["value"]).count() == 0


@pytest.mark.parametrize(("before", "after"), [(60, 0), (0, 30), (300, 120), (0, 0)])
def test_interval_join(spark, before, after):
    left, l = made(spark, 120, 3, 4)
    right, r = made(spark, 150, 4, 5)
    got = T.interval_join(l.select("id", "k", "ts"), r.select(F.col("id").alias("other"), "k", F.col("ts").alias("at")), ["k"], "ts", "at", before, after).select("id", "other").collect()
    near = lambda a, b: a[1] is not None and a[1] == b[1] and a[2] and b[2] and -before <= (b[2] - a[2]).total_seconds() <= after
    assert sorted(map(tuple, got)) == sorted((a[0], b[0]) for a in left for b in right if near(a, b))


def test_prior_equals_windows(spark):
    """Counts, sums, moments and distinct values: as windows by key, from segments."""
    _, df = made(spark, 900, 4, 6)
    df = df.where("ts IS NOT NULL")
    w = W.prior(["k"], ["ts", "id"])
    want = W.with_prior_distinct(df, ["k"], ["ts", "id"], {"d": "v"}).select("id", W.prior_count(w).cast("int").alias("n"), W.prior_sum("amount", w).alias("s"), W.prior_mean("amount", w).alias("m"), W.prior_std("amount", w).alias("sd"), "d")
    got = T.with_prior(df, ["k"], ["ts", "id"], "amount", distinct={"d": "v"}).select("id", "prior_tx_count", "prior_total_amount", "prior_mean_amount", "prior_std_amount", "d")
    want, got = ({r[0]: tuple(r[1:]) for r in x.collect()} for x in (want, got))
    assert set(got) == set(want)
    for i, x in want.items():
        assert got[i][0] == x[0] and got[i][4] == x[4]
        assert got[i][1:4] == pytest.approx(x[1:4], abs=1e-6) or [a is None for a in got[i][1:4]] == [a is None for a in x[1:4]]


def test_deviation_of_far_amounts(spark):
    """Amounts that differ little and lie far from zero: their deviation keeps its digits over segments."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(3000).select("id", F.lit(1).alias("k"), (F.lit(1e9) + F.col("id") % 7).alias("amount")).repartition(5)
    got = T.with_prior(df, ["k"], ["id"], "amount").where("id = 2999").first()
    x = [1e9 + i % 7 for i in range(2999)]
    mean = sum(i % 7 for i in range(2999)) / 2999
    assert got["prior_std_amount"] == pytest.approx((sum((i % 7 - mean) ** 2 for i in range(2999)) / 2999) ** 0.5, rel=1e-9) and got["prior_total_amount"] == sum(x)


def test_previous_row(spark):
    rows, df = made(spark, 500, 4, 8)
    got = {r["id"]: (r["p"], r["pv"]) for r in T.with_previous(df, ["k"], ["ts", "id"], {"p": "id", "pv": "v"}).collect()}
    key = lambda x: (x[2] is not None, x[2] or BEGIN, x[0])
    for i, k, *rest in rows:
        before = [x for x in rows if x[1] == k and key(x) < key((i, k, *rest))]
        last = max(before, key=key, default=None)
        assert got[i] == ((last[0], last[4]) if last else (None, None))


def test_trailing_equals_windows(spark):
    _, df = made(spark, 700, 4, 7)
    df = df.where("ts IS NOT NULL AND k IS NOT NULL AND amount IS NOT NULL")
    high = F.col("amount") > 25
    rows = df.withColumn("us", W.micros("ts"))
    want = rows.select("id", W.trailing_count(["k"], "us", "id", 60).alias("a"), W.trailing_count(["k"], "us", "id", 600).alias("b"), W.trailing_sum(["k"], "us", "id", 600, "amount").alias("c"), W.trailing_count(["k"], "us", "id", 600, high).alias("d"))
    got = T.with_trailing(df, ["k"], "ts", "id", {"a": (60, None), "b": (600, None), "c": (600, "amount"), "d": (600, high)})
    assert got.columns == [*df.columns, "a", "b", "c", "d"]
    assert sorted(map(tuple, got.select("id", "a", "b", "c", "d").collect())) == sorted(map(tuple, want.collect()))


def test_a_hot_key_is_many_tasks(spark):
    """A key with nearly all rows is cut into segments of about the same size, none of which holds more than its share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).select("id", F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).alias("k"), (F.lit(BEGIN).cast("timestamp") + F.make_interval(secs=F.col("id") % 5000)).alias("ts"), F.lit(1.0).alias("amount"))
    sizes = [r["count"] for r in in_ranges(df, ["k", "ts", "id"], "sizes").groupBy("__p").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    got = T.with_prior(df, ["k"], ["ts", "id"], "amount").where("k = 0").agg(F.max("prior_tx_count"), F.count_distinct("prior_tx_count")).first()
    n = df.where("k = 0").count()
    assert tuple(got) == (n - 1, n)
    assert T.with_trailing(df, ["k"], "ts", "id", {"n": (10, None)}).agg(F.max("n")).first()[0] == df.where("k = 0").withColumn("n", F.count("*").over(Window.orderBy(F.unix_seconds("ts")).rangeBetween(-9, 0))).agg(F.max("n")).first()[0] - 1
