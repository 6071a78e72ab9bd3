"""Profiles from stored states that a day's payments are merged into, and sketches kept by group and day.

A day becomes three small tables: moments of each user (count, mean, sum of squares about it, first and last day), counts
of each user's hours, merchants, devices, places and amounts, and nothing else. States merge without the payments: counts
add up, moments merge by the pairwise formula in order of the days. A day that is added again replaces itself, so a failed
or repeated load changes nothing, and `compact` makes one state of the days up to a date. Sets of values are rows, never
arrays, until a profile is asked for.

Sketches (distinct values by HyperLogLog, quantiles by KLL) are mergeable in the same way; sums of days are within the
error that their size promises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweft.operators.profiles import TOP
from riskweft.scratch import dealt, file_system, remove
from riskweft.sources.readers import exists

#: What is counted by user: kind to column; amounts are counted for their exact median.
COUNTED = {"merchant": "merchant_id", "device": "device_id", "location": "location_id"}
#: Counts of a task that makes profiles, about.
TASK_ROWS = 250_000
_MOMENTS = "user_id long, n long, mean double, square double, first date, last date, day date"
_COUNTS = "user_id long, kind string, value string, n long, day date"


def day_states(tx: DataFrame, counted: Mapping[str, str] = COUNTED) -> tuple[DataFrame, DataFrame]:
    """(moments, counts) of each user and day. tx has user_id, ts, amount and the counted columns; rows without an amount or a time are left out."""
    tx = tx.where("amount IS NOT NULL AND ts IS NOT NULL").withColumn("day", F.to_date("ts"))
    moments = tx.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.avg("amount").alias("mean"), (F.var_pop("amount") * F.count("*")).alias("square"))
    moments = moments.select("user_id", "n", "mean", "square", F.col("day").alias("first"), F.col("day").alias("last"), "day")
    values = F.array(
        F.struct(F.lit("hour").alias("kind"), F.hour("ts").cast("string").alias("value")),
        F.struct(F.lit("amount").alias("kind"), F.col("amount").cast("double").cast("string").alias("value")),
        *[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in counted.items()],
    )
    each = tx.select("user_id", "day", F.explode(values).alias("x")).select("user_id", "day", "x.*").where("value IS NOT NULL")
    return moments, each.groupBy("user_id", "kind", "value", "day").agg(F.count("*").alias("n")).select("user_id", "kind", "value", "n", "day")


def _pairwise(states: Column) -> Column:
    """One (n, mean, square) of an array of them, merged one by one."""

    def step(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["square"] + b["square"] + apart * apart * a["n"] * b["n"] / n).alias("square"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))
    return F.aggregate(states, none, step)


def merged_moments(moments: DataFrame) -> DataFrame:
    """One row a user: its states of all days, which are few, merged in their order."""
    parts = F.array_sort(F.collect_list(F.struct("day", "n", "mean", "square")))
    one = moments.groupBy("user_id").agg(_pairwise(parts).alias("m"), F.min("first").alias("first"), F.max("last").alias("last"))
    return one.select("user_id", "m.n", "m.mean", "m.square", "first", "last")


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("user_id", "kind", "value").agg(F.sum("n").alias("n"))


class ProfileStore:
    """States in a folder, by day."""

    def __init__(self, spark: SparkSession, folder: str, counted: Mapping[str, str] = COUNTED):
        self.spark, self.folder, self.counted = spark, folder.rstrip("/"), counted

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def add(self, tx: DataFrame) -> None:
        """The days of these payments, each whole, instead of what there was of them; other days stay.

        Small days share a task and large ones are split, so neither files nor tasks go by the number or size of the days.
        """
        for name, states in zip(("moments", "counts"), day_states(tx, self.counted), strict=True):
            writer = states.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day").parquet(f"{self.folder}/{name}")

    def moments(self) -> DataFrame:
        return self._read("moments", _MOMENTS)

    def counts(self) -> DataFrame:
        return self._read("counts", _COUNTS)

    def compact(self, upto: str) -> None:
        """One state of all days up to this one, under its name; they can't be added again by themselves then."""
        for name, merge, schema in (("moments", merged_moments, _MOMENTS), ("counts", merged_counts, _COUNTS)):
            states = self._read(name, schema).where(F.col("day") <= F.lit(upto).cast("date"))
            days = [r["day"] for r in states.select("day").distinct().collect()]  # folders
            if not days:
                continue
            beside = f"{self.folder}/_{name}"
            merge(states).write.mode("overwrite").parquet(beside)
            fs, made = file_system(self.spark, beside)
            for day in days:
                remove(self.spark, f"{self.folder}/{name}/day={day}")
            fs.rename(made, file_system(self.spark, f"{self.folder}/{name}/day={upto}")[1])

    def _by_user(self, states: DataFrame) -> DataFrame:
        return dealt(states, self.counts().count(), TASK_ROWS, "user_id")  # equal numbers, so the parts of a profile meet where they are

    def profiles(self) -> DataFrame:
        """What profiles.build_profiles gives of all payments."""
        moments, counts = merged_moments(self._by_user(self.moments())), merged_counts(self._by_user(self.counts()))
        of = lambda kind: counts.where(F.col("kind") == kind)
        hours = of("hour").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("value").cast("int"), "n"))).alias("m"))  # 24
        hours = hours.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0).cast("long"))).alias("hour_histogram"))
        top = of("merchant").withColumn("value", F.col("value").cast("long")).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "value"))).where(F.col("r") <= TOP)
        top = top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("top_merchants"))
        out = moments.select("user_id", F.col("n").alias("n_transactions"), F.col("mean").alias("mean_amount"), F.coalesce(F.sqrt(F.try_divide(F.col("square"), F.col("n") - 1)), F.lit(0.0)).alias("std_amount"), (F.col("n") / (F.date_diff("last", "first") + 1)).alias("avg_daily_frequency"))
        for part in (self._medians(of("amount")), hours, top):
            out = out.join(part, "user_id", "left")
        for kind in ("device", "location"):
            known = of(kind).groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("value").cast("long"))).alias(f"known_{kind}s"))
            out = out.join(known, "user_id", "left")
        lists = ["top_merchants", *[f"known_{kind}s" for kind in ("device", "location")]]
        return out.select("user_id", "n_transactions", "mean_amount", "median_amount", "std_amount", "hour_histogram", *lists, "avg_daily_frequency")

    @staticmethod
    def _medians(amounts: DataFrame) -> DataFrame:
        """Exact, from the counts of the amounts."""
        w = Window.partitionBy("user_id").orderBy("x")
        a = amounts.select("user_id", F.col("value").cast("double").alias("x"), "n").withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy("user_id"))})
        low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
        at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("x")))
        return a.groupBy("user_id").agg(((at(low) + at(high)) / 2).alias("median_amount"))


#: Size of the sketches as powers of two, and what they promise for it: relative deviation of a number of distinct values
#: at three standard errors, and error of a rank.
DISTINCT_BITS, QUANTILE_K = 14, 800
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2), 0.01


def daily_sketches(df: DataFrame, by: Sequence[str], ts: str, distinct: str, number: str) -> DataFrame:
    """(by, day, n, distinct_sketch, number_sketch): mergeable sketches of a column's distinct values and a number's quantiles."""
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, DISTINCT_BITS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(number).cast("double"), QUANTILE_K).alias("number_sketch"))


def from_sketches(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(by, n, distinct_estimate, quantiles array) of the days' sketches together."""
    one = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.collect_list("number_sketch").alias("q"))  # a sketch a day
    merged = F.aggregate(F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(1))), F.get("q", 0), lambda a, x: F.kll_sketch_merge_double(a, x))
    values = F.array(*[F.kll_sketch_get_quantile_double(F.col("s"), F.lit(float(p))) for p in quantiles])
    return one.withColumn("s", merged).select(*by, "n", F.hll_sketch_estimate("d").alias("distinct_estimate"), values.alias("quantiles"))
