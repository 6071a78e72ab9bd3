"""Splits, scaling, imputation and descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.scratch import in_ranges


class SplitError(ValueError):
    """A split that can't be made."""


def hash_order(key: str, seed: int) -> Column:
    """Text by which keys stand in a random order that any engine with md5 can tell."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


#: Ranges of hashes that a group is ranked in.
RANGES = 4096


def hash_rank(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Adds __place, the rank from 1 in the group by a hash of the key, and __size, the rows of the group.

    Rows are ranked in ranges of the hash, which are counted and prefixed, so no task sorts a whole group. The number of
    ranges is fixed, so rows meet the figures of their group by group and range only: joined by group alone, a group
    would go to one task.
    """
    d = df.withColumn("__h", hash_order(key, seed))
    share = F.conv(F.substring("__h", 1, 12), 16, 10).cast("double") / float(2**48)
    d = d.withColumn("__b", F.floor(share * RANGES))
    per = d.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(group)  # over ranges, not rows
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col(group).alias("__g"), F.col("__b").alias("__gb"), before.alias("__before"), F.sum("__n").over(whole).alias("__size"))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", key)))
    d = d.join(per, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__gb")))
    return d.select(*df.columns, (F.col("__before") + F.col("__r")).alias("__place"), "__size")


def stratified_split(df: DataFrame, label: str, key: str, shares: Mapping[str, float] = {"train": 0.7, "val": 0.15, "test": 0.15}, seed: int = 42, min_class: int = 3) -> DataFrame:  # noqa: B006
    """Adds split: per class, exact quotas (rounded cumulatively) in the order of a hash of the key."""
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise SplitError("the shares must be positive and have sum 1")
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row a class
    if len(sizes) < 2 or min(sizes.values()) < min_class:
        raise SplitError(f"each of two classes or more needs {min_class} rows, there are {sizes}")
    out, done = F, 0.0
    names = list(shares)
    for name in names[:-1]:
        done += shares[name]
        out = out.when(F.col("__place") <= F.round(F.col("__size") * done), name)
    return hash_rank(df, label, key, seed).withColumn("split", out.otherwise(names[-1])).select(*df.columns, "split")


def tagged_sample(df: DataFrame, tag: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each tag in hash order; tags with fewer rows repeat theirs until there are n. Adds copy, from 0."""
    w = Window.partitionBy(tag).orderBy(hash_order(key, seed), key)
    first = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)  # limited before the shuffle, too
    sizes = first.groupBy(tag).agg(F.count("*").alias("__n"))
    full = first.join(sizes, tag).withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.lit(n) - F.col("__r")) / F.col("__n")).cast("int"))))
    return full.select(*df.columns, "copy")


def tagged_split(df: DataFrame, tag: str, key: str, seed: int = 42) -> DataFrame:
    """Adds split: 80/10/10 per tag, with at least one row for val and test if the tag has five."""
    tenth = F.floor(F.col("__size") * 0.1)
    part = F.when(F.col("__size") >= 5, F.greatest(F.lit(1), tenth)).otherwise(tenth)
    split = F.when(F.col("__place") <= part, "val").when(F.col("__place") <= 2 * part, "test").otherwise("train")
    return hash_rank(df, tag, key, seed).withColumn("split", split).select(*df.columns, "split")


def ordered_split(df: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Adds split: the first share of the rows in order is train, the rest test. Ranks come from range counts."""
    ranked = with_rank(df, order, total="__n")
    return ranked.withColumn("split", F.when(F.col("__rank") <= F.floor(F.col("__n") * share), "train").otherwise("test")).select(*df.columns, "split")


def with_rank(df: DataFrame, order: Sequence[str], out: str = "__rank", total: str | None = None) -> DataFrame:
    """Adds the global rank from 1 and, under the name total, the number of rows.

    The rows are dealt into ranges of the order and written with their range; ranges are counted and prefixed, ranks
    made within them. Ranks of rows that are equal in the order are any of theirs, so the order should name a row.
    """
    rows = in_ranges(df, list(order), "ranks")
    every = Window.partitionBy(F.lit(0))  # over ranges, not rows
    per = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(every.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("__p").alias("__q"), before.alias("__before"), F.sum("__c").over(every).alias("__total"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    ranked = rows.withColumn("__in", within).join(per, F.col("__p") == F.col("__q"))
    return ranked.select(*df.columns, (F.col("__before") + F.col("__in")).alias(out), *([F.col("__total").alias(total)] if total else []))


@dataclass
class Scaler:
    """Mean and population deviation of columns; fitted on training rows only."""

    columns: Sequence[str]
    params: dict[str, tuple[float, float]] | None = None

    def params_frame(self, df: DataFrame) -> DataFrame:
        """(column, mean, std)."""
        one = df.agg(*[x for c in self.columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("std")) for c in self.columns])).alias("x")).select("x.*")

    def fit(self, df: DataFrame) -> Scaler:
        self.params = {r["column"]: (r["mean"], r["std"]) for r in self.params_frame(df).collect()}  # a row a column
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Constant columns are only centred."""
        if self.params is None:
            raise RuntimeError("the scaler is not fitted")
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in self.params.items()})


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: str | None = None) -> DataFrame:
    """(by, column, share, value): exact quantiles of the finite values of columns, interpolated between neighbours.

    Values are counted by value, the counts dealt into ranges and prefixed, and only the ranges that hold a wanted place
    are run through, so no task holds a whole column. by is null if no groups are asked for.
    """
    group = (F.col(by) if by else F.lit(None).cast("string")).alias("__g")
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), S.finite(c).cast("double").alias("__v")) for i, c in enumerate(columns)]))
    long = df.select(group, entries.alias("__x")).select("__g", "__x.*").where("__v IS NOT NULL")
    counts = in_ranges(long.groupBy("__g", "__c", "__v").agg(F.count("*").alias("__n")), ["__g", "__c", "__v"], "quantiles")
    whole = Window.partitionBy("__g", "__c")
    ranges = counts.groupBy("__g", "__c", "__p").agg(F.sum("__n").alias("__m"))
    ranges = ranges.withColumns({"__before": F.coalesce(F.sum("__m").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__total": F.sum("__m").over(whole)})
    place = F.col("__share") * (F.col("__total") - 1)
    wanted = ranges.withColumn("__share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).withColumns({"__low": F.floor(place), "__rest": place - F.floor(place)})
    end = F.col("__before") + F.col("__m")
    wanted = wanted.where((F.col("__low") < end) & (F.col("__low") + 1 >= F.col("__before")))  # the range that holds the place, and the next if that holds the neighbour
    wanted = wanted.select(F.col("__g").alias("__wg"), F.col("__c").alias("__wc"), F.col("__p").alias("__wp"), "__share", "__before", "__low", "__rest")
    some = counts.join(wanted.select("__wg", "__wc", "__wp").distinct(), F.col("__g").eqNullSafe(F.col("__wg")) & (F.col("__c") == F.col("__wc")) & (F.col("__p") == F.col("__wp")), "left_semi")
    upto = F.sum("__n").over(Window.partitionBy("__g", "__c", "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    run = some.withColumn("__upto", upto).join(wanted, F.col("__g").eqNullSafe(F.col("__wg")) & (F.col("__c") == F.col("__wc")) & (F.col("__p") == F.col("__wp")))
    last = F.col("__before") + F.col("__upto")
    holds = lambda at: (at >= last - F.col("__n")) & (at < last)
    run = run.withColumns({"__a": F.when(holds(F.col("__low")), F.col("__v")), "__b": F.when(holds(F.col("__low") + 1), F.col("__v"))})
    found = run.groupBy("__g", "__c", "__share").agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"), F.max("__rest").alias("__rest"))
    value = F.col("__a") + F.when(F.col("__rest") > 0, F.col("__rest") * (F.col("__b") - F.col("__a"))).otherwise(0.0)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__c") + 1)
    return found.select(F.col("__g").alias(by or "by"), name.alias("column"), F.col("__share").alias("share"), value.alias("value"))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the finite values; 0 where there are none."""
    found = {r["column"]: r["value"] for r in quantiles(df, columns, [0.5]).collect()}  # a row a column
    return {c: float(found.get(c, 0.0)) for c in columns}


def impute(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Replaces nulls, NaN and infinities."""
    return df.withColumns({c: F.coalesce(S.finite(c), F.lit(float(v))) for c, v in values.items()})


def boxplot(df: DataFrame, column: str, by: str) -> DataFrame:
    """Five-number summary per class."""
    names = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    of = lambda x: F.max(F.when(F.col("share") == x, F.col("value")))
    return quantiles(df, [column], list(names.values()), by).groupBy(by).agg(*[of(x).alias(n) for n, x in names.items()])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal widths; the last bin holds the upper end; values outside are left out."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
