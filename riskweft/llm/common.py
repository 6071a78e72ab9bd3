"""Shared pieces of the training-data operators: text columns, durable intermediate tables, binned prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweft.scratch import remove, scratch_path
from riskweft.session import ship  # noqa: F401

#: The six ASCII white-space characters, as a class of a Java or RE2 pattern and as a string.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


class Scratch:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table cuts the lineage: a lost executor costs its running tasks only.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, label), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Remove a table that nothing reads any more."""
        remove(self.spark, path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the runs of characters outside [\\x20\\x09-\\x0D]; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as long, 0 for null: starts of words, counted without making them."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def row_hash(*cols: Column) -> Column:
    """64-bit hash; the order of rows that it gives does not depend on the partitioning."""
    return F.xxhash64(*cols)


#: Bins that are prefixed in one task.
WIDE = 4096


def _before(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds out: sum of value over the rows of the group that come before this one."""
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(over), F.lit(0)))


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The join on keys that may be null, without the right ones."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]).drop(*[f"__r_{k}" for k in keys])


def prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], bin_col: str, value: str, out: str) -> DataFrame:
    """Adds out: sum of value over the rows of the group before this one, in order of (bin_col, *order).

    Three levels, so no task holds a whole group: bins are summed with map-side combining, runs of WIDE bins likewise;
    the runs of a group are prefixed, the bins within their run, and rows only within their bin. bin_col is a whole
    number that rises with the intended order.
    """
    bins = df.groupBy(*group, bin_col).agg(F.sum(value).alias("__in_bin")).withColumn("__run", F.floor(F.col(bin_col) / WIDE))
    runs = bins.groupBy(*group, "__run").agg(F.sum("__in_bin").alias("__in_run"))
    runs = _before(runs, group, ["__run"], "__in_run", "__runs_before").drop("__in_run")
    bins = _on(_before(bins, [*group, "__run"], [bin_col], "__in_bin", "__bins_before"), runs, [*group, "__run"])
    bins = bins.select(*group, bin_col, (F.col("__runs_before") + F.col("__bins_before")).alias("__bins_before"))
    rows = _on(_before(df, [*group, bin_col], order, value, "__in_bin_before"), bins, [*group, bin_col])
    return rows.withColumn(out, F.col("__bins_before") + F.col("__in_bin_before")).drop("__bins_before", "__in_bin_before")
