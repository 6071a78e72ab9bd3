"""Windows over history: strictly prior rows, and trailing time ranges that tell ties apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

MICROS = 1_000_000


def prior(partition: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All rows before this one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def money(amount: Column | str) -> Column:
    """Exact decimal, so sums do not depend on their order."""
    return F.col(amount).cast("decimal(18,2)") if isinstance(amount, str) else amount.cast("decimal(18,2)")


def prior_count(w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(w)


def prior_sum(amount: str, w: WindowSpec) -> Column:
    return F.coalesce(F.sum(money(amount)).over(w).cast("double"), F.lit(0.0))


def prior_mean(amount: str, w: WindowSpec) -> Column:
    """Null for the first row."""
    return F.try_divide(F.sum(money(amount)).over(w).cast("double"), F.count(amount).over(w))


def prior_std(amount: str, w: WindowSpec) -> Column:
    """Population deviation; null with fewer than two prior rows."""
    return F.when(F.count(F.lit(1)).over(w) >= 2, F.stddev_pop(amount).over(w))


def with_prior_distinct(df: DataFrame, partition: Sequence[str], order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each (new column: value column), the number of distinct values on prior rows; nulls don't count.

    A row counts where its value occurs first; the count is then a running sum. One shuffle by the partition serves both
    windows, since rows of a (partition, value) share the partition.
    """
    for out, value in values.items():
        first = F.row_number().over(Window.partitionBy(*partition, value).orderBy(*order)) == 1
        df = df.withColumn(f"__first_{out}", (first & F.col(value).isNotNull()).cast("int"))
    w = prior(partition, order)
    return df.withColumns({out: F.coalesce(F.sum(f"__first_{out}").over(w), F.lit(0)).cast("int") for out in values}).drop(*[f"__first_{out}" for out in values])


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _range(partition: Sequence[str], us: str, seconds: int) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(us).rangeBetween(-(seconds * MICROS - 1), 0)


def _self_and_later_ties(partition: Sequence[str], us: str, tie: str) -> WindowSpec:
    return Window.partitionBy(*partition, us).orderBy(tie).rowsBetween(0, Window.unboundedFollowing)


def trailing_count(partition: Sequence[str], us: str, tie: str, seconds: int, where: Column | None = None) -> Column:
    """Rows before this one in order of (us, tie) and less than `seconds` back."""
    one = F.lit(1) if where is None else F.when(where, F.lit(1))
    return (F.count(one).over(_range(partition, us, seconds)) - F.count(one).over(_self_and_later_ties(partition, us, tie))).cast("int")


def trailing_sum(partition: Sequence[str], us: str, tie: str, seconds: int, amount: str) -> Column:
    """Sum of amount over the same rows."""
    total = F.sum(money(amount)).over(_range(partition, us, seconds)) - F.sum(money(amount)).over(_self_and_later_ties(partition, us, tie))
    return F.coalesce(total.cast("double"), F.lit(0.0))
