"""Breakdowns on several levels at once: grouping sets, rollups, cubes and pivots.

All levels come from one pass: a row is expanded to the sets before the partial aggregation, so what is shuffled is a row
for each group and task, whatever the number of levels. `level` tells the sets apart, also where a value is itself null: it
is the grouping id, a bit for each column in their order, set where the column is summed over. An empty table has no
groups on any level, not even a total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sets that one row is expanded to, at most.
MOST_SETS = 64


def grouping_sets(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], figures: Mapping[str, Column]) -> DataFrame:
    """(columns, level, figures) for each set of columns; columns outside the set are null."""
    if odd := {c for s in sets for c in s} - set(columns):
        raise ValueError(f"not among the columns: {sorted(odd)}")
    if len(sets) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets")
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id(*columns).alias("level"), *[f.alias(n) for n, f in figures.items()])


def rollup(df: DataFrame, columns: Sequence[str], figures: Mapping[str, Column]) -> DataFrame:
    """Totals, then totals by ever more of the columns."""
    return grouping_sets(df, columns, [columns[:n] for n in range(len(columns) + 1)], figures)


def cube(df: DataFrame, columns: Sequence[str], figures: Mapping[str, Column]) -> DataFrame:
    """By every subset of the columns."""
    return grouping_sets(df, columns, [[c for i, c in enumerate(columns) if n >> i & 1] for n in range(1 << len(columns))], figures)


def pivot(df: DataFrame, rows: Sequence[str], across: str, values: Sequence[str | int], figure: Column, other: str | None = None) -> DataFrame:
    """(rows, a column for each of the values): the figure where `across` has it, null where it never does. The values are
    given, so the table isn't read to find them; other names a column for all further values and null."""
    given = F.col(across)
    if other is not None:
        given = F.when(given.isin(*values), given.cast("string")).otherwise(other)
        values = [*map(str, values), other]
    return df.withColumn("__across", given).groupBy(*rows).pivot("__across", list(values)).agg(figure)
