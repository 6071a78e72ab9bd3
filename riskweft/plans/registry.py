"""All registered queries outside the optional subpackage: name to callable, and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweft.plans import catalog, cubes, evaluation, files, incremental, learning, relational, risk, temporal, textual, windows

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}
for module in (relational, cubes, windows, temporal, incremental, risk, evaluation, textual, files, learning, catalog):
    ALL.update(module.QUERIES)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}
