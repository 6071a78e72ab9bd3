"""Schemas of the seven payment tables and of the flat card table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def schema(text: str) -> StructType:
    """From `name kind, ...`, without a session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in text.split(","))])


TABLES: dict[str, StructType] = {
    name: schema(ddl)
    for name, ddl in {
        "users": "user_id long, signup_ts timestamp, home_country string, risk_segment string",
        "accounts": "account_id long, user_id long, opened_ts timestamp, account_type string, status string",
        "devices": "device_id long, device_type string, fingerprint_hash string, first_seen_ts timestamp",
        "merchants": "merchant_id long, name string, category string, mcc_code int, country string, risk_band string",
        "locations": "location_id long, city string, country string, region string, lat double, lon double",
        "account_devices": "account_id long, device_id long, first_used_ts timestamp, last_used_ts timestamp, is_primary boolean",
        "transactions": "txn_id long, account_id long, device_id long, merchant_id long, location_id long, ts timestamp, amount double, currency string, channel string, status string, label_fraud int, scenario_tag string, scenario_extra string",
    }.items()
}

#: Columns of the flat card table, in order.
FLAT_COLUMNS = ["Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class"]
FLAT = schema(", ".join(f"{c} {'int' if c == 'Class' else 'double'}" for c in FLAT_COLUMNS))


class SchemaError(ValueError):
    """A table lacks a column or holds values outside its contract."""


def validate(df: DataFrame, expected: list[str], target: str | None = "Class") -> list[str]:
    """Extra columns of df. Raises SchemaError for missing columns or a target with values besides 0, 1 and null."""
    if missing := [c for c in expected if c not in df.columns]:
        raise SchemaError(f"missing columns: {missing}")
    if target is not None:
        if target not in df.columns:
            raise SchemaError(f"missing target column: {target}")
        odd = df.where(F.col(target).isNotNull() & ~F.col(target).isin(0, 1)).limit(1)
        if odd.count():
            raise SchemaError(f"{target} holds values other than 0 and 1")
    return [c for c in df.columns if c not in expected]


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Just these columns, in this order; SchemaError if one is missing."""
    validate(df, columns, target=None)
    return df.select(*columns)


def tables(env: Mapping[str, DataFrame], *names: str) -> list[DataFrame]:
    """The named tables of an environment, any mapping of names to DataFrames."""
    if missing := [n for n in names if n not in env]:
        raise SchemaError(f"missing tables: {missing}")
    return [env[n] for n in names]
