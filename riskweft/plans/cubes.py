"""Breakdowns of payments by grouping sets, rollup, cube and pivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import cubes
from riskweft.operators import features as X
from riskweft.plans.sql import sql
from riskweft.sources.adapters import environment as env


def figures():
    return {"n": F.count("*"), "frauds": F.sum("label_fraud"), "amount": F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), 2)}


SQL_FIGURES = "count(*) AS n, sum(label_fraud)::BIGINT AS frauds, round(sum(amount::DECIMAL(18,2))::DOUBLE, 2) AS amount"
CHANNELS = ("online", "pos", "atm")


def _named(df, *names):
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in names], F.col("level").cast("long").alias("level"), *figures())


def _tx(s, d):
    e = env(s, d)
    return X.with_merchant(e["transactions"], e["merchants"])


def _text(by, clause):
    names = ", ".join(f"coalesce({c}::VARCHAR, '-') AS {c}" for c in by)
    return sql(f"SELECT {names}, GROUPING({', '.join(by)})::BIGINT AS level, {SQL_FIGURES} FROM tx LEFT JOIN merchants USING (merchant_id) GROUP BY {clause}")


QUERIES = {
    "grouping_sets": (
        lambda s, d: _named(cubes.grouping_sets(_tx(s, d), ["scenario_tag", "channel", "risk_band"], [["scenario_tag", "channel"], ["risk_band"], ["scenario_tag", "risk_band"], []], figures()), "scenario_tag", "channel", "risk_band"),
        _text(("scenario_tag", "channel", "risk_band"), "GROUPING SETS ((scenario_tag, channel), (risk_band), (scenario_tag, risk_band), ())"),
    ),
    "rollup_by_place": (lambda s, d: _named(cubes.rollup(_tx(s, d), ["location_id", "merchant_id"], figures()), "location_id", "merchant_id"), _text(("location_id", "merchant_id"), "ROLLUP (location_id, merchant_id)")),
    "cube_of_signals": (lambda s, d: _named(cubes.cube(_tx(s, d), ["channel", "status", "risk_band"], figures()), "channel", "status", "risk_band"), _text(("channel", "status", "risk_band"), "CUBE (channel, status, risk_band)")),
    "pivot_channels": (
        lambda s, d: cubes.pivot(_tx(s, d), ["account_id"], "channel", CHANNELS, F.count(F.lit(1)), "rest").select("account_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*CHANNELS, "rest")]),
        sql("SELECT account_id, " + ", ".join(f"count(*) FILTER (channel = '{c}') AS {c}" for c in CHANNELS) + f", count(*) FILTER (channel IS NULL OR channel NOT IN {CHANNELS}) AS rest FROM tx GROUP BY account_id"),
    ),
}
