"""Textual evidence drawn from feature values alone, and the strongest entries of an attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweft.functions import scalars as S


def evidence_text(df: DataFrame) -> Column:
    """Array of snippets, in a fixed order; absent columns say nothing."""
    get = lambda c: S.finite(c) if c in df.columns else F.lit(None).cast("double")
    on = lambda c: F.coalesce(get(c) == 1, F.lit(False))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    whole = lambda c: get(c).cast("int").cast("string")
    log_amount, mean, z, log_ratio = get("amount_log"), get("prior_mean_amount"), get("amount_zscore"), get("amount_log_ratio")
    ratio = F.when((mean > 0) & (F.expm1(log_amount) > 0), F.try_divide(F.expm1(log_amount), mean))
    has_ratio = F.coalesce(ratio > 2, F.lit(False))
    burst = F.coalesce(get("vel_count_300s") >= 3, F.lit(False))
    distance = get("distance_to_prev_km")
    entries = [
        F.when(has_ratio, text("amount ", S.fixed(ratio, 1), "x above user mean")),
        F.when(z > 3, text("amount z-score ", S.fixed(z, 1), " well above user mean")).when(z > 2, text("amount z-score ", S.fixed(z, 1), " above user mean")).when(z < -2, text("amount z-score ", S.fixed(z, 1), " below user mean")),
        F.when((log_ratio > 1) & ~has_ratio & (F.exp(log_ratio) > 2), text("amount ", S.fixed(F.exp(log_ratio), 1), "x above user mean (log ratio ", S.fixed(log_ratio, 2), ")")),
        F.when(on("is_new_device"), F.lit("new device")),
        F.when(on("device_is_shared"), F.when(get("device_account_count") >= 2, text("shared device (used by ", whole("device_account_count"), " accounts)")).otherwise("shared device")),
        F.when(burst, text("velocity burst: ", whole("vel_count_300s"), " txns in 5min")),
        F.when(get("vel_count_3600s") >= 5, F.when(burst, text("also ", whole("vel_count_3600s"), " txns in 1h")).otherwise(text("high velocity: ", whole("vel_count_3600s"), " txns in 1h"))),
        F.when(get("vel_high_value_count_3600s") >= 2, text(whole("vel_high_value_count_3600s"), " high-value txns in 1h")),
        F.when(on("is_unusual_location"), F.lit("unusual location (outside home country)")),
        F.when(on("country_switch"), F.lit("country switch from previous transaction")),
        F.when(distance > 200, text("large distance to previous location: ", S.fixed(distance, 0), " km")).when(distance > 100, text("distance to previous location: ", S.fixed(distance, 0), " km")),
        F.when(on("is_high_value"), F.coalesce(text("high-value transaction (amount_log ", S.fixed(log_amount, 2), ")"), F.lit("high-value transaction"))),
        F.when(on("is_new_user"), F.lit("new user (few prior transactions)")),
        F.when(on("is_offhours"), F.coalesce(text("off-hours transaction (hour ", whole("hour"), ")"), F.lit("off-hours transaction"))),
        F.when(on("is_high_risk_merchant"), F.lit("high-risk merchant category")),
    ]
    return F.array_compact(F.array(*entries))


def top_evidence(df: DataFrame, columns: Sequence[str], k: int = 3, out: str = "top") -> DataFrame:
    """Adds the k (feature, value) with the largest absolute values, ties in column order."""
    rows = F.array(*[F.struct((-F.abs(S.finite(c))).alias("minus"), F.lit(i).alias("at"), F.lit(c).alias("feature"), S.finite(c).alias("value")) for i, c in enumerate(columns)])
    best = F.slice(F.array_sort(F.filter(rows, lambda x: x["value"].isNotNull())), 1, k)
    return df.withColumn(out, F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))))
