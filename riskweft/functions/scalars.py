"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Order of the risk bands.
RISK_BANDS = {"low": 0, "medium": 1, "high": 2}
CHANNELS = ("online", "pos", "atm", "mobile")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """0 or 1; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def safe_div(a: Column | str, b: Column | str, fill: float | None = 0.0) -> Column:
    out = F.try_divide(col(a), col(b))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def finite(x: Column | str) -> Column:
    """The value, or null for NaN and infinities."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def one_hot(value: str, choices: Sequence[str], prefix: str = "is_") -> dict[str, Column]:
    return {f"{prefix}{c}": flag(F.col(value) == c) for c in choices}


def ordinal(value: Column | str, order: Mapping[str, int] = RISK_BANDS, default: int = 0) -> Column:
    x, out = col(value), F
    for name, rank in order.items():
        out = out.when(x == name, rank)
    return out.otherwise(default).cast("int")


def hour_of_day(ts: Column | str) -> Column:
    return F.hour(col(ts)).cast("int")


def day_of_week(ts: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(col(ts)).cast("int")


def off_hours(hour: Column | str) -> Column:
    return flag((col(hour) >= 2) & (col(hour) < 5))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def node_id(prefix: str, key: Column | str) -> Column:
    return F.concat_ws(":", F.lit(prefix), col(key).cast("string"))


def mapped(value: Column | str, choices: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """Lookup in a small fixed mapping."""
    x, out = col(value), F
    for name, to in choices.items():
        out = out.when(x == name, F.lit(to))
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first non-null of those columns that the frame has; null if it has none."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))


def amount_of(df: DataFrame) -> Column:
    """amount, under its aliases, else from its logarithm, else 0."""
    given = first_of(df, "amount", "amount_x", "amount_y")
    return F.coalesce(given, F.expm1(F.col("amount_log")) if "amount_log" in df.columns else F.lit(None), F.lit(0.0)).cast("double")


def fixed(x: Column, digits: int) -> Column:
    """Number as text with a fixed number of digits, rounded half up; what is a billionth short of a half counts as one."""
    x = x.cast("double")
    return F.format_string(f"%.{digits}f", x + F.signum(x) * 1e-9)
