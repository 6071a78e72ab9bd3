"""Configurable rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweft.functions import scalars as S

#: Severities and their weights.
SEVERITY_WEIGHTS = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}

#: Thresholds, and other names under which they may be given.
DEFAULT_THRESHOLDS = {"high_velocity": 5, "burst_velocity": 8, "new_device_high_value_amount": 500, "unusual_amount_zscore": 3.0, "offhours_high_value_amount": 1000}
THRESHOLD_ALIASES = {
    "high_velocity": ["high_velocity_threshold", "vel_count_300s", "vel_count_300s_threshold"],
    "burst_velocity": ["burst_velocity_threshold", "burst_vel_threshold"],
    "new_device_high_value_amount": ["new_device_high_value", "new_device_amount", "amount_new_device_threshold", "high_value_threshold"],
    "unusual_amount_zscore": ["amount_zscore_threshold", "zscore_threshold", "zscore"],
    "offhours_high_value_amount": ["offhours_high_value_threshold", "offhours_amount", "offhours_threshold"],
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    description: str
    condition: Callable[[Callable[[str], Column]], Column]

    def __post_init__(self):
        if self.severity not in SEVERITY_WEIGHTS:
            raise ValueError(f"unknown severity: {self.severity}")


def thresholds(given: Mapping[str, float] | None = None) -> dict[str, float]:
    """The defaults with the given ones over them, under any of their names."""
    names = {alias: name for name, aliases in THRESHOLD_ALIASES.items() for alias in aliases}
    return DEFAULT_THRESHOLDS | {names.get(k, k): v for k, v in (given or {}).items()}


def default_rules(given: Mapping[str, float] | None = None) -> list[Rule]:
    t = thresholds(given)

    def unusual(get: Callable[[str], Column]) -> Column:
        z = get("amount_zscore").cast("double")
        return ~F.isnan(z) & (F.abs(z) > t["unusual_amount_zscore"])  # NaN would be greater than anything

    return [
        Rule("high_velocity", "medium", "Many transactions of the account within 300 seconds", lambda get: get("vel_count_300s") >= t["high_velocity"]),
        Rule("new_device_high_value", "high", "A large amount on a device new to the account", lambda get: (get("is_new_device") == 1) & (get("amount") > t["new_device_high_value_amount"])),
        Rule("unusual_location", "medium", "A country other than the holder's", lambda get: get("is_unusual_location") == 1),
        Rule("unusual_amount", "high", "An amount far from the holder's usual ones", unusual),
        Rule("shared_device", "medium", "A device that several accounts use", lambda get: get("device_is_shared") == 1),
        Rule("offhours_high_value", "high", "A large amount at night", lambda get: (get("is_offhours") == 1) & (get("amount") > t["offhours_high_value_amount"])),
        Rule("burst_velocity", "critical", "A burst of transactions within 300 seconds", lambda get: get("vel_count_300s") >= t["burst_velocity"]),
        Rule("new_device", "low", "A device new to the account", lambda get: get("is_new_device") == 1),
    ]


class RuleEngine:
    """Evaluates rules on a frame; absent columns and nulls count as 0."""

    def __init__(self, given: Mapping[str, float] | None = None, rules: Sequence[Rule] | None = None):
        self.rules = list(rules) if rules is not None else default_rules(given)

    def _getter(self, df: DataFrame) -> Callable[[str], Column]:
        def get(name: str) -> Column:
            if name == "amount":
                return S.amount_of(df)
            return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)

        return get

    def flags(self, df: DataFrame) -> dict[str, Column]:
        """Boolean column of each rule."""
        get = self._getter(df)
        return {r.rule_id: F.coalesce(r.condition(get), F.lit(False)) for r in self.rules}

    def evaluate(self, df: DataFrame, out: str = "rules") -> DataFrame:
        """Adds an array of all rules' results, in order."""
        flags = self.flags(df)
        return df.withColumn(out, F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), flags[r.rule_id].alias("triggered"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description")) for r in self.rules]))

    def triggered(self, df: DataFrame, out: str = "triggered_rules") -> DataFrame:
        """Adds the ids of the rules that fire, in order."""
        flags = self.flags(df)
        return df.withColumn(out, F.array_compact(F.array(*[F.when(flags[r.rule_id], F.lit(r.rule_id)) for r in self.rules])))

    def score(self, df: DataFrame) -> Column:
        """Weight of the rules that fire over the weight of all."""
        flags = self.flags(df)
        total = sum(SEVERITY_WEIGHTS[r.severity] for r in self.rules)
        if not total:
            return F.lit(0.0)
        fired = sum((F.when(flags[r.rule_id], SEVERITY_WEIGHTS[r.severity]).otherwise(0.0) for r in self.rules), F.lit(0.0))
        return fired / total
