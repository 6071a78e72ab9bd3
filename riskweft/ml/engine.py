"""The fusion engine: models fitted on features, their scores fused with rules, behaviour and graph; saved as a folder."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweft.ml import models
from riskweft.ml.iforest import IsolationForest
from riskweft.operators import fusion, prepare
from riskweft.operators.features import feature_columns
from riskweft.operators.rules import RuleEngine
from riskweft.sources import writers


@dataclass
class FusionEngine:
    """Given models are used as they are; the others are fitted: boosted trees on all rows, an isolation forest on those
    without a label (on all if every row has one). Non-finite features are replaced by the medians of the fitted rows."""

    weights: Mapping[str, float] = field(default_factory=dict)
    levels: Mapping[str, float] = field(default_factory=dict)
    boosted_params: Mapping[str, Any] = field(default_factory=dict)
    forest_params: Mapping[str, Any] = field(default_factory=dict)
    model: Any = None
    forest: IsolationForest | None = None
    rules: RuleEngine = field(default_factory=RuleEngine)
    columns: Sequence[str] = ()
    medians: dict[str, float] = field(default_factory=dict)

    def _filled(self, frame: DataFrame) -> DataFrame:
        """The columns as doubles, without gaps, under names of their own beside the given ones."""
        filled = prepare.impute(frame.withColumns({f"__f_{c}": F.col(c).cast("double") for c in self.columns}), {f"__f_{c}": v for c, v in self.medians.items()})
        return filled

    def fit(self, frame: DataFrame, label: str = "label_fraud", key: str = "txn_id", columns: Sequence[str] | None = None) -> FusionEngine:
        """frame has the key, the label and the columns (by default the features that it has); it is read several times, so it should be written."""
        self.columns = list(columns or [c for c in feature_columns() if c in frame.columns])
        self.medians = prepare.medians(frame, self.columns)
        names = [f"__f_{c}" for c in self.columns]
        filled = self._filled(frame)
        if self.model is None:
            self.model = models.fit(filled, names, label, "fusion_gb", **self.boosted_params)
        if self.forest is None:
            legit = filled.where(F.col(label) == 0)
            self.forest = IsolationForest(names, **self.forest_params).fit(legit if legit.limit(1).count() else filled, key)
        return self

    def predict(self, frame: DataFrame) -> DataFrame:
        """The frame with both scores and everything that fuse adds."""
        if self.model is None or self.forest is None or not self.columns:
            raise RuntimeError("the engine is not fitted")
        scored = self.forest.transform(models.predict_proba(self.model, self._filled(frame), "xgb_score")).select(*frame.columns, "xgb_score", "anomaly_score")
        return fusion.fuse(scored, self.weights, self.levels, self.rules)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Everything but own rules, which are code."""
        models.save(spark, self.model, f"{folder}/model")
        state = {"weights": dict(self.weights), "levels": dict(self.levels), "columns": list(self.columns), "medians": self.medians, "forest": json.loads(self.forest.to_json())}
        writers.write_text(spark, f"{folder}/engine.json", json.dumps(state))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, rules: RuleEngine | None = None) -> FusionEngine:
        state = json.loads(writers.read_text(spark, f"{folder}/engine.json"))
        state["forest"] = IsolationForest.from_json(json.dumps(state["forest"]))
        return cls(model=models.load(spark, f"{folder}/model"), rules=rules or RuleEngine(), **state)
