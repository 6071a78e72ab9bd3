"""Classifier registry, fitting, prediction and persistence: linear models of spark.ml, and boosted trees."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweft.functions.scalars import sigmoid
from riskweft.ml import boosting
from riskweft.ml.boosting import BoostedTrees, Boosting, Params
from riskweft.operators import metrics, prepare
from riskweft.schema import required
from riskweft.scratch import kept
from riskweft.sources import writers
from riskweft.sources.readers import exists


def logistic(n_rows: int = 1, c: float = 1.0, **params: Any) -> Estimator:
    """Inverse regularisation c as for a sum of losses; spark.ml means them, so the strength is 1 / (c n)."""
    return LogisticRegression(**({"maxIter": 1000, "regParam": 1 / (c * max(1, n_rows)), "elasticNetParam": 0.0, "standardization": False} | params))


def boosted(params: Params) -> Callable[..., Boosting]:
    """A builder of boosted trees with these defaults; `block` and the fields of Params may be given instead."""

    def build_one(n_rows: int = 1, block: int = boosting.BLOCK, **given: Any) -> Boosting:
        if odd := set(given) - {f.name for f in fields(Params)}:
            raise TypeError(f"unknown parameters: {sorted(odd)}")
        return Boosting(replace(params, **given), block)

    return build_one


#: The parameters of the boosted models.
REGISTRY: dict[str, Callable[..., Any]] = {
    "logreg": logistic,
    "xgboost": boosted(Params()),
    "lightgbm": boosted(Params(max_depth=0, max_leaves=31, min_rows=20, min_weight=1e-3, l2=0.0, stop_after=50)),
    "fusion_gb": boosted(Params(trees=30, rate=0.15, max_depth=4)),
}


def build(name: str, n_rows: int = 1, **overrides: Any) -> Any:
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](n_rows, **overrides)


def fit(df: DataFrame, columns: Sequence[str], label: str, name: str = "xgboost", validation: str | None = None, **overrides: Any) -> PipelineModel | BoostedTrees:
    """A fitted model; columns must be free of nulls. Rows where validation is true are not fitted on, but may stop boosting."""
    train = df if validation is None else df.where(~F.coalesce(F.col(validation), F.lit(False)))
    estimator = build(name, train.count() if name == "logreg" else 1, **overrides)
    if isinstance(estimator, Boosting):
        return estimator.fit(df, columns, label, validation)
    stages = [VectorAssembler(inputCols=list(columns), outputCol="__features"), estimator.setLabelCol(label).setFeaturesCol("__features")]
    return Pipeline(stages=stages).fit(train)


def predict_proba(model: PipelineModel | BoostedTrees, df: DataFrame, out: str = "probability") -> DataFrame:
    """Adds the probability of class 1; for models that give margins only, their sigmoid."""
    if isinstance(model, BoostedTrees):
        return model.transform(df, "__p").select(*df.columns, F.col("__p").alias(out))
    scored = model.transform(df)
    if "probability" in scored.columns and "probability" not in df.columns:
        p = vector_to_array("probability")[1]
    else:
        p = sigmoid(vector_to_array("rawPrediction")[1])
    return scored.withColumn("__p", p).select(*df.columns, F.col("__p").alias(out))


def save(spark: SparkSession, model: Any, path: str) -> None:
    boosting.save(spark, model, path) if isinstance(model, BoostedTrees) else model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | BoostedTrees:
    """The model at path, whichever kind it is; TypeError for anything else."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if exists(spark, f"{path}/trees.json"):
        return boosting.load(spark, path)
    if exists(spark, f"{path}/metadata"):
        return PipelineModel.load(path)
    raise TypeError(f"{path} holds no model")


class Predictor:
    """A fitted model with its columns, threshold and, if there is one, scaler; predicts 1 from the threshold on."""

    def __init__(self, model: PipelineModel | BoostedTrees, columns: Sequence[str], threshold: float = 0.5, scaler: prepare.Scaler | None = None):
        if not isinstance(model, PipelineModel | BoostedTrees):
            raise TypeError(f"no model: {type(model).__name__}")
        self.model, self.columns, self.threshold, self.scaler = model, list(columns), threshold, scaler

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: Sequence[str], threshold: float = 0.5, scaler: Mapping[str, Sequence[float]] | None = None) -> Predictor:
        scaled = prepare.Scaler(list(scaler), {c: tuple(v) for c, v in scaler.items()}) if scaler else None
        return cls(load(spark, path), columns, threshold, scaled)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds fraud_probability and prediction to the rows as they were given."""
        required(df, self.columns)
        if not self.scaler:
            scored = predict_proba(self.model, df, "fraud_probability")
        else:
            own = [c for c in self.scaler.columns if c in df.columns]
            given = df.withColumns({f"__given_{c}": F.col(c) for c in own})
            scored = predict_proba(self.model, self.scaler.transform(given), "fraud_probability").withColumns({c: F.col(f"__given_{c}") for c in own}).drop(*[f"__given_{c}" for c in own])
        return scored.withColumn("prediction", (F.col("fraud_probability") >= self.threshold).cast("int"))

    def predict_record(self, spark: Any, record: dict[str, float]) -> dict[str, float]:
        if missing := [c for c in self.columns if c not in record]:
            raise ValueError(f"missing inputs: {missing}")
        row = spark.createDataFrame([tuple(float(record[c]) for c in self.columns)], self.columns)
        return self.predict(row).select("fraud_probability", "prediction").first().asDict()


@dataclass
class Trained:
    predictor: Predictor
    validation: dict[str, Any]
    test: dict[str, Any]
    seconds: float


def train(df: DataFrame, columns: Sequence[str], label: str, key: str, name: str = "xgboost", scale: Sequence[str] = (), target_fpr: float = 0.01, seed: int = 42, fill: bool = False, folder: str | None = None, **overrides: Any) -> Trained:
    """The whole course: split by class, fill gaps by the medians of the training rows (if so asked), scale by the training
    rows, fit, tune the threshold on the validation rows, evaluate these and the test rows at it, and, if a folder is
    given, export everything there. Nothing is learned from test rows."""
    split = kept(prepare.stratified_split(df, label, key, seed=seed), "split")
    if fill:
        split = prepare.impute(split, prepare.medians(split.where("split = 'train'"), list(columns)))
    scaler = prepare.Scaler(list(scale)).fit(split.where("split = 'train'")) if scale else None
    ready = scaler.transform(split) if scaler else split
    began = time.perf_counter()
    model = fit(ready.where("split <> 'test'").withColumn("__held", F.col("split") == "val"), columns, label, name, "__held", **overrides)
    seconds = time.perf_counter() - began
    scored = kept(predict_proba(model, ready, "__score").select(F.col(label).cast("int").alias("label"), F.col("__score").alias("score"), "split"), "scored")
    held, last = scored.where("split = 'val'"), scored.where("split = 'test'")
    threshold = float(metrics.tune_threshold(held, target_fpr).first()["threshold"])
    results = [metrics.evaluate(part, threshold, target_fpr).first().asDict() for part in (held, last)]  # a row each
    out = Trained(Predictor(model, columns, threshold, scaler), *results, seconds)
    if folder:
        params = {c: list(v) for c, v in scaler.params.items()} if scaler else {}
        writers.export_all(df.sparkSession, folder, model, params, threshold, list(columns), {f"{k}_{n}": v for k, r in (("val", results[0]), ("test", results[1])) for n, v in r.items()} | {"fit_seconds": seconds})
    return out
