"""Isolation forest (Liu, Ting and Zhou, 2008): trees from a bounded hashed sample, scores in Arrow batches."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweft.operators.prepare import impute, medians, quantiles
from riskweft.session import ship

EULER = 0.5772156649015329


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(x: np.ndarray, limit: int, random: np.random.Generator) -> list[list[float]]:
    """Nodes [feature, threshold, left, right, depth value]; leaves have feature -1."""
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + mean_path(len(rows))])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (None, None)
        if depth < limit and len(rows) > 1 and (open_ := np.flatnonzero(high > low)).size:
            f = int(random.choice(open_))
            t = float(random.uniform(low[f], high[f]))
            side = rows[:, f] <= t
            nodes[at] = [f, t, split(rows[side], depth + 1), split(rows[~side], depth + 1), 0.0]
        return at

    split(x, 0)
    return nodes


@dataclass
class IsolationForest:
    """Scores are scaled to [0, 1] by the range seen in training and clipped; a constant range gives 0.5."""

    columns: Sequence[str]
    trees: int = 100
    sample: int = 256
    contamination: float = 0.05
    seed: int = 42
    medians: dict[str, float] = field(default_factory=dict)
    forest: list[list[list[float]]] = field(default_factory=list)
    size: int = 0
    range: tuple[float, float] = (0.0, 0.0)
    offset: float = 0.0

    def fit(self, df: DataFrame, key: str) -> IsolationForest:
        """On rows taken to be legitimate; trees x sample rows go to the driver, at most."""
        self.medians = medians(df, self.columns)
        filled = impute(df, self.medians)
        rows = filled.orderBy(F.xxhash64(F.lit(self.seed), key), key).limit(self.trees * self.sample).select(*[F.col(c).cast("double") for c in self.columns]).toPandas().to_numpy(float)
        if not len(rows):
            raise ValueError("no rows to fit on")
        self.size = min(self.sample, len(rows))
        random, limit = np.random.default_rng(self.seed), math.ceil(math.log2(max(2, self.size)))
        self.forest = [grow(rows[random.choice(len(rows), self.size, replace=False)], limit, random) for _ in range(self.trees)]
        got = {r["share"]: r["value"] for r in quantiles(self._raw(filled), ["__raw"], [0.0, 1 - self.contamination, 1.0]).collect()}  # three rows
        self.range, self.offset = (got[0.0], got[1.0]), got[1 - self.contamination]
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        """Adds __raw = 2^(-mean depth / c(n)): larger is stranger. df is imputed."""
        if not self.forest:
            raise RuntimeError("the forest is not fitted")
        ship(df.sparkSession)
        columns, norm = list(self.columns), mean_path(self.size) or 1.0
        trees = [np.array(t) for t in self.forest]

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                x = np.column_stack([c.to_numpy(float) for c in cols])
                depth = np.zeros(len(x))
                for t in trees:
                    at = np.zeros(len(x), np.int64)
                    while (inner := np.flatnonzero(t[at, 0] >= 0)).size:
                        node = t[at[inner]]
                        left = x[inner, node[:, 0].astype(int)] <= node[:, 1]
                        at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                    depth += t[at, 4]
                yield pd.Series(2.0 ** (-depth / len(trees) / norm))

        return df.withColumn("__raw", score(*[F.col(c).cast("double") for c in columns]))

    def transform(self, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """Adds the score, and is_anomaly where it lies beyond the contamination cut."""
        low, high = self.range
        raw = self._raw(impute(df, self.medians).select("*"))
        score = F.lit(0.5) if high - low < 1e-12 else F.least(F.greatest((F.col("__raw") - low) / (high - low + 1e-9), F.lit(0.0)), F.lit(1.0))
        return raw.withColumns({out: score, "is_anomaly": (F.col("__raw") > self.offset).cast("int")}).drop("__raw")

    def to_json(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("columns", "trees", "sample", "contamination", "seed", "medians", "forest", "size", "range", "offset")})

    @classmethod
    def from_json(cls, text: str) -> IsolationForest:
        return cls(**json.loads(text))
