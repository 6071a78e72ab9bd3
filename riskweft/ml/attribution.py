"""Additive attributions of tree ensembles: exact Shapley values of the path-dependent game (Lundberg et al., 2018).

Each leaf is a product game over the features on its path: a feature either keeps the row on the path or hands it on
by the share of training rows. Shapley values of a product game follow from its polynomial, feature by feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweft.ml.boosting import BoostedTrees
from riskweft.session import ship


def paths(tree: Any) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Leaves of a spark.ml regression tree: (value, {feature: (low, high, share)}). A row keeps to the path if low < x <= high."""
    out = []
    count = lambda n: float(n.impurityStats().count())

    def walk(node: Any, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            out.append((float(node.prediction()), path))
            return
        f, t = node.split().featureIndex(), float(node.split().threshold())
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        n = count(node)
        for child, bounds in ((node.leftChild(), (low, min(high, t))), (node.rightChild(), (max(low, t), high))):
            walk(child, path | {f: (*bounds, share * count(child) / n)})

    walk(tree._java_obj.rootNode(), {})
    return out


def ensemble_paths(model: Any) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Leaves of a boosted model, weighted by their trees."""
    if isinstance(model, BoostedTrees):
        return model.paths()
    return [(w * value, path) for tree, w in zip(model.trees, model.treeWeights, strict=True) for value, path in paths(tree)]


#: Features on a path up to which the values of all 2^m ways to keep to it are made beforehand.
TABLE = 8


def _values(keeps: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(rows x features): Shapley values of a path's product game with these flags of who keeps to it."""
    m = len(shares)
    weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
    out = np.empty(keeps.shape)
    for i in range(m):
        poly = np.zeros((len(keeps), m))  # coefficient s: sum over sets of s others of the product of who keeps and who hands on
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1]
                poly = poly * shares[j] + shifted * keeps[:, [j]]
        out[:, i] = (keeps[:, i] - shares[i]) * (poly @ weight)
    return out


def shapley(x: np.ndarray, leaves: list[tuple[float, dict[int, tuple[float, float, float]]]]) -> tuple[np.ndarray, float]:
    """(rows x features attributions, base value)."""
    phi, base = np.zeros(x.shape[::-1]), 0.0  # a feature's values stand together, as do those of x
    x = np.asfortranarray(x)
    for value, path in leaves:
        features = list(path)
        m = len(features)
        shares = np.array([path[f][2] for f in features])
        base += value * float(np.prod(shares))
        if not m:
            continue
        keeps = [(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in features]
        if m > TABLE:
            for f, part in zip(features, _values(np.column_stack(keeps).astype(float), shares).T, strict=True):
                phi[f] += value * part
            continue
        way = np.zeros(len(x), np.uint8)
        for i, k in enumerate(keeps):
            way |= k.view(np.uint8) << np.uint8(i)
        every = _values(((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float), shares) * value
        for f, part in zip(features, every.T, strict=True):
            phi[f] += part[way]
    return np.ascontiguousarray(phi.T), base


def attribute(df: DataFrame, model: Any, columns: Sequence[str], out: str = "attributions") -> DataFrame:
    """Adds an array of attributions, in the order of columns; with the base value they sum to the model's margin."""
    ship(df.sparkSession)
    leaves = ensemble_paths(model)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            phi, _ = shapley(np.column_stack([c.to_numpy(float) for c in cols]), leaves)
            yield pd.Series(list(np.where(np.isfinite(phi), phi, 0.0)))

    return df.withColumn(out, explain(*[F.col(c).cast("double") for c in columns]))


def importance_proxy(df: DataFrame, importances: Sequence[float], columns: Sequence[str], out: str = "attributions") -> DataFrame:
    """Adds importances scaled by a row factor in [0.95, 1.05], for models without trees."""
    total = sum((F.coalesce(F.abs(F.col(c).cast("double")), F.lit(0.0)) for c in columns), F.lit(0.0))
    factor = 0.95 + 0.1 * (total / (total + 1))
    return df.withColumn(out, F.array(*[F.lit(float(v)) * factor for v in importances]))
