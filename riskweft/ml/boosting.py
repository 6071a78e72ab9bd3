"""Second-order gradient boosting of trees on binned features, for binary labels, on all rows.

Rows stay on the executors. Features are cut into bins by quantiles of all rows, and the rows are written once as a byte a
feature. For each level of a tree the executors sum the gradients of the bins of every node whose split is wanted; the
sums are added up among executors, and only they reach the driver, which picks the splits. A table whose bytes fit one
block needs no sums of several tasks, so there the same loop runs through within the task that holds the block.

Where the shared folder is one that Python can open (file:), the blocks are mapped files, and so are the rows of each node
of the tree under way: a level is a job over the numbers of the blocks, which moves no rows. On other file systems the rows
come from Spark for each level.

Gradients are whole multiples of GRAIN, so sums are exact: trees don't depend on the partitioning, and the two ways give
equal ones. Trees grow by the best gain first, so a limit of leaves gives leaf-wise trees and a limit of depth alone gives
level-wise ones. The histogram of a larger child is that of its parent less that of its sibling. Scoring runs over all
rows in Arrow batches.

Rows equal in everything share their draw when rows are sampled. Early stopping takes the average precision of the
validation rows, with scores in steps of 1 / SCORES. Rows with a null label are left out; a null or NaN feature is in the
last bin, which goes right at every split.
"""

from __future__ import annotations

import heapq
import json
import os
import pickle
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweft.scratch import kept, remove, scratch_path
from riskweft.session import ship

#: Bytes of binned rows that one task fits on: its memory is some five times as much, with the copies at the start and the rows of a node.
BLOCK = 48 << 20
#: Bins of a feature; steps of a gradient in 1; steps of a score for early stopping.
BINS, GRAIN, SCORES = 64, 2.0**26, 1 << 20
#: Trees after which the rows with their margins are written, which cuts the lineage.
WRITTEN = 16


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Step sum over distinct scores; 0 without positives."""
    order = np.argsort(-score, kind="stable")
    hit, last = y[order], np.append(np.diff(score[order]) != 0, True)
    tp, at = np.cumsum(hit)[last], np.flatnonzero(last) + 1
    return float((np.diff(tp, prepend=0) * tp / at).sum() / max(1, hit.sum()))


@dataclass
class Params:
    trees: int = 500
    rate: float = 0.05
    max_depth: int = 6
    max_leaves: int = 0  # no limit
    min_weight: float = 1.0
    min_rows: int = 1
    l2: float = 1.0
    gain: float = 0.0
    rows: float = 0.8
    columns: float = 0.8
    stop_after: int = 0  # rounds without a better average precision on the validation rows; 0 never stops
    seed: int = 42


@dataclass
class BoostedTrees:
    """Each tree: feature (-1 for a leaf), threshold, left, right, value and cover of its nodes. A row goes left if x <= threshold."""

    columns: list[str]
    base: float
    trees: list[dict[str, list[float]]] = field(default_factory=list)
    importances: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _leaf_values(tree, x)
        return out

    def transform(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """Adds the probability of class 1. Nulls count as NaN, which goes right."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)  # bounded by the number of trees and leaves

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                x = np.column_stack([c.to_numpy(float) for c in cols])
                yield pd.Series(0.5 * (1 + np.tanh(0.5 * shared.value.margin(x))))

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.columns]))

    def paths(self) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
        """Leaves of all trees: (value, {feature: (low, high, share)}); a row keeps to the path if low < x <= high, and
        share is that of the training rows that do, by their weight."""
        out = []
        for t in self.trees:
            left = [(0, {})]
            while left:
                node, path = left.pop()
                f = t["feature"][node]
                if f < 0:
                    out.append((t["value"][node], path))
                    continue
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                cut = t["threshold"][node]
                for child, bounds in ((t["left"][node], (low, min(high, cut))), (t["right"][node], (max(low, cut), high))):
                    left.append((child, path | {f: (*bounds, share * t["cover"][child] / t["cover"][node])}))
        return out

    def to_json(self) -> str:
        return json.dumps({"kind": "boosted trees", **asdict(self)})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        found = json.loads(text)
        if not isinstance(found, dict) or found.pop("kind", None) != "boosted trees":
            raise TypeError("this is no model of boosted trees")
        return cls(**found)


def _leaf_values(tree: dict[str, list[float]], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = (np.asarray(tree[k]) for k in ("feature", "threshold", "left", "right", "value"))
    at = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
    return value[at]


def _midpoints(values: np.ndarray) -> np.ndarray:
    values = np.unique(values[~np.isnan(values)])
    return (values[:-1] + values[1:]) / 2


def _bins(x: np.ndarray) -> list[np.ndarray]:
    """Cuts of each feature, BINS - 1 at most; a value is in the bin of the first cut that is no smaller."""
    out = []
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > BINS:
            values = np.quantile(column[~np.isnan(column)], np.linspace(0, 1, BINS), method="lower")
        out.append(_midpoints(values))
    return out


def cuts_of(rows: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """The cuts of each feature from all rows: between all values of a feature that has few, else between its quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values of each feature in this task, BINS + 1 of them at most."""
        found = [np.zeros(0)] * len(names)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if len(found[i]) <= BINS:
                    values = column.to_numpy(zero_copy_only=False).astype(float)
                    found[i] = np.unique(np.concatenate([found[i], values[~np.isnan(values)]]))[: BINS + 1]
        at = np.repeat(np.arange(len(names)), [len(v) for v in found])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate(found) if found else at, pa.float64())], ["feature", "value"])

    ship(rows.sparkSession)
    values = rows.select(*names).mapInArrow(few, "feature int, value double").distinct()
    counted = values.groupBy("feature").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("value")), 1, BINS + 1).alias("values"))
    of = {r["feature"]: np.array(r["values"]) for r in counted.collect()}  # BINS + 1 values a feature
    many = [i for i, v in of.items() if len(v) > BINS]
    if many:
        shares = [float(q) for q in np.linspace(0, 1, BINS)]
        clean = lambda c: F.when(~F.isnan(c), F.col(c))
        found = rows.agg(*[F.percentile_approx(clean(names[i]), shares, 10_000).alias(f"q{i}") for i in many]).first()
        of |= {i: np.array(found[f"q{i}"]) for i in many}
    return [_midpoints(of.get(i, np.zeros(0))) for i in range(len(names))]


def _codes(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)]).astype(np.uint8)


def _drawn(h: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether rows with these hashes are in the sample of a tree."""
    if share >= 1:
        return np.ones(len(h), bool)
    z = h.astype(np.int64).view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def _gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prob = 0.5 * (1 + np.tanh(0.5 * margin))
    return np.rint((prob - y) * GRAIN), np.rint(prob * (1 - prob) * GRAIN)


@dataclass
class _Split:
    """Of a node of a tree under way: column among those chosen, last bin that goes left, and names of the children."""

    gain: float
    column: int
    bin: int


class _Growing:
    """A tree under way. Nodes are named 1, and 2i, 2i + 1 below i; histograms are (2 or 3, columns, BINS): gradients,
    second ones and, where rows are counted, rows."""

    def __init__(self, p: Params, columns: int, tree: int):
        self.p = p
        self.chosen = np.sort(np.random.default_rng((p.seed, tree)).choice(columns, max(1, round(p.columns * columns)), replace=False))
        self.splits: dict[int, _Split] = {}  # of nodes whose children are, or may be, made
        self.counted = p.min_rows > 1

    def best(self, hist: np.ndarray) -> _Split | None:
        p = self.p
        left = np.cumsum(hist, axis=2)
        total = left[:, :1, -1:]
        right = total - left
        ok = (left[1] >= p.min_weight * GRAIN) & (right[1] >= p.min_weight * GRAIN)
        if self.counted:
            ok &= (left[2] >= p.min_rows) & (right[2] >= p.min_rows)
        part = lambda s: (s[0] / GRAIN) ** 2 / (s[1] / GRAIN + p.l2 + 1e-12)
        gain = np.where(ok, part(left) + part(right) - part(total), -np.inf)
        at = int(gain.argmax())
        found = _Split(float(gain.flat[at]) / 2, at // BINS, at % BINS)
        return found if found.gain > max(p.gain, 1e-9) else None

    def grow(self, ask: Callable[[list[int]], list[np.ndarray]], ahead: bool, gains: np.ndarray, cuts: Sequence[np.ndarray]) -> dict[str, list[float]]:
        """The tree. ask gives the histograms of nodes; ahead asks for the children of all open nodes at once, else for those of the next."""
        p = self.p
        hists = {1: ask([1])[0]}
        tree: dict[str, list[float]] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}
        queue: list[tuple[float, int]] = []
        numbers: dict[int, int] = {}

        def node(name: int) -> int:
            sums = hists[name][:, 0].sum(1) / GRAIN
            for k, v in zip(tree, (-1, 0.0, -1, -1, float(-p.rate * sums[0] / (sums[1] + p.l2 + 1e-12)), float(sums[1])), strict=True):
                tree[k].append(v)
            numbers[name] = len(tree["feature"]) - 1
            if (not p.max_depth or name.bit_length() <= p.max_depth) and (split := self.best(hists[name])):
                heapq.heappush(queue, (-split.gain, name))
                self.splits[name] = split
            return numbers[name]

        node(1)
        while queue and (not p.max_leaves or len(numbers) // 2 + 1 < p.max_leaves):
            if 2 * queue[0][1] not in hists:
                wanted = [x for _, x in queue if 2 * x not in hists] if ahead else [queue[0][1]]
                for x in (last := [x for x in wanted if p.max_depth and x.bit_length() == p.max_depth]):  # leaves: the split itself gives their sums
                    s, h = self.splits[x], hists[x][:, self.splits[x].column]
                    hists[2 * x], hists[2 * x + 1] = (side.sum(1)[:, None, None] for side in (h[:, : s.bin + 1], h[:, s.bin + 1 :]))
                wanted = [x for x in wanted if x not in last]
                small = []
                for x in wanted:
                    s, h = self.splits[x], hists[x]
                    small.append(2 * x + int(h[1, s.column, : s.bin + 1].sum() > h[1, s.column, s.bin + 1 :].sum()))
                for x, child, found in zip(wanted, small, ask(small) if small else [], strict=True):
                    hists[child], hists[child ^ 1] = found, hists[x] - found
            _, x = heapq.heappop(queue)
            s, at = self.splits[x], numbers[x]
            feature = int(self.chosen[s.column])
            gains[feature] += s.gain
            tree["feature"][at], tree["threshold"][at] = feature, float(cuts[feature][s.bin])
            tree["left"][at], tree["right"][at] = node(2 * x), node(2 * x + 1)
            del hists[x]
        return tree


def _values(tree: dict[str, list[float]], cuts: Sequence[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The tree's value for binned rows."""
    feature, left, right = (np.asarray(tree[k]) for k in ("feature", "left", "right"))
    cut = np.array([np.searchsorted(cuts[f], t) if f >= 0 else 0 for f, t in zip(tree["feature"], tree["threshold"], strict=True)])
    at = np.zeros(len(codes), np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        where = at[inner]
        at[inner] = np.where(codes[inner, feature[where]] <= cut[where], left[where], right[where])
    return np.asarray(tree["value"])[at]


class _Early:
    """Keeps the number of trees with the best average precision so far."""

    def __init__(self, p: Params):
        self.after, self.best, self.at = p.stop_after, -1.0, 0

    def stops(self, score: float, trees: int) -> bool:
        if score > self.best:
            self.best, self.at = score, trees
        return trees - self.at >= self.after


def _steps(margin: np.ndarray) -> np.ndarray:
    return np.floor(0.5 * (1 + np.tanh(0.5 * margin)) * SCORES).astype(np.int64)


def _begun(columns: Sequence[str], rows: int, positive: float) -> BoostedTrees:
    share = float(np.clip(positive / rows if rows else 0.5, 1e-6, 1 - 1e-6))
    return BoostedTrees(list(columns), float(np.log(share / (1 - share))))


def _fit_block(codes: np.ndarray, y: np.ndarray, h: np.ndarray, columns: Sequence[str], cuts: Sequence[np.ndarray], p: Params, codes_val: np.ndarray, y_val: np.ndarray) -> BoostedTrees:
    """On rows in memory."""
    model, gains, m = _begun(columns, len(y), float(y.sum())), np.zeros(len(columns)), codes.shape[1]
    codes = np.asfortranarray(codes)  # a feature's bytes stand together
    if 0 < y.sum() < len(y):
        margin = np.full(len(y), model.base)
        held, early = np.full(len(y_val), model.base), _Early(p) if p.stop_after and len(y_val) else None
        for i in range(p.trees):
            g, h2 = _gradients(y, margin)
            growing = _Growing(p, m, i)
            own = {1: np.flatnonzero(_drawn(h, i, p.rows))}

            def ask(nodes: list[int]) -> list[np.ndarray]:
                out = []
                for node in nodes:
                    if node not in own:
                        split, at = growing.splits[node >> 1], own.pop(node >> 1)  # noqa: B023
                        side = codes[at, growing.chosen[split.column]] <= split.bin  # noqa: B023
                        own[node & ~1], own[node | 1] = at[side], at[~side]  # noqa: B023
                    at = own[node]  # noqa: B023
                    sums = np.zeros((3 if growing.counted else 2, len(growing.chosen), BINS))  # noqa: B023
                    weights = [w[at] for w in (g, h2)]  # noqa: B023
                    for c, name in enumerate(growing.chosen):  # noqa: B023
                        seen = codes[:, name][at].astype(np.intp)
                        for k, w in enumerate(weights):
                            sums[k, c] = np.bincount(seen, w, BINS)
                        if growing.counted:  # noqa: B023
                            sums[2, c] = np.bincount(seen, minlength=BINS)
                    out.append(sums)
                return out

            tree = growing.grow(ask, False, gains, cuts)
            margin += _values(tree, cuts, codes)
            model.trees.append(tree)
            if early:
                held += _values(tree, cuts, codes_val)
                if early.stops(average_precision(y_val, _steps(held)), i + 1):
                    break
        if early:
            model.trees = model.trees[: early.at]
    model.importances = (gains / max(gains.sum(), 1e-12)).tolist()
    return model


def fit_arrays(x: np.ndarray, y: np.ndarray, columns: Sequence[str], p: Params, x_val: np.ndarray | None = None, y_val: np.ndarray | None = None) -> BoostedTrees:
    """On arrays; a row's place stands for its hash."""
    if not len(x):
        return _begun(columns, 0, 0.0)
    cuts, none = _bins(x), np.zeros((0, x.shape[1]))
    held = none if x_val is None else x_val
    return _fit_block(_codes(x, cuts), np.asarray(y, float), np.arange(len(x)), columns, cuts, p, _codes(held, cuts), np.zeros(0) if y_val is None else np.asarray(y_val, float))


_ROWS = "y double, held boolean, h long, codes binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint8)


def _binned(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """(y, held, h, codes): a byte a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[3:]])
            codes = [r.tobytes() for r in _codes(x, cuts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary())], ["y", "held", "h", "codes"])

    return rows.mapInArrow(run, _ROWS)


def _fit_in_task(binned: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray], p: Params) -> BoostedTrees:
    """All rows are one block: the fit runs in the task that holds it, and gives the model."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy(), _matrix(b.column(3), width)) for b in batches if b.num_rows]
        y, held, h, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
        model = _fit_block(codes[~held], y[~held], h[~held], columns, cuts, p, codes[held], y[held])
        yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], ["model"])

    return BoostedTrees.from_json(binned.coalesce(1).mapInArrow(run, "model string").first()["model"])  # BLOCK bytes at most


def _summed(rows: DataFrame, task: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The arrays of all batches added up: within tasks, then among executors; one array reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                out += task(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]).reshape(shape)).treeReduce(np.add)


def _fit_over_tasks(binned: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray], p: Params) -> BoostedTrees:
    """Rows in many tasks: sums of each level come from all of them."""
    spark, width = binned.sparkSession, len(columns)
    folder = scratch_path(spark, "boosting")
    of = binned.where("NOT held").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("positive")).first()
    model, gains = _begun(columns, of["n"], of["positive"]), np.zeros(width)
    if not 0 < of["positive"] < of["n"]:
        model.importances = gains.tolist()
        return model
    early = _Early(p) if p.stop_after and binned.where("held").limit(1).count() else None
    rows, written = binned.withColumn("margin", F.lit(model.base)).persist(), None

    def with_margins(tree: dict[str, list[float]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = batch.column(4).to_numpy() + _values(tree, cuts, _matrix(batch.column(3), width))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], ["y", "held", "h", "codes", "margin"])

        return run

    def precision(batch: pa.RecordBatch) -> np.ndarray:
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        at, y = _steps(batch.column(4).to_numpy()[held]), batch.column(0).to_numpy()[held]
        return np.stack([np.bincount(at, y, SCORES + 1), np.bincount(at, minlength=SCORES + 1)])

    for i in range(p.trees):
        growing = _Growing(p, width, i)
        columns_in, counted = growing.chosen, growing.counted

        def ask(nodes: list[int]) -> list[np.ndarray]:
            splits, many, size = dict(growing.splits), len(nodes), len(columns_in) * BINS  # noqa: B023
            place = {name: k for k, name in enumerate(nodes)}
            chosen, tree = columns_in, i  # noqa: B023

            def task(batch: pa.RecordBatch) -> np.ndarray:
                codes = _matrix(batch.column(3), width)
                use = _drawn(batch.column(2).to_numpy(), tree, p.rows) & ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                codes, y, margin = codes[use], batch.column(0).to_numpy()[use], batch.column(4).to_numpy()[use]
                node = np.ones(len(codes), object if max(nodes).bit_length() > 60 else np.int64)
                wanted = {x >> k for x in nodes for k in range(1, x.bit_length())}
                for name in sorted(wanted):  # from the root down
                    at = np.flatnonzero(node == name)
                    node[at] = 2 * name + (codes[at, chosen[splits[name].column]] > splits[name].bin)
                out = np.zeros((many, 3 if counted else 2, size))  # noqa: B023
                g, h2 = _gradients(y, margin)
                for name, k in place.items():
                    at = np.flatnonzero(node == name)
                    seen = (codes[at][:, chosen].astype(np.int32) + (np.arange(len(chosen), dtype=np.int32) * BINS)[None, :]).ravel()
                    out[k, 0], out[k, 1] = (np.bincount(seen, np.repeat(w[at], len(chosen)), size) for w in (g, h2))
                    if counted:  # noqa: B023
                        out[k, 2] = np.bincount(seen, minlength=size)
                return out

            sums = _summed(rows, task, (many, 3 if counted else 2, size))  # noqa: B023
            return list(sums.reshape(many, -1, len(chosen), BINS))

        tree = growing.grow(ask, True, gains, cuts)
        model.trees.append(tree)
        old, rows = rows, rows.mapInArrow(with_margins(tree), f"{_ROWS}, margin double")
        if (i + 1) % WRITTEN == 0:
            path = f"{folder}/{i + 1}"
            rows.write.option("compression", "zstd").parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
            if written:
                remove(spark, written)
            written = path
        rows = rows.persist()
        if early:
            positive, n = _summed(rows, precision, (2, SCORES + 1))[:, ::-1]
            some = np.flatnonzero(n)
            tp, seen = np.cumsum(positive[some]), np.cumsum(n[some])
            if early.stops(float((np.diff(tp, prepend=0) * tp / seen).sum() / max(1, tp[-1])), i + 1):
                break
        elif (i + 1) % WRITTEN:
            rows.count()  # so the old rows may go
        old.unpersist()
    rows.unpersist()
    if early:
        model.trees = model.trees[: early.at]
    model.importances = (gains / max(gains.sum(), 1e-12)).tolist()
    return model


def _put(path: str, write: Callable) -> None:
    """The file, at once; a second attempt of a task writes the same."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        write(f)
    os.replace(part, path)


def _gone(path: str) -> None:
    try:
        os.remove(path)
    except FileNotFoundError:
        pass


def _plan(tree: dict[str, list[float]], cuts: Sequence[np.ndarray]) -> tuple:
    """(feature, last bin that goes left, left, right, value) of the nodes."""
    last = [int(np.searchsorted(cuts[f], t)) if f >= 0 else 0 for f, t in zip(tree["feature"], tree["threshold"], strict=True)]
    return tree["feature"], last, tree["left"], tree["right"], tree["value"]


def _routed(plan: tuple, codes: np.ndarray) -> np.ndarray:
    """The tree's value for binned rows, a feature of which stands together."""
    feature, last, left, right, value = plan
    out = np.full(codes.shape[1], value[0])
    open_ = [(0, np.arange(codes.shape[1], dtype=np.int32))]
    while open_:
        node, at = open_.pop()
        if feature[node] < 0:
            out[at] = value[node]
            continue
        side = codes[feature[node]][at] <= last[node]
        open_ += [(left[node], at[side]), (right[node], at[~side])]
    return out


def _block_sums(codes: np.ndarray, chosen: np.ndarray, g: np.ndarray, h2: np.ndarray, rows: Sequence[np.ndarray], counted: bool) -> np.ndarray:
    """(nodes, 2 or 3, columns, BINS) of these rows."""
    sums = np.zeros((len(rows), 3 if counted else 2, len(chosen), BINS))
    for out, at in zip(sums, rows, strict=True):
        weights = [w[at].astype(float) for w in (g, h2)]
        for c, name in enumerate(chosen):
            seen = codes[name][at].astype(np.intp)
            for k, w in enumerate(weights):
                out[k, c] = np.bincount(seen, w, BINS)
            if counted:
                out[2, c] = np.bincount(seen, minlength=BINS)
    return sums


def _open_tree(block: int, folder: str, i: int, base: float, done: tuple | None, p: Params, chosen: np.ndarray | None, counted: bool, early: bool) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Adds the tree that is done to the margins; (positive and all held rows by step of score, sums of the root of tree i)."""
    at = f"{folder}/{block}"
    get = lambda name, mode=None: np.load(f"{at}-{name}.npy", mmap_mode=mode)
    codes, precision, sums = get("codes", "r"), None, None
    for side in ("", "held-") if early else ("",):
        x = get(f"{side}codes", "r")
        margin = np.full(x.shape[1], base) if done is None else get(f"{side}margin-{i - 1}") + _routed(done, x)
        _put(f"{at}-{side}margin-{i}.npy", lambda f: np.save(f, margin))  # noqa: B023
        _gone(f"{at}-{side}margin-{i - 2}.npy")
        if side:
            steps = _steps(margin)
            precision = np.stack([np.bincount(steps, get("held-y"), SCORES + 1), np.bincount(steps, minlength=SCORES + 1)]).astype(np.int32)
        else:
            own = margin
    if chosen is not None:
        g, h2 = (w.astype(np.int32) for w in _gradients(get("y"), own))
        rows = np.flatnonzero(_drawn(get("h"), i, p.rows)).astype(np.int32)
        for name, value in (("g", g), ("h2", h2), ("rows-0", rows)):
            _put(f"{at}-{name}-{i}.npy", lambda f: np.save(f, value))  # noqa: B023
        _put(f"{at}-nodes-0-{i}", lambda f: pickle.dump({1: (0, len(rows))}, f))
        sums = _block_sums(codes, chosen, g, h2, [rows], counted)
    return precision, sums


def _ask_block(block: int, folder: str, i: int, step: int, splits: list[tuple[int, int, int]], nodes: list[int], chosen: np.ndarray, counted: bool) -> np.ndarray:
    """Sums of the nodes, once the splits (node, feature, last bin that goes left) have cut their parents' rows in two."""
    at = f"{folder}/{block}"
    codes, g, h2, rows = (np.load(f"{at}-{name}.npy", mmap_mode=mode) for name, mode in (("codes", "r"), (f"g-{i}", None), (f"h2-{i}", None), (f"rows-{step - 1}-{i}", None)))
    with open(f"{at}-nodes-{step - 1}-{i}", "rb") as f:
        place = pickle.load(f)
    for node, feature, last in splits:
        low, high = place.pop(node)
        some = rows[low:high].copy()
        side = codes[feature][some] <= last
        middle = low + int(np.count_nonzero(side))
        rows[low:middle], rows[middle:high] = some[side], some[~side]
        place[2 * node], place[2 * node + 1] = (low, middle), (middle, high)
    _put(f"{at}-rows-{step}-{i}.npy", lambda f: np.save(f, rows))
    _put(f"{at}-nodes-{step}-{i}", lambda f: pickle.dump(place, f))
    return _block_sums(codes, chosen, g, h2, [rows[slice(*place[x])] for x in nodes], counted)


def _close_tree(folder: str, blocks: int, i: int, steps: int) -> None:
    for at in (f"{folder}/{b}" for b in range(blocks)):
        for name in (f"g-{i}.npy", f"h2-{i}.npy", *(f"{n}-{k}-{i}{end}" for k in range(steps + 1) for n, end in (("rows", ".npy"), ("nodes", "")))):
            _gone(f"{at}-{name}")


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(None if x is None else x + y for x, y in zip(a, b, strict=True))


def _fit_on_files(binned: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray], p: Params, folder: str, rows: int, block: int) -> BoostedTrees:
    """Rows in many blocks, each of which is mapped files that all workers and the driver see."""
    spark, width = binned.sparkSession, len(columns)
    cores = spark.sparkContext.defaultParallelism
    blocks = cores * max(1, -(-rows * width // (cores * (block or BLOCK))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy(), _matrix(b.column(3), width)) for b in batches if b.num_rows]
        y, held, h, codes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, width), np.uint8))
        at = f"{folder}/{TaskContext.get().partitionId()}"
        for name, value in (("y", y[~held]), ("h", h[~held]), ("codes", np.ascontiguousarray(codes[~held].T)), ("held-y", y[held]), ("held-codes", np.ascontiguousarray(codes[held].T))):
            _put(f"{at}-{name}.npy", lambda f: np.save(f, value))  # noqa: B023
        yield pa.RecordBatch.from_arrays([pa.array([int((~held).sum())]), pa.array([float(y[~held].sum())]), pa.array([int(held.sum())])], ["n", "positive", "held"])

    of = binned.repartition(blocks).mapInArrow(cut, "n long, positive double, held long").groupBy().sum().first()
    model, gains = _begun(columns, of[0], of[1]), np.zeros(width)
    if not 0 < of[1] < of[0]:
        model.importances = gains.tolist()
        return model
    early = _Early(p) if p.stop_after and of[2] else None

    def summed(task: Callable, *given) -> tuple:
        found = spark.sparkContext.parallelize(range(blocks), blocks).map(lambda b: task(b, *given))
        if blocks > 4 * cores:
            return found.treeReduce(_added)
        total = None
        for one in found.collect():  # a few arrays of sums
            total = one if total is None else _added(total, one)
        return total

    def better(precision: np.ndarray, trees: int) -> bool:
        positive, n = precision[:, ::-1].astype(float)
        some = np.flatnonzero(n)
        tp, seen = np.cumsum(positive[some]), np.cumsum(n[some])
        return early.stops(float((np.diff(tp, prepend=0) * tp / seen).sum() / max(1, tp[-1])), trees)

    done, stopped = None, False
    for i in range(p.trees):
        growing, steps = _Growing(p, width, i), 0
        chosen, counted = growing.chosen, growing.counted
        precision, root = summed(_open_tree, folder, i, model.base, done, p, chosen, counted, bool(early))
        if early and i and better(precision, i):
            stopped = True
            break

        def ask(nodes: list[int]) -> list[np.ndarray]:
            nonlocal steps
            if nodes == [1]:
                return list(root)  # noqa: B023
            steps += 1
            splits = [(x >> 1, int(chosen[growing.splits[x >> 1].column]), growing.splits[x >> 1].bin) for x in nodes]  # noqa: B023
            return list(summed(_one_ask, folder, i, steps, splits, nodes, chosen, counted)[0])  # noqa: B023

        tree = growing.grow(ask, True, gains, cuts)
        _close_tree(folder, blocks, i, steps)
        model.trees.append(tree)
        done = _plan(tree, cuts)
    if early and not stopped and p.trees:
        better(summed(_open_tree, folder, p.trees, model.base, done, p, None, False, True)[0], p.trees)
    if early:
        model.trees = model.trees[: early.at]
    model.importances = (gains / max(gains.sum(), 1e-12)).tolist()
    return model


def _one_ask(*given) -> tuple[np.ndarray]:
    return (_ask_block(*given),)


@dataclass
class Boosting:
    """An estimator: fit gives BoostedTrees. block: bytes of binned rows up to which one task fits them."""

    params: Params
    block: int = BLOCK

    def fit(self, df: DataFrame, columns: Sequence[str], label: str, validation: str | None = None) -> BoostedTrees:
        """On all rows with a label; rows where validation is true only stop the rounds."""
        held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(columns)]
        rows = df.select(F.col(label).cast("double").alias("y"), held.alias("held"), *numbers).where("y IS NOT NULL")
        names = rows.columns
        rows = rows.withColumn("h", F.xxhash64(*names)).select("y", "held", "h", *names[2:])
        ship(df.sparkSession)
        cuts = cuts_of(rows.where("NOT held"), names[2:])
        binned = kept(_binned(rows, cuts), "binned")
        n = binned.count()
        if not n:
            return _begun(columns, 0, 0.0)
        if n * len(columns) <= self.block:
            return _fit_in_task(binned, list(columns), cuts, self.params)
        folder = scratch_path(df.sparkSession, "blocks")
        if not folder.startswith("file:"):
            return _fit_over_tasks(binned, list(columns), cuts, self.params)
        model = _fit_on_files(binned, list(columns), cuts, self.params, re.sub("^file:(//)?", "", folder), n, self.block)
        remove(df.sparkSession, folder)
        return model


def save(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    from riskweft.sources.writers import write_text

    write_text(spark, f"{path}/trees.json", model.to_json())


def load(spark: SparkSession, path: str) -> BoostedTrees:
    from riskweft.sources.writers import read_text

    return BoostedTrees.from_json(read_text(spark, f"{path}/trees.json"))

