"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking.

The trees are fitted on a bounded sample (a documented parameter) and every row is indexed: equal vectors become one
class, and a class has a leaf in every tree. A query opens leaves, over all trees at once, in order of the squared
margins on the way to them, until the opened leaves hold the wanted share of the sample, each row counted once. The share
is the smallest that reaches the wanted recall on the sample, where the true neighbours are known, with room for the
chance in both the sample's queries and those asked: with structure in the vectors it is small, with none it is large,
and where so few queries are asked that chance alone could miss the recall, all leaves are opened.

Vectors are dealt once, by cells of the first tree (subtrees of some thousand rows), with their leaves of all trees. What
a query opens is told by one number, the margin at which its queue stopped: the tasks find the opened leaves from that
and the broadcast trees, so a query is sent with its vector and that number alone, to the cells where an opened leaf has
rows, and is compared there, once, with each class that lies in one. Which cells a leaf has rows in is a bitmap, bounded
by the numbers of leaves and cells. Large cells and query sets are split, so a task holds bounded blocks.

A class carries its K + 1 smallest ids: further members of the same vector can't be among a query's K nearest, since
ties go to smaller ids. So a vector that a third of all rows share costs no more than any other.

Edge cases: null ids, null vectors, vectors without components, zero vectors and those with null or non-finite
components take no part; nor do vectors of another length than the most frequent (of equally frequent ones the larger).
Rows equal in id and vector count once; an id with several vectors is a candidate at each of them, and as a query counts
with the least; rows that share the query's id are never its neighbours. With fewer rows than K all of them are given;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship
from .vectors import finite, frequent_length, matrix

#: Rows that the trees are fitted on, at most; rows of the sample in a leaf.
SAMPLE, LEAF_SAMPLE = 20_000, 16
#: Queries that the share is measured with; standard deviations of recall that it leaves room for.
MEASURED, ROOM = 300, 2.5
#: Rows, and queries, that one task compares; cells of the first tree; queries that are compared at once.
BLOCK_ROWS, BLOCK_QUERIES, CELLS, AT_ONCE = 65_536, 20_000, 512, 16


@dataclass
class Tree:
    """Inner nodes have a direction and a threshold; children are nodes (>= 0) or leaves (-1 - leaf)."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    members: list[np.ndarray]  # rows of the sample in each leaf

    @classmethod
    def grow(cls, rows: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
        directions, thresholds, children, members = [], [], [], []

        def split(at: np.ndarray) -> int:
            if len(at) > leaf:
                a, b = rows[random.choice(at, 2, replace=False)]
                if (size := np.linalg.norm(a - b)) > 0:
                    direction = (a - b) / size
                    along = rows[at] @ direction
                    middle = np.partition(along, [len(at) // 2 - 1, len(at) // 2])[[len(at) // 2 - 1, len(at) // 2]]
                    threshold = float(middle.mean())  # between two rows, so rounding moves neither
                    side = along > threshold
                    if 0 < side.sum() < len(at):
                        node = len(directions)
                        directions.append(direction)
                        thresholds.append(threshold)
                        children.append((0, 0))
                        children[node] = (split(at[~side]), split(at[side]))
                        return node
            members.append(at)
            return -len(members)

        split(np.arange(len(rows)))
        return cls(np.array(directions).reshape(-1, rows.shape[1]), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), members)

    @property
    def root(self) -> int:
        return 0 if len(self.directions) else -1

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.full(len(rows), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", rows[inner], self.directions[node]) > self.thresholds[node]
            at[inner] = self.children[node, side.astype(np.int64)]
        return -1 - at

    def cells(self, rows: int) -> np.ndarray:
        """Cell of each leaf: leaves below a node with at most so many rows of the sample are in one cell."""
        out, n = np.zeros(len(self.members), np.int64), 0

        def below(node: int) -> list[int]:
            return [-1 - node] if node < 0 else [x for child in self.children[node] for x in below(child)]

        left = [self.root]
        while left:
            node = left.pop()
            leaves = below(node)
            if node < 0 or sum(len(self.members[x]) for x in leaves) <= rows:
                out[leaves], n = n, n + 1
            else:
                left.extend(self.children[node].tolist())
        return out


class Forest:
    """All trees as one: nodes and leaves are numbered through; children are nodes (>= 0) or leaves (-1 - leaf)."""

    def __init__(self, trees: list[Tree]):
        nodes, leaves = np.cumsum([0, *(len(t.directions) for t in trees)]), np.cumsum([0, *(len(t.members) for t in trees)])
        self.trees, self.first = trees, leaves
        self.directions, self.thresholds = np.concatenate([t.directions for t in trees]), np.concatenate([t.thresholds for t in trees])
        self.children = np.concatenate([np.where(t.children >= 0, t.children + n, t.children - m) for t, n, m in zip(trees, nodes, leaves, strict=False)])
        self.roots = [int(n) if t.root >= 0 else -1 - int(m) for t, n, m in zip(trees, nodes, leaves, strict=False)]
        self.members = [rows for t in trees for rows in t.members]
        self.levels, level = [], np.array([r for r in self.roots if r >= 0], np.int64)
        while len(level):
            self.levels.append(level)
            level = self.children[level].ravel()
            level = level[level >= 0]

    def __reduce__(self):
        return Forest, (self.trees,)  # the rest follows from these

    @cached_property
    def rows(self) -> list[list[int]]:
        return [m.tolist() for m in self.members]

    @cached_property
    def pairs(self) -> list[list[int]]:
        return self.children.tolist()

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        return np.column_stack([t.leaves(rows) + n for t, n in zip(self.trees, self.first, strict=False)]).astype(np.int32)

    def passed(self, queries: np.ndarray) -> np.ndarray:
        """Sums of squared margins that each query passes on the way to each leaf."""
        m = queries @ self.directions.T - self.thresholds
        at_node, at_leaf = np.zeros(m.shape), np.zeros((len(m), len(self.members)))
        for nodes in self.levels:
            for side, margin in enumerate((np.maximum(m[:, nodes], 0), np.minimum(m[:, nodes], 0))):
                child, value = self.children[nodes, side], at_node[:, nodes] + margin**2
                at_node[:, child[child >= 0]] = value[:, child >= 0]
                at_leaf[:, -1 - child[child < 0]] = value[:, child < 0]
        return at_leaf

    def search(self, query: np.ndarray, share: float) -> float:
        """The margin at which a queue over all trees, nearest margin first, has opened leaves with the share of the sample."""
        if share >= 1:
            return float("inf")
        margins, rows, children = (self.directions @ query - self.thresholds).tolist(), self.rows, self.pairs
        queue = [(0.0, root) for root in self.roots]
        seen, wanted, passed = set(), share * sum(map(len, self.trees[0].members)), 0.0
        pop, push = heapq.heappop, heapq.heappush
        while queue and len(seen) < wanted:
            passed, node = pop(queue)
            if node < 0:
                seen.update(rows[-1 - node])
                continue
            margin, (low, high) = margins[node], children[node]
            far = passed + margin * margin
            push(queue, (far if margin > 0 else passed, low))
            push(queue, (passed if margin > 0 else far, high))
        return passed * (1 + 1e-9)  # so the last leaf stays open, however the sums were rounded


def share_for(forest: Forest, points: np.ndarray, k: int, recall: float, asked: int, random: np.random.Generator) -> float:
    """The share of the sample that queries have to open for this recall of their k nearest among the points."""
    own = random.choice(len(points), min(MEASURED, len(points)), replace=False)
    k = min(k, len(points) - 1)
    if k < 1:
        return 1.0
    target = recall + ROOM * (recall * (1 - recall) * (1 / (len(own) * k) + 1 / max(1, asked))) ** 0.5
    if target >= 1:
        return 1.0
    leaves, norms, needed = forest.leaves(points), (points**2).sum(1), []
    for some in np.array_split(own, -(-len(own) // AT_ONCE)):
        apart = norms - 2 * points[some] @ points.T
        apart[np.arange(len(some)), some] = np.inf
        near = np.argpartition(apart, k - 1, axis=1)[:, :k]
        for passed, rows in zip(forest.passed(points[some]), near, strict=True):
            opened = np.sort(passed[leaves].min(axis=1))
            needed.append(np.searchsorted(opened, passed[leaves[rows]].min(axis=1), "right") / len(points))
    return float(np.quantile(np.concatenate(needed), target, method="higher"))


def _usable(vector: Column) -> Column:
    return finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest_ids(scores: np.ndarray, ids: list[list[int]], own: int, k: int) -> list[tuple[float, int]]:
    """The k smallest (score, id) of classes given by their scores and ids, without the own id."""
    wanted = min(len(scores), k + 1)
    limit = np.partition(scores, wanted - 1)[wanted - 1] if wanted else 0.0
    found = [(float(scores[i]), x) for i in np.flatnonzero(scores <= limit).tolist() for x in ids[i] if x != own]
    return heapq.nsmallest(k, found)


def nearest(vectors: DataFrame, query_step: int = 100, k: int = 10, trees: int = 16, recall: float = 0.9, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each row whose id is a multiple of query_step.

    share: that of the rows to compare with, instead of the smallest for the recall.
    """
    ship(vectors.sparkSession)
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "neighbours")
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    dims = frequent_length(rows, "v")
    if dims is None:
        return empty
    rows = rows.where(F.size("v") == dims).withColumns({"v1": F.xxhash64("v"), "v2": F.xxhash64(F.lit(1), "v")})
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v1", "v2").orderBy("id"))).where(F.col("r") <= k + 1)  # limited before the shuffle, too
    classes = scratch.keep(ranked.groupBy("v1", "v2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v")).select("v1", "ids", "v"), "classes")
    queries = scratch.keep(rows.where(F.col("id") % query_step == 0).groupBy("id").agg(F.min("v").alias("q")), "queries")
    n, asked = classes.count(), queries.count()
    sample = classes.select("v1", "v").orderBy("v1").limit(SAMPLE).toArrow()  # SAMPLE at most; v1 is a hash
    points, random = matrix(sample["v"].combine_chunks(), dims), np.random.default_rng(11)
    forest = Forest([Tree.grow(points, LEAF_SAMPLE, random) for _ in range(trees)])
    if share is None:  # so many of the sample as of all rows there are k nearest
        share = share_for(forest, points, max(1, round(k * len(points) / n)), recall, asked * k, random)
    block = block_rows or max(BLOCK_ROWS // 4, min(BLOCK_ROWS, n // spark.sparkContext.defaultParallelism))
    cells = forest.trees[0].cells(max(1, len(points) * block // n, len(points) // CELLS))
    shared = spark.sparkContext.broadcast((forest, cells))  # bounded by SAMPLE
    kind = classes.schema["v"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cells = shared.value
        for batch in batches:
            leaves = forest.leaves(matrix(batch.column(2), dims))
            numbers = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel(), pa.int32()), trees).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(cells[leaves[:, 0]], pa.int32()), numbers, *batch.columns], ["cell", "leaves", "v1", "ids", "v"])

    indexed = scratch.keep(classes.mapInArrow(index, f"cell int, leaves array<int>, v1 long, ids array<long>, v {kind}"), "index")
    filled = indexed.select("cell", F.explode("leaves").alias("leaf")).groupBy("leaf", F.floor(F.col("cell") / 63).cast("int").alias("word"))
    filled = filled.agg(F.bit_or(F.expr("shiftleft(1L, cell % 63)")).alias("bits")).toArrow()  # leaves x cells / 63, at most
    bits = np.zeros((len(forest.members), int(cells.max()) // 63 + 1), np.int64)
    bits[filled["leaf"].to_numpy(), filled["word"].to_numpy()] = filled["bits"].to_numpy()
    filled_in = spark.sparkContext.broadcast(bits)  # bounded by SAMPLE and CELLS

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (forest, cells), bits = shared.value, filled_in.value
        for batch in batches:
            q = matrix(batch.column(1), dims)
            stops = [forest.search(x, share) for x in q]
            visits = []
            for start in range(0, len(q), AT_ONCE):
                for passed, stop in zip(forest.passed(q[start : start + AT_ONCE]), stops[start : start + AT_ONCE], strict=True):
                    words = np.bitwise_or.reduce(bits[passed <= stop], axis=0)
                    visits.append([63 * w + b for w, word in enumerate(words.tolist()) for b in range(63) if word >> b & 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stops, pa.float64()), pa.array(visits, pa.list_(pa.int32()))], ["query_id", "q", "stop", "cells"])

    def rerank(queries: pa.Table, block: pa.Table) -> pa.Table:
        """The k nearest ids of this block for each query, among the classes in its opened leaves."""
        out_q, out_i, out_s = [], [], []
        if len(queries) and len(block):
            forest, _ = shared.value
            q, x, leaves = (matrix(c.combine_chunks(), w, t) for c, w, t in ((queries["q"], dims, np.float64), (block["v"], dims, np.float64), (block["leaves"], trees, np.int32)))
            ids, stops, names, norms = block["ids"].to_pylist(), queries["stop"].to_numpy(), queries["query_id"].to_pylist(), (x**2).sum(1)
            for start in range(0, len(q), AT_ONCE):
                at_once = q[start : start + AT_ONCE]
                about = norms[:, None] - 2 * x @ at_once.T  # squared distances but for a term of the query's own
                for i, passed in enumerate(forest.passed(at_once)):
                    some = np.flatnonzero((passed <= stops[start + i])[leaves].any(axis=1))
                    near, room = about[some, i], 1e-10 * (norms.max() + at_once[i] @ at_once[i])
                    if len(some) > k + 1:
                        some = some[near <= np.partition(near, k)[k] + room]
                    found = _nearest_ids(np.sqrt(((x[some] - at_once[i]) ** 2).sum(1)), [ids[j] for j in some.tolist()], names[start + i], k)
                    out_q += [names[start + i]] * len(found)
                    out_s += [s for s, _ in found]
                    out_i += [j for _, j in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "id": pa.array(out_i, pa.int64()), "score": pa.array(out_s, pa.float64())})

    probes = scratch.keep(queries.mapInArrow(probe, f"query_id long, q {kind}, stop double, cells array<int>"), "probes")
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # CELLS at most, or leaves of the first tree
    parts = F.get(F.array(*[F.lit(1 + sizes.get(c, 0) // block) for c in range(int(cells.max()) + 1)]), F.col("cell"))
    chunks = 1 + asked // BLOCK_QUERIES
    numbered = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), (m - 1).cast("int")))
    asking = probes.select("query_id", "q", "stop", F.explode("cells").alias("cell")).withColumn("chunk", numbered("query_id", F.lit(chunks))).withColumn("block", every(parts))
    held = indexed.withColumn("block", numbered("v1", parts)).withColumn("chunk", every(F.lit(chunks))).drop("v1")
    key = ["cell", "block", "chunk"]
    found = asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(rerank, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
