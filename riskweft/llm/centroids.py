"""Centroid clustering with Drake's adaptive bounds: exact rounds of nearest centroid and mean that skip most distances.

Vectors become whole numbers, so distances, sums and means are exact and every choice is certain, ties included. Beside
its cluster a vector stores lower bounds of its distances to the few next nearest centroids, and one remainder bound for
all others. When centroids have moved, a candidate's bound falls by that candidate's move and the remainder bound by the
largest move. The distance to the own centroid is computed; then

- with every bound above it, the cluster stays;
- with only the remainder bound above it, the candidates whose bounds are not are computed, and the order is mended;
- with the remainder bound below it, the order can't be certified and all centroids are computed again.

A bound has to be above, never equal, with room for rounding; so an equal distance to a smaller number is never missed.
The number of candidates starts at a quarter of the centroids and falls to what a round needed of them, an eighth at least.

A round is one pass over the vectors with their bounds, written to the shared folder (which cuts the lineage), and one
aggregation with map-side combining; centroids, and sums of each cluster, are all that the driver sees. No row is shuffled.

Edge cases: vectors that are null, of another length than asked for, or hold null or non-finite components or such of a
magnitude of MOST or more (whose distances may not fit a long) take no part; a vector with a null id is clustered but
never becomes a first centroid; repeated rows count each, also as first centroids; with fewer vectors than clusters each
vector is one; an empty table gives an empty one; a sum that fits no long is null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .vectors import finite, lists, matrix

#: Components are smaller; 64 squared differences of them, times 256, then fit a long.
MOST = 2.0**19
#: Relative room for rounding.
ROOM = 1e-12
_STATE = "id {kind}, q array<int>, cluster int, distance long, near array<int>, low array<float>, rest float, evaluated int, used int"


@dataclass
class Clustering:
    """rows: (id, cluster, distance), distance squared; sums and counts by cluster; evaluated: distances computed in each pass."""

    rows: DataFrame
    centroids: np.ndarray
    counts: list[int]
    inertia: list[int]
    evaluated: list[int]


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * q.shape[1] * most * most < 2**53:  # then floating point is exact, and fast
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)


def _down(x: np.ndarray) -> np.ndarray:
    """The bounds in half the room, never larger."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def scan(q: np.ndarray, centroids: np.ndarray, held: int) -> tuple[np.ndarray, ...]:
    """(cluster, distance, near, low, rest) of rows compared with all centroids."""
    every = squared(q, centroids)
    order = np.argsort(every, axis=1, kind="stable")[:, : held + 2]  # of equal distances the smaller number first
    ordered = np.take_along_axis(every, order, 1)
    roots = np.sqrt(ordered) * (1 - ROOM)
    rest = roots[:, held + 1] if roots.shape[1] > held + 1 else np.full(len(q), np.inf)
    return order[:, 0], ordered[:, 0], order[:, 1 : held + 1], roots[:, 1 : held + 1], rest


def reassign(q: np.ndarray, centroids: np.ndarray, moves: np.ndarray, cluster: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray, held: int) -> tuple[np.ndarray, ...]:
    """(cluster, distance, near, low, rest, evaluated, used) after the centroids have moved so far, with `held` candidates."""
    if held < near.shape[1]:  # the last candidates fall to the remainder
        rest = np.minimum(rest, low[:, held:].min(axis=1))
        near, low = near[:, :held], low[:, :held]
    low = low - moves[near] - ROOM * (np.abs(low) + moves[near])
    rest = np.where(np.isinf(rest), rest, rest - moves.max() - ROOM * (np.abs(rest) + moves.max()))
    distance = ((q - centroids[cluster]) ** 2).sum(1)
    upper = np.sqrt(distance) * (1 + ROOM)
    again = ~(upper < rest)
    asked = (low <= upper[:, None]) & ~again[:, None]
    evaluated = 1 + asked.sum(axis=1)
    used = np.where(again, held, asked.sum(axis=1))
    cluster, near, low, rest = cluster.copy(), near.copy(), low.copy(), rest.copy()
    if (some := np.flatnonzero(asked.any(axis=1))).size:
        i, j = np.nonzero(asked[some])
        found = np.full((len(some), held + 1), np.iinfo(np.int64).max)
        found[i, j] = ((q[some[i]] - centroids[near[some[i], j]]) ** 2).sum(1)
        found[:, held] = distance[some]
        names = np.column_stack([near[some], cluster[some]])
        bounds = np.column_stack([low[some], upper[some]])
        known = np.column_stack([asked[some], np.ones(len(some), bool)])
        bounds[known] = np.sqrt(found[known]) * (1 - ROOM)
        best = np.lexsort((names, found), axis=1)[:, 0]
        at = np.arange(len(some))
        cluster[some], distance[some] = names[at, best], found[at, best]
        bounds[at, best] = -np.inf  # the cluster itself comes first, and goes
        order = np.argsort(bounds, axis=1, kind="stable")[:, 1:]
        near[some], low[some] = np.take_along_axis(names, order, 1), np.take_along_axis(bounds, order, 1)
    if (some := np.flatnonzero(again)).size:
        cluster[some], distance[some], near[some], low[some], rest[some] = scan(q[some], centroids, held)
        evaluated[some] += len(centroids)
    return cluster, distance, near, low, rest, evaluated, used


def _pass(state: DataFrame, dims: int, centroids: np.ndarray, moves: np.ndarray | None, held: int, kind: str) -> DataFrame:
    """The state after every vector was given the nearest of these centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("q"), dims, np.int64)
            if moves is None:
                out = (*scan(q, centroids, held), np.full(len(q), len(centroids)), np.full(len(q), held))
            else:
                width = len(batch.column("near").flatten()) // max(1, len(q))
                cluster, rest = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cluster", "rest"))
                near, low = matrix(batch.column("near"), width, np.int64), matrix(batch.column("low"), width)
                out = reassign(q, centroids, moves, cluster, near, low, rest.astype(np.float64), held)
            cluster, distance, near, low, rest, evaluated, used = out
            columns = [batch.column("id"), batch.column("q"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), lists(near.astype(np.int32), pa.int32()), lists(_down(low), pa.float32())]
            columns += [pa.array(_down(rest), pa.float32()), pa.array(evaluated, pa.int32()), pa.array(used, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "q", "cluster", "distance", "near", "low", "rest", "evaluated", "used"])

    return state.mapInArrow(run, _STATE.format(kind=kind))


def whole(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, q): the vectors that take part, in whole numbers."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kept = given.where((F.size("v") == dims) & finite(F.col("v"), MOST))
    return kept.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")).alias("q"))


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering | None:
    """k clusters after so many rounds; the first centroids are the vectors whose `seed:id` has the smallest sha256. None without vectors."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "centroids")
    ship(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    state = scratch.keep(whole(vectors, dims, scale, id_col, vector_col), "whole")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    seeds = state.select(name.alias("h"), "id", "q").orderBy(F.col("h").asc_nulls_last(), "id", "q").limit(k).collect()  # k rows
    if not seeds:
        return None
    centroids = np.array([s["q"] for s in seeds], np.int64)
    held, moves, old, evaluated = max(1, len(centroids) // 4), None, None, []
    held = min(held, len(centroids) - 1)
    for turn in range(rounds + 1):
        path = scratch.path("state")
        _pass(state, dims, centroids, moves, held, kind).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(_STATE.format(kind=kind)).parquet(path)
        if old:
            scratch.drop(old)
        old = path
        last = turn == rounds
        sums = [] if last else [F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
        found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.sum("evaluated").alias("evaluated"), F.max("used").alias("used"), *sums)
        found = {r["cluster"]: r for r in found.collect()}  # k rows
        evaluated.append(sum(r["evaluated"] for r in found.values()))
        if last:
            break
        moved = centroids.copy()
        for c, r in found.items():
            moved[c] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        moves = np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + ROOM)
        centroids = moved
        if turn:  # the first pass compared with all
            held = min(held, max(len(centroids) // 8, 1, *(r["used"] for r in found.values())))
    of = lambda name: [int(found[c][name]) if c in found else 0 for c in range(len(centroids))]
    return Clustering(state.select(F.col("id").alias(id_col), "cluster", "distance"), centroids, of("n"), of("inertia"), evaluated)


def digest(found: Clustering) -> DataFrame:
    """The rows with their cluster's and the whole inertia, and the digest of their centroid."""
    fits = lambda x: F.lit(x if x < 2**63 else None).cast("long")
    at = lambda values: F.get(F.array(*values), F.col("cluster"))
    names = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in found.centroids.tolist()]
    return found.rows.select("*", at([fits(x) for x in found.inertia]).alias("cluster_inertia"), fits(sum(found.inertia)).alias("inertia"), at(names).alias("centroid_sha256"))
