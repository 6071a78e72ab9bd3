"""Clustering and whitening against plain recomputation, on given tables and on odd vectors."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from riskweft.llm import centroids, q_centroids, q_whitening, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster string, n long, q string, id long, x string"
NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, dims=64, n=90):
    r = random.Random(5)
    rows = [(i, [r.choice([-2, 0, 1, 3]) * (1 + i % 3) + r.random() * 0.05 for _ in range(dims)]) for i in range(n)]
    same = [0.25] * dims
    rows += [(1000 + i, same) for i in range(40)] + [(7, same), (7, same), (None, same), (None, None), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [0.0] * dims), (2004, [None, *[1.0] * (dims - 1)])]
    rows += [(2005, [NAN, *[1.0] * (dims - 1)]), (2006, [INF, *[1.0] * (dims - 1)]), (2007, [1e30, *[1.0] * (dims - 1)]), (2008, [-0.001] * dims)]
    return spark.createDataFrame([(*row, "a", 1, "b", 2, "c") for row in rows], SCHEMA).repartition(3), rows


def lloyd(rows, k, rounds, dims, scale, most):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < most for c in v)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    means = [q for _, _, q in sorted((sha(f"2:{i}"), i, q) for i, q in kept if i is not None)[:k]]
    q = np.array([q for _, q in kept], dtype=object)
    nearest = lambda: [min((int(((row - np.array(m, dtype=object)) ** 2).sum()), c) for c, m in enumerate(means)) for row in q]
    for _ in range(rounds):
        at = nearest()
        for c in range(len(means)):
            if own := [row for row, (_, x) in zip(q, at, strict=True) if x == c]:
                means[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = nearest()
    inertia = Counter()
    for d, c in at:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, means[c])))) for (i, _), (d, c) in zip(kept, at, strict=True)), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (9, 12), (1, 2), (500, 1)])
def test_clusters_of_odd_vectors(spark, k, rounds):
    df, rows = odd_vectors(spark)
    got = centroids.digest(centroids.cluster(df, k, rounds, 64)).collect()
    assert sorted(map(tuple, got), key=str) == lloyd(rows, k, rounds, 64, 256, centroids.MOST)


def test_clusters_of_large_components(spark):
    """Beyond what floating point sums exactly."""
    rows = [(i, [float((i * 7919 + j * 104729) % 100003) for j in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.digest(centroids.cluster(df, 5, 3, 64)).collect()
    assert sorted(map(tuple, got), key=str) == lloyd(rows, 5, 3, 64, 256, centroids.MOST)


def test_bounds_skip_distances_and_change_nothing():
    """Grouped points: every pass gives what comparing with all gives, from fewer distances; fewer candidates fold into the remainder."""
    r = np.random.default_rng(3)
    q = (r.integers(-400, 400, (25, 16)).repeat(80, axis=0) + r.integers(-60, 60, (2000, 16))).astype(np.int64)
    means = q[r.choice(2000, 40, replace=False)]
    state, spent, held = centroids.scan(q, means, 10), 0, 10
    for turn in range(8):
        moved = means.copy()
        for c in set(state[0].tolist()):
            moved[c] = q[state[0] == c].sum(0) // (state[0] == c).sum()
        moves = np.sqrt(((moved - means) ** 2).sum(1)) * (1 + centroids.ROOM)
        means, held = moved, 10 if turn < 4 else 5
        *state, evaluated, used = centroids.reassign(q, means, moves, state[0], state[2], state[3], state[4], held)
        every = ((q[:, None, :] - means[None]) ** 2).sum(2)
        assert (state[0] == every.argmin(1)).all() and (state[1] == every.min(1)).all() and used.max() <= held
        others = np.where(np.arange(40) == state[0][:, None], np.inf, np.sqrt(every))
        assert (np.take_along_axis(others, state[2], 1) >= state[3]).all()  # bounds hold
        np.put_along_axis(others, state[2], np.inf, 1)
        assert (others.min(1) >= state[4]).all()
        spent += evaluated.sum()
    assert spent < 0.4 * 8 * 2000 * 40


def test_clusters_of_nothing(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA), 40, 5, 64) is None
    found = centroids.cluster(spark.createDataFrame([(1, [0.5] * 64, *[None] * 5)], SCHEMA), 40, 5, 64)
    assert [tuple(r) for r in found.rows.collect()] == [(1, 0, 0)]


def test_passes_get_cheaper(spark):
    found = centroids.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"), q_centroids.K, q_centroids.ROUNDS, q_centroids.DIMS)
    assert found.evaluated[0] == 500 * 40 and found.evaluated[-1] < found.evaluated[1] and sum(found.counts) == 500


def plain_whitening(rows, dims, most, shift=1_000_000):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + shift for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < whitening.MOST for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=np.int64)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(most, int((values > whitening.RANK * values[0]).sum()))
    return kept, n, sums, values, vectors, m


def check_whitening(got, rows, dims, most=16):
    kept, n, sums, values, vectors, m = plain_whitening(rows, dims, most)
    assert len(got) == len(kept) * m and set(got["component"]) == set(range(1, m + 1))
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-8
    want = Counter((i, sum(int(t) ** 2 for t in n * np.array(x) - sums)) for i, x in kept)
    of_first = got[got["component"] == 1]
    assert Counter((None if math.isnan(i) else int(i), int(d)) for i, d in zip(of_first["vec_id"], of_first["deviation"], strict=True)) == want
    for c in range(m):
        one = got[got["component"] == c + 1]
        assert np.allclose(one["explained"], values[c] / values.sum(), rtol=1e-8)
        mine = {i: w for i, w in zip(one["vec_id"], one["whitened"], strict=True)}
        ids, plain = zip(*[(i, float((n * np.array(x) - sums) / n @ vectors[:, c]) / values[c] ** 0.5) for i, x in kept if i not in (None, 7)], strict=True)  # 7 has two vectors
        have = np.array([mine[i] for i in ids])
        apart = min(np.abs(have - plain).max(), np.abs(have + plain).max())
        near = min(abs(values[c] - values[o]) for o in (c - 1, c + 1) if 0 <= o < len(values)) / values[0]
        assert apart < 1e-9 / max(near, 1e-9), (c, apart)


def test_whitening_of_odd_vectors(spark):
    df, rows = odd_vectors(spark, dims=8, n=200)
    check_whitening(whitening.whiten(df).toPandas(), rows, 8)


def test_whitening_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(q_whitening.query(spark, SF).toPandas(), rows, 64)


def test_whitening_without_full_rank(spark):
    """Three directions of variance in five entries give three components; without variance there are none."""
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 3)).round(1)
    rows = [(i, [*map(float, b), float(b[0]), 1.0]) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(whitening.whiten(df).toPandas()["component"]) == {1, 2, 3}
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(flat).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_moments_merge_as_one():
    r = np.random.default_rng(2)
    x = r.integers(-9, 9, (1000, 6)) + 10**9
    parts = [whitening.Moments.of(p) for p in np.array_split(x, 7)]
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], [*parts[1::2], whitening.Moments(0, np.zeros(6, object), np.zeros((6, 6)))], strict=False)]
    one = x - 10**9
    assert parts[0].n == 1000 and (parts[0].total == x.sum(0)).all() and np.allclose(parts[0].covariance, np.cov(one.T, bias=True), rtol=1e-12, atol=1e-12)


def test_deviation_that_fits_no_long(spark):
    rows = [(0, [0.0, 1.0]), (1, [2.0**29, 0.0]), (2, [1.0, 2.0]), (3, [3.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")["deviation"]
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    want = [sum((4 * a - s) ** 2 for a, s in zip(v, map(sum, zip(*x, strict=True)), strict=True)) for v in x]
    assert all(math.isnan(got.loc[[i]].iloc[0]) if w >= 2**63 else int(got.loc[[i]].iloc[0]) == w for i, w in enumerate(want)) and max(want) >= 2**63
