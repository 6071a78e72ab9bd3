"""Whitening of embeddings by Chan's merging of moments.

Entries become whole numbers far from zero, so squares may not be summed as they are. Every partition gives its count, its
mean and its scatter about that mean; two of these merge into the same of both by the pairwise formula, in treeReduce, so
the driver gets one triple however many partitions there are. The mean is carried as count and exact sum, so no merge
loses digits of it. The driver takes the eigenvectors of the covariance; a second pass, merged alike, takes the
covariance of the whitened rows and tells how far it is from the identity.

The moments are those of each distinct vector once: copies are left out before the shuffle, within each task, and the rest
is written to the shared folder. Every row is then whitened where it lies; only eigenvectors are sent, whose size is the
square of the number of entries (DIMS at most).

Edge cases: rows whose vector is null or holds null or non-finite entries, or entries of a magnitude of MOST or more (which
would not be exact), give nothing; nor do empty vectors and those of another length than the most frequent (of equally
frequent ones the larger). Null ids and repeated rows pass as they are. Components whose eigenvalue is not above RANK times
the largest have no variance to divide by and are left out, so with a single distinct vector there are none and the result
is empty, as for an empty table. A deviation that fits no long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .vectors import finite, frequent_length, lists, matrix

#: Entries are smaller, so that whole numbers and their sums are exact.
MOST = 2.0**30
#: Share of the largest eigenvalue below which a component counts as without variance.
RANK = 1e-9
#: Entries of a vector, at most: a scatter of them has 128 MB.
DIMS = 4096


@dataclass
class Moments:
    """Count, exact sum (whole numbers or floats, as objects) and scatter about the mean of some vectors."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        n, total = len(rows), rows.sum(axis=0)
        apart = (n * rows - total) / n
        return cls(n, np.array(total.tolist(), object), apart.T @ apart)

    def merge(self, other: Moments) -> Moments:
        """Chan, Golub and LeVeque: the scatters, and that of the two means about the common one."""
        if not self.n or not other.n:
            return self if self.n else other
        apart = np.array((other.total * self.n - self.total * other.n) / (self.n * other.n), np.float64)
        n = self.n + other.n
        return Moments(n, self.total + other.total, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def moments(rows: DataFrame, dims: int, out: int, change: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """The moments of the changed rows (x array): one triple a partition, merged pair by pair on the executors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(0, np.zeros(out, object), np.zeros((out, out)))
        for batch in batches:
            if batch.num_rows:
                found = found.merge(Moments.of(change(matrix(batch.column("x"), dims, np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array([found.n], pa.int64()), pa.array([[str(x) if isinstance(x, int) else x.hex() for x in found.total]], pa.list_(pa.string())), pa.array([found.scatter.tobytes()], pa.binary())], ["n", "total", "scatter"])

    def read(row) -> Moments:
        total = [float.fromhex(x) if "0x" in x else int(x) for x in row["total"]]
        return Moments(row["n"], np.array(total, object), np.frombuffer(row["scatter"]).reshape(out, out))

    return rows.mapInArrow(local, "n long, total array<string>, scatter binary").rdd.map(read).treeReduce(Moments.merge)


@dataclass
class Whitening:
    """Fitted on n vectors with these sums: eigenvectors (columns, by falling eigenvalue), eigenvalues and what they explain."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.apart(x) / self.n) @ self.vectors / np.sqrt(self.values)


def whole(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> tuple[DataFrame, int | None]:
    """(id, x) of the rows that take part, in whole numbers, and the number of entries."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite(F.col("v"), MOST))
    dims = frequent_length(given, "v")
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    return given.where(F.size("v") == (dims or 0)).select("id", x.alias("x")), dims


def fit(x: DataFrame, dims: int, most: int) -> Whitening | None:
    """From (x array<long>), each distinct one once; None without rows. most: components, at most."""
    if dims > DIMS:
        raise ValueError(f"vectors of more than {DIMS} entries")
    ship(x.sparkSession)
    once = Scratch(x.sparkSession, "whitening").keep(x.select("x").distinct(), "once")
    if not once.limit(1).count():
        return None
    found = moments(once, dims, dims, lambda rows: rows)
    values, vectors = np.linalg.eigh(found.covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = np.flatnonzero(values > RANK * max(values[0], 0.0))[:most] if values[0] > 0 else np.zeros(0, int)
    model = Whitening(found.n, np.array(found.total.tolist(), np.int64), vectors[:, some].copy(), values[some].copy(), values[some] / max(values.sum(), 1e-300))
    if len(some):
        again = moments(once, dims, len(some), model.project)
        model.identity_error = float(np.abs(again.covariance - np.eye(len(some))).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id_col, deviation, whitened array<double>) from (id, x): squared distance of n * x from the sums, and the projections."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = matrix(batch.column("x"), len(model.sums), np.int64)
            apart = model.apart(x)
            deviation = (apart * apart).sum(axis=1).tolist()
            for i in np.flatnonzero((apart.astype(np.float64) ** 2).sum(axis=1) > 2.0**62).tolist():
                exact = sum(t * t for t in apart[i].tolist())
                deviation[i] = exact if exact < 2**63 else None
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviation, pa.int64()), lists(model.project(x), pa.float64())], ["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row a vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows, dims = whole(vectors, scale, shift, id_col, vector_col)
    model = fit(rows, dims, most) if dims else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = transform(rows, model, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*[F.lit(float(x)) for x in model.explained]), F.col("at"))
    return each.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
