"""Hashed text features and sparse training, shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, ship

#: Words that a task remembers before it starts anew.
MEMO_WORDS = 500_000
#: Entries that a fit takes to the driver, at most; twelve bytes each.
MAX_ENTRIES = 12_000_000


def slot(token: str, dims: int) -> int:
    return xxh3_64_intdigest(token) % dims


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str, text_col: str, per_label: bool = False) -> DataFrame:
    """(__doc, __text, __label) of at most bound labelled ids (of each label, if so asked), the first in order of a hash of the id.

    The ids are bounded, so they go to the documents by broadcast and no text is shuffled for them. An id with
    different labels counts as its largest label.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    some = some.withColumn("__group", F.col("__label") if per_label else F.lit(0)).withColumn("__h", F.xxhash64(id_col))
    # of large groups, only about three times the bound are ranked: those with the smallest hashes
    sizes = some.groupBy("__group").agg(F.count("*").alias("__n"))
    near = some.join(F.broadcast(sizes), "__group").where(F.col("__h") / float(2**64) + 0.5 <= F.lit(3.0 * bound) / F.col("__n"))  # a row a grade
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy("__group").orderBy("__h", id_col)))
    some = ranked.where(F.col("__r") <= bound).select(id_col, "__label")
    some = some.withColumnRenamed(id_col, "__id")
    return docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(some), F.col("__doc") == F.col("__id")).select("__doc", "__text", F.col("__label").cast("int").alias("__label"))


def collected(sample: DataFrame, extract: Callable[[str], list[tuple[list[int], list[float]]]], valued: bool = True, max_entries: int | None = None) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features of the sample on the driver: label of each document, document of each part, and sparse entries.

    extract gives for a text its parts (one, or its sentences), each a list of slots and their values, which are left
    out unless valued. An id with several texts counts with one of them. Documents are taken in order of a hash of their
    ids, each that still fits into max_entries (MAX_ENTRIES), so neither their number nor their length may fill the driver
    and a very long one is passed over alone; they come in the order of their ids, so reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [extract(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array([[len(i) for i, _ in p] for p in parts], pa.list_(pa.int32())),
                    pa.array([[x for i, _ in p for x in i] for p in parts], pa.list_(pa.int32())),
                    pa.array([[x for _, v in p for x in v] for p in parts] if valued else [None] * len(parts), pa.list_(pa.float32())),
                ],
                ["id", "label", "h", "sizes", "slots", "values"],
            )

    ship(sample.sparkSession)
    kind = sample.schema["__doc"].dataType.simpleString()
    keyed = sample.select("__doc", "__text", "__label", F.xxhash64("__text").alias("__h"))
    found = keyed.mapInArrow(run, f"id {kind}, label int, h long, sizes array<int>, slots array<int>, values array<float>")
    found = found.groupBy("id").agg(F.min_by(F.struct("label", "sizes", "slots", "values"), "h").alias("x")).select("id", "x.*")
    found = Scratch(sample.sparkSession, "features").keep(found, "features")
    sizes = found.select("id", F.size("slots").alias("n"), F.xxhash64("id").alias("h")).collect()  # a row a document of the bounded sample
    fitting, free = [], max_entries or MAX_ENTRIES
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"])):
        if r["n"] <= free:
            fitting.append((r["id"],))
            free -= r["n"]
    some = sample.sparkSession.createDataFrame(fitting, f"id {kind}")
    rows = found.join(F.broadcast(some), "id", "left_semi").toArrow().combine_chunks().sort_by("id")
    labels = rows["label"].to_pylist()
    flat = lambda name, kind: np.asarray(rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False), kind)
    parts = np.repeat(np.arange(len(labels), dtype=np.int32), rows["sizes"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    entries = np.repeat(np.arange(len(parts), dtype=np.int32), flat("sizes", np.int64))
    return labels, parts, entries, flat("slots", np.int32), flat("values", np.float32) if valued else np.zeros(0)


class Adam:
    """Full-batch Adam on one array of parameters."""

    def __init__(self, n: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(n), np.zeros(n), 0

    def step(self, x: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))
