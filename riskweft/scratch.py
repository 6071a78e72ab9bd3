"""Folders and tables that operators write on the way: in the session's checkpoint folder, or on a local master in a temporary one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only on a local master, where driver and executors are one process, a temporary folder stands in for it.
    """
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = f"file://{tempfile.mkdtemp(prefix='riskweft-')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Folders made within each open `temporary`.
_MADE: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new empty folder in the shared one; it goes when the driver ends, since lazy results may read it until then."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes the folders made within, for callers that have written what they want of them."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows written once and read back, so nothing before them is computed again and a lost executor costs only its tasks."""
    path = f"{scratch_path(df.sparkSession, label)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[Column | str], label: str, out: str = "__p") -> DataFrame:
    """The rows dealt into ranges of the order, written with the number of their range, which rises with the order.

    The ranges come from a sample, so a plan that deals twice may deal differently; written, the number is a fact.
    """
    return kept(df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn(out, F.spark_partition_id()), label)


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """The rows, of which there are so many, dealt by the keys into tasks of about `each`, one a core at least.

    The number of tasks is given, so adaptive execution doesn't merge them: it goes by compressed bytes, which say little
    of what the sorts of a task will hold.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)
