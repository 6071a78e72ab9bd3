"""Sinks: splits, environments, instruction files, metrics, reports, models."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweft.scratch import file_system, remove
from riskweft.sources.readers import exists


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text through the file system of the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # a small file


def save_splits(df: DataFrame, folder: str, fmt: str = "parquet", names: tuple[str, ...] = ("train", "val", "test")) -> None:
    """One folder for each value of split."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    for name in names:
        part = df.where(F.col("split") == name).drop("split").write.mode("overwrite")
        part.option("header", True).csv(f"{folder}/{name}") if fmt == "csv" else part.parquet(f"{folder}/{name}")


def save_environment(env: Mapping[str, DataFrame], folder: str, metadata: Mapping[str, Any] | None = None, fmt: str = "parquet") -> None:
    """The tables, and metadata.json with row counts, the scenario breakdown and the fraud rate."""
    from riskweft.sources.readers import read_environment

    for name, df in env.items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}.csv") if fmt == "csv" else writer.parquet(f"{folder}/{name}.parquet")
    spark = env["transactions"].sparkSession
    written = read_environment(spark, folder, fmt)  # counted as written, not computed again
    counts = {name: written[name].count() for name in env}
    tx = written["transactions"]
    breakdown = [r.asDict() for r in scenario_breakdown(tx).collect()]  # a row a scenario
    rate = fraud_rate(tx).first()["fraud_rate"]
    write_text(spark, f"{folder}/metadata.json", json.dumps({"config": dict(metadata or {}), "rows": counts, "scenarios": breakdown, "fraud_rate": rate}, indent=2, default=str))


def scenario_breakdown(tx: DataFrame) -> DataFrame:
    """(scenario_tag, n_total, n_fraud); rows without a tag are a group."""
    return tx.groupBy("scenario_tag").agg(F.count("*").alias("n_total"), F.coalesce(F.sum("label_fraud"), F.lit(0)).cast("long").alias("n_fraud"))


def fraud_rate(tx: DataFrame) -> DataFrame:
    return tx.agg(F.coalesce(F.avg("label_fraud"), F.lit(0.0)).alias("fraud_rate"))


def save_dataset(df: DataFrame, folder: str, single: bool = False) -> None:
    """JSON lines under split=train|val|test; columns that begin with _ are left out. single: one file, train.jsonl and so
    on, in the order of the rows' JSON, for each split (a small dataset)."""
    if single:
        lines = df.select(F.col("split"), F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")])).alias("value"))
        for name in [r["split"] for r in lines.select("split").distinct().collect()]:  # a row a split
            _one_file(lines.where(F.col("split") == name).select("value").orderBy("value").coalesce(1), f"{folder}/{name}.jsonl")
        return
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode("overwrite").partitionBy("split").json(folder)


def _one_file(lines: DataFrame, path: str) -> None:
    """The lines in a single file: written by one task, and moved to its place."""
    fs, at = file_system(lines.sparkSession, path)
    beside = f"{path}.parts"
    lines.write.mode("overwrite").text(beside)
    parts = [s.getPath() for s in fs.listStatus(file_system(lines.sparkSession, beside)[1]) if s.getPath().getName().startswith("part-")]
    fs.delete(at, False)
    fs.rename(parts[0], at)
    remove(lines.sparkSession, beside)


def write_metrics(row: DataFrame, path: str) -> dict[str, Any]:
    """A one-row frame as JSON."""
    found = row.first().asDict()
    write_text(row.sparkSession, path, json.dumps(found, indent=2, default=str))
    return found


def report(title: str, metrics: Mapping[str, Any]) -> str:
    """Markdown table of metrics."""
    lines = [f"# {title}", "", "| metric | value |", "| --- | --- |"]
    return "\n".join([*lines, *[f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in metrics.items()], ""])


#: What an export folder holds.
EXPORT_LAYOUT = ("model", "scaler.json", "threshold.json", "feature_columns.json", "metrics.json", "report.md")


def export_all(spark: SparkSession, folder: str, model: Any, scaler: Mapping[str, Any], threshold: float, columns: list[str], metrics: Mapping[str, Any]) -> list[str]:
    """Model and its companions in EXPORT_LAYOUT. All figures are given; none is made up."""
    from riskweft.ml.models import save

    save(spark, model, f"{folder}/model")
    for name, value in (("scaler", dict(scaler)), ("threshold", {"threshold": threshold}), ("feature_columns", columns), ("metrics", dict(metrics))):
        write_text(spark, f"{folder}/{name}.json", json.dumps(value, indent=2, default=str))
    write_text(spark, f"{folder}/report.md", report("Model report", metrics))
    return missing_exports(spark, folder)


def missing_exports(spark: SparkSession, folder: str) -> list[str]:
    """Parts of the layout that are not there."""
    return [name for name in EXPORT_LAYOUT if not exists(spark, f"{folder}/{name}")]
