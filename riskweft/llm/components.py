"""Connected components by iterated joins: every node takes the smallest label around it, then its label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node of the component.

    Each round is written to the shared folder, which cuts the lineage; it ends when no label changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.distinct(), "edges")
    labels, old = None, None
    while True:
        if labels is None:
            near = both.groupBy("a").agg(F.min("b").alias("near"))
            step = near.select(F.col("a").alias("node"), F.col("a").alias("was"), F.least("a", "near").alias("comp"))
        else:
            of = labels.select(F.col("node").alias("b"), "comp")
            near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
            step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        path = scratch.path("labels")
        step.write.option("compression", "zstd").parquet(path)
        step = scratch.spark.read.schema(step.schema).parquet(path)
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        jumped = scratch.path("jumped")
        step.join(jump, "comp").select("node", F.least("comp", "next").alias("comp"), "was").write.option("compression", "zstd").parquet(jumped)
        scratch.drop(path)
        if old:
            scratch.drop(old)
        old = jumped
        done = scratch.spark.read.schema("node long, comp long, was long").parquet(jumped)
        labels = done.select("node", "comp")
        if not done.where("comp <> was").limit(1).count():
            return labels
