"""op10: every document scored for toxicity by a model of the labels that are not held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import fit, held_out, score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    return score(docs, fit(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
