"""op4: every document graded by a model of the quality labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordinal import fit, score

MIN_PROB = 0.5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).withColumn("kept", F.col("tail_prob") >= MIN_PROB)
