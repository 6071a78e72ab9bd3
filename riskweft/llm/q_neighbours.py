"""op9: the ten nearest neighbours of every hundredth vector, against all vectors."""

from pyspark.sql import DataFrame, SparkSession

from .neighbours import nearest

QUERY_STEP, K, TREES, RECALL = 100, 10, 16, 0.9


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), QUERY_STEP, K, TREES, RECALL)
