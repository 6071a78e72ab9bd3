"""op8: all documents in 16 shards of near equal bytes."""

from pyspark.sql import DataFrame, SparkSession

from .sharding import shard_documents

SHARDS = 16


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
