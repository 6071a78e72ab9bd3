"""op12: every vector whitened, on at most 16 components. Eigenvectors have no SQL form, so there is none."""

from pyspark.sql import DataFrame, SparkSession

from .whitening import whiten

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), COMPONENTS, SCALE, SHIFT)
