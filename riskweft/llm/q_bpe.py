"""op1: every document encoded and decoded by a public byte-level vocabulary."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import Tokenizer, round_trip_digest

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Tokenizer.load(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return round_trip_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
