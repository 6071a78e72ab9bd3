"""op13: every document cut into sequences of 1 to 2048 token ids."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .packing import Encoder, pack

VOCABULARY, LONGEST, END = "byte_bpe_50k.json", 2048, 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = Encoder.load(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), encoder, LONGEST, END, tokens=False)
