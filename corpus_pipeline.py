"""The corpus pipeline: from raw documents to token ids, each stage an operator of riskweft.llm.

Every stage gets what its predecessor kept, as Parquet read back; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskweft.llm import bpe, lines, minhash, mixing, ordinal
from riskweft.llm.common import Scratch
from riskweft.scratch import temporary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a wanted grade with a probability of a half or more. It learns from the labelled raw documents."""
    model = ordinal.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select_documents(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents or more hold stay in one of them."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return minhash.dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document comes as often as the mix takes it."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and their digests after a round trip."""
    tokenizer = bpe.Tokenizer.load(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.round_trip_digest(docs, tokenizer)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: The first stage is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage writes on the way goes when its result is written, and that when the next one's is."""
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary(spark):
            path = scratch.path(name.replace(" ", "-"))
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.drop(before)
        before = path
    return docs
