"""Packing by decomposition into powers of two: training sequences without padding and without documents side by side.

A document's token ids, with an end id behind them, are cut into pieces whose lengths are the whole sequences and then the
binary digits of what is left, longest first. Each piece is a sequence of its own, so no sequence crosses documents and
none needs padding; pieces of equal length form a bucket, from which batches of one shape are drawn.

Sequences are numbered without gaps, bucket by bucket, longest first, so a bucket is a range of numbers. Each task counts
its pieces of every length while it cuts; pieces are written with task and place, and the numbers before each task are
prefix sums over (length, task), which are few. The rows themselves are neither sorted nor shuffled by length.

Ids are those of the `tokenizers` library for the vocabulary file, without special tokens: their strings in a text are
ordinary text. Where ranks and merges of the file agree, they come from `tiktoken`, which gives the same ids some four
times faster; texts with a very long run of characters without a blank, or of blanks, go to `tokenizers`, which takes
such runs in bounded time and stack.

Edge cases: a null or empty text is the end id alone, one piece of length 1; very long texts are encoded whole; repeated
rows and null ids are documents each, with sequences of their own; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Bytes of a vocabulary file that is sent to executors, at most; characters of a batch of texts, about.
MAX_FILE, BATCH_CHARS = 64 << 20, 4 << 20
#: A run of so many characters without a blank, or of blanks, is long.
_LONG = re.compile(r"\S{4096}|\s{4096}")


class Encoder:
    """Token ids of texts by a vocabulary file of the `tokenizers` library and the pattern that its ranks go with."""

    def __init__(self, spec: str, pattern: str):
        if len(spec) > MAX_FILE:
            raise ValueError("the vocabulary is larger than what is sent to executors")
        self.spec, self.pattern = spec, pattern

    @cached_property
    def library(self):
        """Made where a text needs it, which is seldom."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.spec)
        library.encode_special_tokens = True
        return library

    @cached_property
    def fast(self):
        import tiktoken

        ranks = byte_ranks(json.loads(self.spec))
        return None if ranks is None else tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), pattern)

    def __reduce__(self):
        return _encoder, (self.spec, self.pattern)  # a worker has one, however many queries it serves

    def ids(self, text: str) -> list[int]:
        if self.fast is None or len(text) >= 4096 and _LONG.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=1)
def _encoder(spec: str, pattern: str) -> Encoder:
    return Encoder(spec, pattern)


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of the byte strings of a byte-level vocabulary; None unless the ids order its merges, as ranks would."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocabulary.get(m, -1) for m in merged]
    if order != sorted(set(order)) or min(order, default=0) < 0 or len(vocabulary) != 256 + len(merged):
        return None
    return {bytes(map(letter.__getitem__, token)): i for token, i in vocabulary.items()}


def cuts(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then falling powers of two."""
    left = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pieces(docs: DataFrame, encoder: Encoder, longest: int, end: int, id_col: str, text_col: str, tokens: bool) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, task, place[, ids]): place counts the pieces of this length in the task."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(encoder)  # bounded by MAX_FILE
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"] + ["ids"] * tokens

    def batch_of(rows: list[tuple], key: pa.DataType, task: int) -> pa.RecordBatch:
        column = lambda i, kind: pa.array([r[i] for r in rows], kind)
        out = [column(0, key), column(1, pa.int64()), column(2, pa.int64()), column(3, pa.int64()), column(4, pa.int64()), pa.array([task] * len(rows), pa.int32()), column(5, pa.int64())]
        if tokens:
            offsets = pa.array(np.cumsum([0, *(r[2] for r in rows)]), pa.int32())
            out.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[6] for r in rows]), pa.int32())))
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, places = shared.value, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, size = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.array([*encoder.ids(text), end], "<u4")
                start = 0
                for length in cuts(len(ids), longest):
                    own = ids[start : start + length]
                    rows.append((key, start, length, zlib.crc32(own.tobytes()), len(ids), places[length], own))
                    places[length] += 1
                    start += length
                size += len(text)
                if size >= BATCH_CHARS:
                    yield batch_of(rows, batch.schema.field(0).type, task)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows, batch.schema.field(0).type, task)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, place long" + ", ids array<int>" * tokens)


def pack(docs: DataFrame, encoder: Encoder, longest: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens: bool = True) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<int>]): a row a piece. longest: a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    cut = Scratch(docs.sparkSession, "packing").keep(pieces(docs, encoder, longest, end, id_col, text_col, tokens), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("all"))  # a row a power of two
    longer = F.coalesce(F.sum("all").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    first = counts.withColumn("earlier", earlier).join(buckets.withColumn("longer", longer), "length").select("length", "task", (F.col("longer") + F.col("earlier")).alias("first"))
    numbered = cut.join(first, ["length", "task"])
    return numbered.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * tokens)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences in a folder a length (length=2048, ...), so batches of one shape are read from one folder."""
    packed.write.option("compression", "zstd").partitionBy("length").parquet(path)
