"""Packing against the tokenizer library, on given tables and on odd documents."""

import json
import zlib

import edge
import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskweft.llm import packing, q_packing

PATH = P.path(q_packing.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder.load(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(got, texts, library, longest=2048, tokens=None):
    """texts: list of (doc_id, text), ids unique."""
    got = got.sort_values(["doc_id", "start"])
    assert sorted(got["sequence_id"]) == list(range(len(got))) and (got["offset"] == 0).all()
    assert (np.diff(got.sort_values("sequence_id")["length"]) <= 0).all()  # a bucket is a range of numbers
    by = {i: rows for i, rows in got.groupby("doc_id")}
    assert set(by) == {i for i, _ in texts}
    for i, text in texts:
        ids, at = [*library(text or ""), 1], 0
        for row in by[i].to_dict("records"):
            own = ids[row["start"] : row["start"] + row["length"]]
            assert row["start"] == at and row["length"] & (row["length"] - 1) == 0 and row["length"] <= longest and row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            assert "ids" not in row or list(row["ids"]) == own
            at += row["length"]
        assert at == len(ids)


def test_given_table(spark, library):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(q_packing.query(spark, SF).toPandas(), texts, library)


def test_odd_documents(spark, encoder, library):
    df = edge.docs(spark)
    got = packing.pack(df, encoder).toPandas()
    assert len(got) == got["sequence_id"].nunique() and got["sequence_id"].max() == len(got) - 1
    sums = got.groupby("doc_id", dropna=False)["length"].sum()
    copies = {i: sum(r[0] == i for r in edge.rows()) for i, *_ in edge.rows()}
    assert all(sums[i] == copies[i] * (len(library(t or "")) + 1) for i, t, *_ in edge.rows() if i is not None)
    once = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = [(i, t) for i, t, *_ in {r[0]: r for r in edge.rows() if r[0] is not None}.values()]
    check(packing.pack(once, encoder, 16).toPandas(), texts, library, 16)
    assert packing.pack(edge.none(spark), encoder).count() == 0


def test_buckets(spark, encoder, tmp_path):
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), encoder, 256)
    packing.write_buckets(packed, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.where("size(ids) <> length").count() == 0 and back.count() == packed.count()
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"length={1 << i}" for i in range(9)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'ste.,019éÉß\x00\x1c\x85　")), max_size=60))
def test_same_as_library(encoder, library, text):
    assert encoder.ids(text) == library(text)


def test_tokens_specials_and_long_runs(encoder, library):
    assert encoder.fast is not None
    texts = [t for t in (encoder.fast.decode_bytes([i]).decode("utf-8", "ignore") for i in range(50256)) if t]
    assert [encoder.ids(t) for t in texts] == [library(t) for t in texts]
    for text in ("<|endoftext|> and <|endoftext|>", "a" * 30_000, " " * 30_000 + "x", "\n" * 9000, "汉" * 20_000, "ab" * 5000 + " x"):
        assert encoder.ids(text) == library(text)


def test_other_vocabularies_use_the_library():
    assert packing.byte_ranks(json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))) is None
    other = packing.Encoder.load(P.path("word_bpe_49k.json"), P.PATTERN)
    assert other.fast is None and other.ids("Two words") == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode("Two words", add_special_tokens=False).ids


def test_cuts():
    for n in (1, 2, 3, 2047, 2048, 2049, 9999):
        assert sum(packing.cuts(n, 2048)) == n and packing.cuts(n, 2048) == sorted(packing.cuts(n, 2048), reverse=True)
    assert packing.cuts(5000, 2048) == [2048, 2048, 512, 256, 128, 8] and packing.cuts(0, 2048) == []
