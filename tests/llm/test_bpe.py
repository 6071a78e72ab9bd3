import base64
import hashlib
import random

import edge
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweft.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tok():
    return bpe.Tokenizer.load(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(tok):
    keys = tok.hash.keys
    assert sorted(tok.hash.slots(keys)) == list(range(len(keys)))
    assert tok.hash.slots([b"\xff\xfe no token", b""]) == [-1, -1]
    with pytest.raises(ValueError, match="repeat"):
        bpe.PerfectHash([b"a", b"a"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'ste.,019éÉß\x00\x1c\x85　")), max_size=60))
def test_same_as_library(tok, reference, text):
    ids = tok.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text) and tok.decode(ids) == text.encode()


def test_long_pieces(tok, reference):
    r = random.Random(1)
    for text in ("a" * 2500, "".join(r.choice("abc") for _ in range(3000)), " " * 500 + "x", "\n" * 300):
        assert tok.encode(text).tolist() == reference.encode_ordinary(text)


def test_memo_starts_anew(tok, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3 * bpe.ENTRY_BYTES)
    for text in ("some words that are more than three", "some other words after that", "some words"):
        assert tok.encode(text).tolist() == reference.encode_ordinary(text)


def test_texts_without_blanks_are_not_remembered(reference):
    """Each a single piece: encoded whole, but the memo stays small."""
    tok, r = bpe.Tokenizer.load(PATH, P.PATTERN), random.Random(3)
    hanzi = [chr(0x4E00 + i) for i in range(3000)]
    for text in ["".join(r.choices(hanzi, k=4000)) for _ in range(30)] + ["".join(r.choices("ABCDabcd0123+/", k=5000)) for _ in range(10)]:
        assert tok.encode(text).tolist() == reference.encode_ordinary(text)
    size = sum(len(k) + len(v) + bpe.ENTRY_BYTES for k, v in tok.memo.items())
    assert tok.held == size and not tok.once and max(map(len, tok.memo), default=0) <= bpe.MEMO_CHARS


def test_edges(spark, tok, reference):
    got = sorted(map(tuple, bpe.round_trip_digest(edge.docs(spark), tok).collect()), key=str)
    want = []
    for i, t, *_ in edge.rows():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip_digest(edge.none(spark), tok).count() == 0


def test_vocabulary_is_checked():
    with pytest.raises(ValueError, match="byte"):
        bpe.Tokenizer({b"a": 0}, P.PATTERN)
