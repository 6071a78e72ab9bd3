"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves; the others are
merged by a heap over a linked list of their bytes. Text is never cut: a batch holds whole documents.

Edge cases: a null text encodes like an empty one (no ids, empty bytes); repeated rows give repeated results; a very long
text, with or without blanks, is encoded whole, and long pieces of it are not remembered; an empty table gives an empty
one; columns other than the two named ones are neither read nor returned.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import ship

#: A vocabulary is sent to all executors; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of pieces and their ids that a worker remembers before it starts a new memo; the one before is kept beside it.
MEMO_BYTES = 64 << 20
#: What an entry takes besides, and the characters of the longest piece that is remembered.
ENTRY_BYTES, MEMO_CHARS = 200, 64
#: Bytes of text after which a batch of results is handed on.
BATCH_BYTES = 4 << 20

_SHORT = 64
_AFTER, _BEFORE = list(range(1, _SHORT + 1)), list(range(-1, _SHORT - 1))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _level_hash(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * int(_MIX) % 2**64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: A blank beside other white space, or at an end of the text.
_ODD_BLANK = re.compile(r" (?=\s|\Z)|(?:\s|\A) ").search


def _cut(text: str) -> list[str]:
    """The text cut before each blank that stands between two visible characters."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if not part or part[0].isspace() or not (last := out[-1]) or last[-1].isspace():
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return out


class PerfectHash:
    """Minimal perfect hash of byte strings, in levels of bit arrays.

    Keys that fall alone on a bit of a level stay there, the rest go to the next level; the rank of a bit is the slot.
    slots(keys) gives for each key its slot, or -1 if it is no key.
    """

    LOAD = 1.6

    def __init__(self, keys: list[bytes]):
        left = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))
        if len(np.unique(left)) != len(keys):
            raise ValueError("keys repeat")
        self.levels: list[tuple[int, np.ndarray]] = []
        base = 0
        while len(left):
            m = max(64, int(len(left) * self.LOAD))
            at = (_level_hash(left, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            rank = np.where(alone, base + np.cumsum(alone) - 1, -1)
            self.levels.append((m, rank))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.keys: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self._candidates(keys).tolist(), strict=True):
            self.keys[slot] = key

    def _candidates(self, keys: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (m, rank) in enumerate(self.levels):
            if not len(left):
                break
            slot = rank[(_level_hash(h[left], level) % np.uint64(m)).astype(np.int64)]
            out[left] = slot
            left = left[slot < 0]
        return out

    def slots(self, keys: list[bytes]) -> list[int]:
        own = self.keys
        return [s if s >= 0 and own[s] == k else -1 for s, k in zip(self._candidates(keys).tolist(), keys, strict=True)]


class Tokenizer:
    """Vocabulary with ranks as ids, the pattern that cuts text into pre-tokens, and both ways between text and ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is larger than what is sent to executors")
        if len(ranks) >= 1 << 20 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a byte or has over a million tokens")
        import regex

        self.pattern, self.find = pattern, regex.compile(pattern).findall
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.slot_id = [0] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(tokens), strict=True):
            self.slot_id[slot] = ranks[token]
        size = max(ranks.values(), default=-1) + 1
        self.bytes_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    self.pairs[a << 20 | b] = rank
        self.byte_pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        flat = bytearray(int(self.lengths.sum()))
        for token, rank in ranks.items():
            flat[self.starts[rank] : self.starts[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo, about
        self.once: list[str] = []  # pieces too long to be remembered

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        """From a file with a base64 token and its rank in each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def __reduce__(self):
        ranks = {key: rank for key, rank in zip(self.hash.keys, self.slot_id, strict=True)}
        return Tokenizer, (ranks, self.pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: lowest rank first, leftmost among equals, from a heap of linked pairs.

        An entry of the heap holds rank and place in one number; now[place] is the rank that still holds there, so
        entries of pairs that have changed meanwhile are passed over.
        """
        ids = list(map(self.bytes_id.__getitem__, piece))
        n, pair, first = len(ids), self.pairs.get, self.byte_pairs
        bits = n.bit_length()
        low = (1 << bits) - 1
        now = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        now.append(-1)
        after, before = (_AFTER[:n], _BEFORE[:n]) if n <= _SHORT else (list(range(1, n + 1)), list(range(-1, n - 1)))
        heap = [rank << bits | i for i, rank in enumerate(now) if rank >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & low
            rank = x >> bits
            if now[i] != rank:
                continue
            ids[i] = rank
            j = after[i]
            ids[j] = now[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = r = pair(rank << 20 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = pair(ids[h] << 20 | rank, -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces of text, which may hold several pre-tokens, and of these into the memo."""
        find, memo = self.find, self.memo
        cut = [(piece, find(piece)) for piece in pieces]
        texts = self.recall({x for _, found in cut for x in found}.difference(memo))
        tokens = list(map(str.encode, texts))
        for text, token, slot in zip(texts, tokens, self.hash.slots(tokens), strict=True):
            self.remember(text, array("i", [self.slot_id[slot]] if slot >= 0 else self.merge(token)).tobytes())
        for piece, found in cut:
            if len(found) > 1:
                self.remember(piece, b"".join(map(memo.__getitem__, found)))

    def remember(self, piece: str, ids: bytes) -> None:
        self.memo[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES
        if len(piece) > MEMO_CHARS:
            self.once.append(piece)

    def forget_long(self) -> None:
        for piece in self.once:
            self.held -= len(piece) + len(self.memo.pop(piece)) + ENTRY_BYTES
        self.once = []

    def recall(self, pieces: set[str]) -> set[str]:
        """Takes over what the older memo has of the pieces; the rest is new."""
        old = self.old
        if old:
            for piece in pieces:
                if (ids := old.get(piece)) is not None:
                    self.remember(piece, ids)
            return pieces.difference(self.memo)
        return pieces

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text.

        A pre-token never reaches over the place between a visible character and a blank before a visible one, so the
        text is cut at such blanks; each piece is looked up as the pattern, the hash and the heap would give it.
        """
        if not text:
            return np.zeros(0, np.int32)
        if _ODD_BLANK(text):
            pieces = _cut(text)
        else:
            pieces = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _cut(text)
        if self.held > MEMO_BYTES:
            self.memo, self.old, self.held = {}, self.memo, 0
        if (new := set(pieces).difference(self.memo)) and (new := self.recall(new)):
            self.learn(new)
        ids = np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), np.int32)
        if self.once:
            self.forget_long()
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, which need not be valid UTF-8."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[at + np.arange(ends[-1])].tobytes()


def _ids_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids array<int>): ids of every whole text, without special tokens; with decoded, also the bytes that the
    ids give again, from the same pass."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # bounded by MAX_VOCABULARY_BYTES
    names = [id_col, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value

        def result(keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
            back = [pa.array(map(tok.decode, ids), pa.binary())] if decoded else []
            return pa.RecordBatch.from_arrays([keys, _ids_array(ids), *back], names)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            done, start, size = [], 0, 0
            for i, text in enumerate(texts):
                s = text.as_py() or ""
                done.append(tok.encode(s))
                size += len(s)
                if size >= BATCH_BYTES:
                    yield result(keys.slice(start, i + 1 - start), done)
                    done, start, size = [], i + 1, 0
            if done:
                yield result(keys.slice(start), done)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded binary) from (id_col, ids)."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)  # bounded by MAX_VOCABULARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            texts = [tok.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], [id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def round_trip_digest(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every document, after encoding and decoding it."""
    both = encode(docs, tokenizer, id_col, text_col, decoded=True)
    return both.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit(b"")), 256).alias("decoded_sha256"),
    )
