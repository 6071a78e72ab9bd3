"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic if a sentence is: its score is the noisy-or of its sentences' probabilities. The weights of hashed
words are fitted to document labels through the noisy-or, and then locate the sentences that offend.

Fitting uses at most `bound` labelled documents of each label (a documented parameter), and fewer if their features exceed
MAX_ENTRIES; scoring reads every whole text, however long.

Edge cases: null and empty texts have no sentence and score 0; null labels are ignored; without a toxic label in the
sample every score is near 0; repeated rows get equal scores; an empty table gives an empty one; columns other than the
named ones are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .hashed import MEMO_WORDS, Adam, collected, labelled_sample, sigmoid, slot
from .ordinal import PUNCTUATION

DIMS = 1 << 18
#: Labelled documents of each label to fit on, at most.
BOUND = 1500
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5)
#: A slot counts if so many sentences of the sample have it.
MIN_SENTENCES = 3

_SENTENCE = re.compile(r"[^.!?\n]+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.findall(text) if not s.isspace()]


def word_slots(word: str) -> tuple[int, ...]:
    """Slots of the word and of its beginnings, which inflected forms share."""
    word = word.strip(PUNCTUATION).lower()
    return tuple({slot("w:" + word, DIMS), *(slot(f"{n}:" + word[:n], DIMS) for n in PREFIXES if len(word) >= n)})


def extract(text: str) -> list[tuple[list[int], list[float]]]:
    out = []
    for sentence in sentences(text):
        slots = sorted({s for w in sentence.split() for s in word_slots(w)})
        out.append((slots, [1.0] * len(slots)))
    return out


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[int, float]  # of slots that count


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND, rounds: int = 300, l1: float = 2e-5) -> ToxicityModel:
    """Penalised maximum likelihood of the noisy-or by full-batch Adam on the bounded sample, on the driver."""
    y, parts, entries, slots, _ = collected(labelled_sample(docs, labels, label_col, bound, id_col, text_col, per_label=True), extract, valued=False)
    y = np.array(y, np.float64) > 0
    if not y.any() or not len(slots):
        return ToxicityModel(-20.0, {})
    often = np.bincount(slots, minlength=DIMS) >= MIN_SENTENCES
    keep = often[slots]
    entries, slots = entries[keep], slots[keep]
    used = np.flatnonzero(often)
    place = np.zeros(DIMS, np.int32)
    place[used] = np.arange(len(used))
    slots = place[slots]
    n, m = len(y), len(parts)
    x = np.concatenate([np.zeros(len(used)), [-6.0]])
    adam = Adam(len(x), 0.1)
    for _ in range(rounds):
        z = np.bincount(entries, x[slots], minlength=m) + x[-1]
        p = sigmoid(z)
        clean = np.bincount(parts, -np.logaddexp(0, z), minlength=n)  # log of the product of 1 - p
        miss = np.exp(clean)
        factor = np.where(y, -miss / np.maximum(1 - miss, 1e-9), 1.0)
        g = p * factor[parts] / n
        adam.step(x, np.concatenate([np.bincount(slots, g[entries], minlength=len(used)) + l1 * np.sign(x[:-1]), [g.sum()]]))
    return ToxicityModel(float(x[-1]), {int(s): float(w) for s, w in zip(used, x, strict=False) if abs(w) > 1e-3})


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.bias, self.weights, self.memo = model.bias, model.weights, {}

    def sentences(self, found: list[str]) -> np.ndarray:
        """Linear score of each sentence. A slot counts once in a sentence."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, weights = self.memo, self.weights
        cut = [set(s.split()) for s in found]
        for word in set().union(*cut).difference(memo):
            memo[word] = {at: w for at in word_slots(word) if (w := weights.get(at))}
        out = []
        for ws in cut:
            slots: dict[int, float] = {}
            for x in map(memo.__getitem__, ws):
                if x:
                    slots |= x
            out.append(self.bias + sum(slots.values()))
        return np.array(out, np.float64)

    def document(self, text: str) -> float:
        found = sentences(text)
        return float(-np.expm1(-np.logaddexp(0, self.sentences(found)).sum())) if found else 0.0


def held_out(id_col: str) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text is a multiple of 5. A null id is like an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.document(x.as_py() or "") for x in batch.column(1)], pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def locate(docs: DataFrame, model: ToxicityModel, min_prob: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, stop, sentence, prob): the sentences that offend, by code points of the text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [x for x in _SENTENCE.finditer(text or "") if not x[0].isspace()]
                probs = sigmoid(scorer.sentences([x[0] for x in found])) if found else []
                rows += [(key, x.start(), x.end(), x[0], float(p)) for x, p in zip(found, probs, strict=True) if p >= min_prob]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [id_col, "start", "stop", "sentence", "prob"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start int, stop int, sentence string, prob double")
