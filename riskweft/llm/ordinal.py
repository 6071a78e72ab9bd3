"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut the scale:
P(grade > k) = sigmoid(w.x - threshold_k). The model gives the expected grade and the probability of a grade of at
least the wanted one, by which documents are selected.

Fitting uses at most `bound` labelled documents (a documented parameter), and fewer if their features exceed MAX_ENTRIES;
scoring reads every whole text, however long.

Edge cases: a null text scores like an empty one; null labels and labels without a document are ignored; with fewer
than two grades in the sample every document gets the only grade (or 0) and probability 1; repeated rows get equal
scores; an empty table gives an empty one; other columns pass through select_documents and are not read by score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .hashed import MEMO_WORDS, Adam, collected, labelled_sample, sigmoid, slot

DIMS = 1 << 16
#: Labelled documents to fit on, at most.
BOUND = 6000

_UPPER, _LOWER, _DIGIT, _RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
#: Characters stripped from a word.
PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&-"


def word_slots(word: str) -> tuple[int, int]:
    """Slots of the word and of its shape, where letters, capitals, digits and runs are folded."""
    shape = _RUN.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))
    return slot("w:" + word.strip(PUNCTUATION).lower(), DIMS), slot("s:" + shape, DIMS)


def rest_slots(n: int, distinct: int, repeats: int, lines: list[str]) -> tuple[list[int], list[float]]:
    """Slots and values of what the text is like as a whole."""
    slots = [slot(f"n:{n.bit_length()}", DIMS), slot("repeats", DIMS), slot("lines", DIMS), slot(f"same:{n.bit_length()}", DIMS)]
    return slots, [1.0, 10.0 * repeats / max(1, n), 5.0 * (1 - len(set(lines)) / max(1, len(lines))), 5.0 * (1 - distinct / max(1, n))]


#: Value of a word that makes up the whole text.
SCALE = 10.0


def extract(text: str) -> list[tuple[list[int], list[float]]]:
    words = text.split()
    counts = Counter(words)
    total: dict[int, float] = {}
    for at, value in zip(*rest_slots(len(words), len(counts), sum(map(eq, words, words[1:])), text.split("\n")), strict=True):
        total[at] = total.get(at, 0.0) + value
    for word, count in counts.items():
        for at in word_slots(word):
            total[at] = total.get(at, 0.0) + SCALE * count / len(words)
    return [(list(total), list(total.values()))]


@dataclass
class OrdinalModel:
    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) for each score and threshold."""
        return sigmoid(z[:, None] - self.thresholds[None, :])

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(z) @ np.diff(self.grades).astype(np.float64)

    def tail(self, z: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= the given one)."""
        k = int(np.searchsorted(self.grades, grade))
        if k == 0 or len(self.grades) < 2:
            return np.ones(len(z))
        return np.zeros(len(z)) if k == len(self.grades) else self.tails(z)[:, k - 1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND, rounds: int = 250, l2: float = 1e-4) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam on the bounded sample, on the driver."""
    y, _, entries, slots, values = collected(labelled_sample(docs, labels, label_col, bound, id_col, text_col), extract)
    grades = sorted(set(y))
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(0), np.zeros(DIMS))
    used = np.flatnonzero(np.bincount(slots, minlength=DIMS))
    place = np.zeros(DIMS, np.int32)
    place[used] = np.arange(len(used))
    slots = place[slots]
    n, k = len(y), np.searchsorted(grades, y)
    w, steps = np.zeros(len(used)), np.log(np.full(len(grades) - 1, 1.0))
    steps[0] = 0.0  # the first threshold; the others follow it by exp(steps)
    by_w, by_t = Adam(len(w), 0.1), Adam(len(steps), 0.05)
    for _ in range(rounds):
        z = np.bincount(entries, values * w[slots], minlength=n)
        t = np.concatenate([[steps[0]], steps[0] + np.cumsum(np.exp(steps[1:]))])
        above = np.hstack([np.ones((n, 1)), sigmoid(z[:, None] - t[None, :]), np.zeros((n, 1))])  # P(grade index >= j)
        p = np.maximum(above[np.arange(n), k] - above[np.arange(n), k + 1], 1e-12)
        slope = above * (1 - above)
        d_up, d_down = slope[np.arange(n), k] / p, slope[np.arange(n), k + 1] / p
        g_z = -(d_up - d_down) / n
        g_t = (np.bincount(k, d_up, minlength=len(grades))[1:] - np.bincount(k + 1, d_down, minlength=len(grades) + 1)[1:-1]) / n
        g_steps = np.concatenate([[g_t.sum()], np.cumsum(g_t[::-1])[::-1][1:] * np.exp(steps[1:])])
        by_w.step(w, np.bincount(slots, values * g_z[entries], minlength=len(w)) + l2 * w)
        by_t.step(steps, g_steps)
    t = np.concatenate([[steps[0]], steps[0] + np.cumsum(np.exp(steps[1:]))])
    weights = np.zeros(DIMS)
    weights[used] = w
    return OrdinalModel(grades, t, weights)


class Scorer:
    """Linear score of a text; the weight of a word and its shape is remembered."""

    def __init__(self, model: OrdinalModel):
        self.weights, self.memo = model.weights.tolist(), {}

    def __call__(self, text: str) -> float:
        words = text.split()
        counts = Counter(words)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, weights = self.memo, self.weights
        for word in set(counts).difference(memo):
            a, b = word_slots(word)
            memo[word] = weights[a] + weights[b]
        slots, values = rest_slots(len(words), len(counts), sum(map(eq, words, words[1:])), text.split("\n"))
        of_words = sum(map(mul, map(memo.__getitem__, counts), counts.values()))
        return SCALE * of_words / max(1, len(words)) + sum(weights[s] * v for s, v in zip(slots, values, strict=True))


def score(docs: DataFrame, model: OrdinalModel, grade: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, tail_prob) of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            z = np.array([scorer(x.as_py() or "") for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.expected(z)), pa.array(shared.value.tail(z, grade))], [id_col, "expected_grade", "tail_prob"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, expected_grade double, tail_prob double")


def select_documents(docs: DataFrame, model: OrdinalModel, grade: int = 1, min_prob: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose probability of the wanted grade is min_prob or more."""
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            z = np.array([scorer(x.as_py() or "") for x in batch.column(at)])
            yield batch.filter(pa.array(shared.value.tail(z, grade) >= min_prob, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
