"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words (lower case, without punctuation at their ends), their first 4, 5 and 6 letters (the words of
inflected languages share stems), pairs of neighbours and pairs with one word between, hashed into a fixed number of coordinates; a feature is present or not. FTRL-proximal keeps a learning rate for
each coordinate and an L1 threshold that leaves most weights exactly zero, so what is broadcast for scoring is the sorted
list of the few that are not, at most as many as there are coordinates.

Scores depend on the text only. Null and empty texts get the learned bias. A sample with a single class, or none, gives that
class (0.5 with no labels). Repeated rows and null doc_ids give one row each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sovara.llm.common import code_points, doc_text, labelled_sample, mix, sigmoid, text_chunks, words_of

BITS, EPOCHS = 22, 4
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0


_SHIFT = np.uint64(64 - BITS)


def _of_words(words: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A hash of each distinct word, and for words and stems: whether the word has it, and its coordinate."""
    plain = pc.utf8_trim(pc.utf8_lower(words), ".,;:!?\"'()[]{}*#$%&|<>-_")
    if not len(plain):
        return np.zeros(0, np.uint64), []
    points, start = code_points(plain, right="\x00")
    length = np.diff(start)
    place = np.arange(len(points), dtype=np.int64) - np.repeat(start[:-1], length)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))))])
    upto = lambda n: mix(total[np.minimum(start[:-1] + n, start[1:])] - total[start[:-1]] + np.uint64(1))
    whole = upto(length)
    single = [(np.ones(len(plain), bool), (whole >> _SHIFT).astype(np.int64))]
    return whole, single + [(length - 1 > n, (mix(upto(n) + np.uint64(n)) >> _SHIFT).astype(np.int64)) for n in STEMS]


def features(text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every feature occurrence; only of the coordinates marked in `wanted`, if given."""
    codes, words, counts = words_of(text)
    whole, single = _of_words(words)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for has, coordinate in single:
        at = np.flatnonzero((has if wanted is None else has & wanted[coordinate])[codes])
        rows.append(row[at])
        found.append(coordinate[codes[at]])
    token = whole[codes]
    for gap, salt in ((1, 0x51), (2, 0x7F)):
        coordinate = (mix(token[:-gap] * np.uint64(3) + token[gap:] + np.uint64(salt)) >> _SHIFT).astype(np.int64)
        inside = row[:-gap] == row[gap:]
        at = np.flatnonzero(inside if wanted is None else inside & wanted[coordinate])
        rows.append(row[at])
        found.append(coordinate[at])
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    """Coordinates with weights other than zero, in order, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.at] = True
        row, coordinate = features(text, wanted)
        present = np.unique((row << BITS) | coordinate)
        weight = self.weight[np.searchsorted(self.at, present & ((1 << BITS) - 1))] if len(present) else np.zeros(0)
        return sigmoid(self.bias + np.bincount(present >> BITS, weight, minlength=len(text)))


def train(text: pa.Array, label: np.ndarray, seed: int = 5) -> Model:
    none = np.zeros(0, np.int64), np.zeros(0)
    rate = label.mean() if len(label) else 0.5
    if not len(label) or not 0 < rate < 1:
        return Model(*none, float(np.log(rate + 1e-3) - np.log(1 - rate + 1e-3)) if len(label) else 0.0)
    parts, sizes = [], []
    for a in range(0, len(label), 100):  # few texts at a time: the driver's memory is small
        piece = text.slice(a, 100)
        row, coordinate = features(piece)
        pairs = np.unique((row << BITS) | coordinate)
        parts.append((pairs & ((1 << BITS) - 1)).astype(np.int32))
        sizes.append(np.bincount(pairs >> BITS, minlength=len(piece)))
    edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    coordinate = np.concatenate(parts)
    present = np.zeros(1 << BITS, bool)
    present[coordinate] = True
    used = np.flatnonzero(present)
    dense = np.zeros(1 << BITS, np.int32)
    dense[used] = np.arange(len(used), dtype=np.int32)
    coordinate = dense[coordinate]
    z, n, w = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    bias_n = 0.0
    bias = float(np.log(rate / (1 - rate)))
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(label)):
            own = coordinate[edge[i] : edge[i + 1]]
            zi, ni = z[own], n[own]
            wi = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            g = float(sigmoid(np.array(wi.sum() + bias))) - label[i]
            z[own] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[own] = ni + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + bias_n**0.5)
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    keep = w != 0
    return Model(used[keep], w[keep], bias)


def fit(docs: DataFrame, labels: DataFrame, eligible, label: str = "toxic", max_rows: int = 8000, max_chars: int = 20_000) -> Model:
    """Learns from about max_rows labelled rows for which eligible(doc_id) holds, with texts of at most max_chars."""
    sample = labelled_sample(docs, labels, label, eligible, max_rows, max_chars)
    return train(sample["text"].combine_chunks(), np.asarray(sample["label"]).astype(int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score of class 1 and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_chunks(batches):
            value = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return doc_text(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")
