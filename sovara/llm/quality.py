"""Quality classifier by supervised subword embeddings.

A text's features are its words, the character 3- to 5-grams of its words and, for a word that repeats the one before it,
the repetition itself, all hashed into a fixed number of buckets. Each
bucket has a learned vector; a document is the mean of its features' vectors, and a softmax over a linear layer gives the
classes. Training is stochastic gradient descent in numpy on a bounded sample of labelled rows. For scoring, vectors and
output layer are folded into one number per bucket (the model is linear up to the softmax), which is broadcast: its size is
the number of buckets, whatever the corpus.

Scores depend on the text only. Null and empty texts have no features and get the learned prior. A sample with a single
class, or none, gives that class (0.5 with no labels). Repeated rows and null doc_ids give one row each; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import code_points, doc_text, labelled_sample, mix, sigmoid, sums, text_chunks, word_hashes, words_of

BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 10, 6, 0.5
GRAMS = (3, 4, 5)
#: The bucket of repetition, and the number of features without effect that every text has besides its own.
ECHO, SMOOTH = BUCKETS - 1, 20


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the distinct words one after another, and how many each word has."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points, start = code_points(words, "<", ">")
    owner = np.repeat(np.arange(len(words)), np.diff(start))
    buckets, owners = [word_hashes(words)], [np.arange(len(words))]
    rolled = points.astype(np.uint64) + np.uint64(7)
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(1_000_003) + points[n - 1 :]
        if n in GRAMS and len(rolled):
            inside = owner[: len(rolled)] == owner[n - 1 :]
            buckets.append(mix(rolled[inside] + np.uint64(n << 56)))
            owners.append(owner[: len(rolled)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(buckets)[order] % np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(owners, minlength=len(words))


def echoes(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per word: whether it is the word before it in the same text, so that repetition counts whatever is repeated."""
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(codes), bool)
    out[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    return out


@dataclass
class Model:
    """logit: what each bucket adds to the logit of class 1 against class 0; a document's is prior + mean."""

    logit: np.ndarray
    prior: float

    def score(self, text: pa.Array) -> np.ndarray:
        codes, words, counts = words_of(text)
        buckets, each = word_features(words)
        value = sums(self.logit[buckets].astype(np.float64), each)
        echo = echoes(codes, counts)
        total = sums(value[codes] + self.logit[ECHO] * echo, counts)
        return sigmoid(self.prior + total / (sums(each[codes] + echo, counts) + SMOOTH))


def _shares(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct features and what part of its mean each one makes."""
    codes, words, counts = words_of(text)
    buckets, each = word_features(words)
    first, echo = np.cumsum(each) - each, echoes(codes, counts)
    documents, at = [], 0
    for n in counts:
        own, again = codes[at : at + n], int(echo[at : at + n].sum())
        at += n
        size = each[own]
        index = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found, many = np.unique(np.concatenate([buckets[index], np.full(again, ECHO)]), return_counts=True)
        documents.append((found.astype(np.int32), (many / (many.sum() + SMOOTH)).astype(np.float32)))
    return documents


def train(text: pa.Array, label: np.ndarray, seed: int = 11) -> Model:
    rate = label.mean() if len(label) else 0.5
    if not len(label) or not 0 < rate < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate + 1e-3) - np.log(1 - rate + 1e-3)) if len(label) else 0.0)
    documents = [d for a in range(0, len(label), 100) for d in _shares(text.slice(a, 100))]  # the driver's memory is small
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.log(np.array([1 - rate, rate]) + 1e-6).astype(np.float32)
    # both classes weigh the same in the gradient of the vectors, so that the rare one is learnt
    weight = np.array([0.5 / (1 - rate), 0.5 / rate], np.float32) ** 0.5
    steps, step = EPOCHS * len(label), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(label)):
            found, share = documents[i]
            lr = RATE * (1 - step / steps)
            step += 1
            if not len(found):
                continue
            hidden = share @ vectors[found]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            p *= weight[label[i]]
            back = p @ out
            out -= lr * np.outer(p, hidden)
            vectors[found] -= (lr * len(found) ** 0.5) * np.outer(share, back)
    diff = out[1] - out[0]
    return Model((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, eligible, label: str = "quality", max_rows: int = 5000, max_chars: int = 20_000) -> Model:
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


def keep(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score reaches at_least."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch in text_chunks(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column("text")) >= at_least)).select(names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
