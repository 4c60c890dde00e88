"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes, folded into 64 classes, are cut into windows of a fixed length; all windows of the text are used. Filters
of several widths slide over a window, each filter's largest response is kept, and a softmax over a linear layer gives the
languages. A text's prediction is the mean over its windows, weighted by their bytes. Training is stochastic gradient descent
in numpy on windows of a bounded sample of texts with a known language.

A filter over one-hot bytes is a table lookup for each place, and two places at once are one lookup in a table over pairs of
classes, so scoring needs no matrix product. The network is broadcast; its size is fixed.

Predictions depend on the text only. Null texts and texts without a letter are `und` with score 0. With no text to learn
from, everything is `und`. Repeated rows and null doc_ids give one row each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import doc_text, text_chunks

WINDOW, FILTERS, CLASSES = 256, 16, 64
WIDTHS = (2, 3, 4)
EPOCHS, RATE, BLOCK = 6, 0.08, 64
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """Letters without case, blanks, digits, other ASCII; bytes above share 32 classes by their last bits. 0 is padding."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 128):
        c = chr(b)
        out[b] = 1 + ord(c.lower()) - 97 if c.isalpha() else 27 if c.isspace() else 28 if c.isdigit() else 29 if c == "'" else 30
    out[128:] = 32 + (np.arange(128, 256) & 31)
    return out


_CLASSES = byte_classes()


def windows_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all windows, how many windows each text has, and the bytes in each window."""
    text = pc.fill_null(text, "").cast(pa.large_binary())
    size = np.asarray(pc.binary_length(text)).astype(np.int64)
    each = -(-size // WINDOW)
    out = np.zeros(int(each.sum()) * WINDOW, np.uint8)
    data = _CLASSES[np.frombuffer(b"".join(text.to_pylist()), np.uint8)]
    start, place = np.cumsum(size) - size, (np.cumsum(each) - each) * WINDOW
    for a, n, p in zip(start.tolist(), size.tolist(), place.tolist(), strict=True):
        out[p : p + n] = data[a : a + n]
    filled = np.full(int(each.sum()), WINDOW)
    last = np.cumsum(each) - 1
    filled[last[each > 0]] = (size - (each - 1) * WINDOW)[each > 0]
    return out.reshape(-1, WINDOW), each, filled


@dataclass
class Network:
    """filters[width]: a table (place, class, filter); out and bias: the softmax layer over all filters."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The largest response of each filter in each window, and where it is."""
        best, where = [], {}
        for width, table in self.filters.items():
            span = WINDOW - width + 1
            total = sum(table[j][windows[:, j : j + span]] for j in range(width))
            where[width] = total.argmax(1)
            best.append(np.take_along_axis(total, where[width][:, None], 1)[:, 0])
        return np.maximum(np.concatenate(best, 1), 0), where

    def pairs(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, tables over two neighbouring classes and the place where they apply."""
        joint = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, FILTERS)
        none = np.zeros((CLASSES, FILTERS), np.float32)
        return {w: [(j, joint(t[j], t[j + 1] if j + 1 < w else none)) for j in range(0, w, 2)] for w, t in self.filters.items()}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        tables, out = self.pairs(), []
        for a in range(0, len(windows), BLOCK):
            part = windows[a : a + BLOCK]
            two = part.astype(np.int32) * CLASSES
            two[:, :-1] += part[:, 1:]
            best = []
            for width, parts in tables.items():
                span = WINDOW - width + 1
                total = np.take(parts[0][1], two[:, :span], axis=0)
                for j, table in parts[1:]:
                    total += np.take(table, two[:, j : j + span], axis=0)
                best.append(total.max(1))
            z = np.maximum(np.concatenate(best, 1), 0) @ self.out + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        known = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)) & bool(self.languages)
        if not known.any():
            return [UNKNOWN] * len(text), np.zeros(len(text))
        windows, each, filled = windows_of(text)
        share = self.probabilities(windows) * filled[:, None]
        total = np.concatenate([np.zeros((1, share.shape[1])), np.cumsum(share, 0)])
        end = np.cumsum(each)
        mean = total[end] - total[end - each]
        mean /= np.maximum(mean.sum(1, keepdims=True), 1e-12)
        top = mean.argmax(1)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)], np.where(known, np.clip(mean.max(1), 0, 1), 0.0)


def train(text: pa.Array, languages: list[str], seed: int = 3, per_text: int = 4) -> Network:
    """Learns from up to per_text windows, spread evenly, of each text."""
    names = sorted(set(languages))
    random = np.random.default_rng(seed)
    net = Network(names, {w: random.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}, random.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return net
    windows, each, _ = windows_of(text)
    label = np.array([names.index(x) for x in languages])
    first = np.cumsum(each) - each
    chosen = [(f + np.unique(np.linspace(0, n - 1, min(n, per_text)).astype(int)), y) for f, n, y in zip(first, each, label, strict=True) if n]
    windows, label = windows[np.concatenate([c for c, _ in chosen])], np.repeat([y for _, y in chosen], [len(c) for c, _ in chosen])
    steps, step, size = EPOCHS * -(-len(label) // 32), 0, 32
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for a in range(0, len(order), size):
            own = order[a : a + size]
            lr = RATE * (1 - step / steps)
            step += 1
            x = windows[own]
            hidden, where = net.responses(x)
            z = hidden @ net.out + net.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            p /= len(own)
            back = (p @ net.out.T) * (hidden > 0)
            net.out -= lr * (hidden.T @ p)
            net.bias -= lr * p.sum(0)
            for k, (width, table) in enumerate(net.filters.items()):
                part, filters = back[:, k * FILTERS : (k + 1) * FILTERS], np.arange(FILTERS)[None]
                for j in range(width):
                    np.subtract.at(table[j], (x[np.arange(len(own))[:, None], where[width] + j], filters), lr * 4 * part)
    return net


def fit(docs: DataFrame, eligible, max_rows: int = 2400, max_chars: int = 20_000) -> Network:
    """Learns from text and lang of about max_rows documents for which eligible(doc_id) holds, taken by a hash of doc_id."""
    known = doc_text(docs, F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & eligible(F.col("doc_id")) & (F.length("text") <= max_chars)
    )
    rate = max_rows / max(1, known.count())
    if rate < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
    sample = known.select("doc_id", "text", "lang").toArrow().sort_by("doc_id")
    return train(sample["text"].combine_chunks(), sample["lang"].to_pylist())


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in text_chunks(batches):
            name, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return doc_text(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep(docs: DataFrame, net: Network, at_least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, with a language and a score of at_least."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for batch in text_chunks(batches):
            name, score = shared.value.predict(batch.column("text"))
            yield batch.filter(pa.array((np.array(name, object) != UNKNOWN) & (score >= at_least)))

    return docs.mapInArrow(run, docs.schema)
