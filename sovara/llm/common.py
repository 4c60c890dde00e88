"""Helpers that the operators share: columns, checkpoints, bounded samples, Arrow text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sovara.sources.scratch import shared_folder, written  # noqa: F401  of the operators here

#: Text bytes that a Python worker turns into arrays at once.
CHUNK_BYTES = 2 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as bigint, text as string and the further columns named; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts: the fold that decides what may be learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, eligible, max_rows: int, max_chars: int
) -> pa.Table:
    """(text, label) rows to learn from: about max_rows of the labelled documents for which eligible(doc_id) holds.

    Rows are taken by a hash of doc_id, so the sample does not depend on partitioning. Labels that contradict each
    other, null labels and texts that are null or longer than max_chars teach nothing. Both bounds are parameters of the
    operators; scoring has neither.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & eligible(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most").select("doc_id", "label")
    )
    rate = max_rows / max(1, known.count())
    if rate < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
    text = doc_text(docs).filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # known holds max_rows rows at most in expectation, so it may be broadcast
    return text.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").toArrow().sort_by("doc_id")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: codes into the distinct words, the distinct words, words per text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat, row = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    row = row[np.asarray(full)]
    coded = flat.filter(full).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, np.bincount(row, minlength=len(text)).astype(np.int64)


def code_points(words: pa.Array, left: str = "", right: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and where each word starts (with the end as a last entry)."""
    length = np.asarray(pc.utf8_length(words)).astype(np.int64) + len(left) + len(right)
    if left or right:
        words = pc.binary_join_element_wise(left, words, right, "")
    joined = "".join(words.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(length)])


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; the same on every machine."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    points, start = code_points(words, right="\x00")
    place = np.arange(len(points), dtype=np.int64) - np.repeat(start[:-1], np.diff(start))
    spread = mix(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
    return mix(np.add.reduceat(spread, start[:-1]) + np.uint64(1))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, run i having counts[i] of them."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
