"""BPE encoding and decoding through a table of distinct words.

Spark splits texts into words. Every block of texts keeps its distinct words once and, in place of each word, its number in
that list; only the lists meet in a shuffle, where every distinct word of the corpus is encoded once. The ids go back to the
blocks, where they stand in for the numbers by position. A frequent word is sent once per block, not once per occurrence.
Decoding joins ids with their pieces and puts the pieces together by position.

Blocks are written once, bucketed by their name, so only what is sent between words and blocks is shuffled. Lists of words and
ids travel as compressed pieces, one per block and bucket of words; a bucket holds BUCKET_WORDS of them on average, however many
blocks there are.

Null text counts as empty: no tokens, digests of the empty string. Repeated rows and repeated or null doc_ids give one row each,
a very long text is a block of its own, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sovara.llm.common import doc_text, shared_folder, written

#: Text bytes of a block.
BLOCK_BYTES = 12 << 20
#: Words, counted once per block, that one task encodes on average.
BUCKET_WORDS = 2_000_000
BLOCKS = "block bigint, doc_ids array<bigint>, counts array<int>, numbers binary, n_words int, words binary"
PIECES = "bucket int, block bigint, places binary, words binary"
CODED = "block bigint, places binary, sizes binary, ids binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

# Code points that the vocabulary's splitter knows as letters and numbers and Java 17 does not know yet.
LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 "
    "10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 "
    "1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C "
    "18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE "
    "1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"
SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"


def _ranges(text: str) -> str:
    return "".join("-".join(f"\\x{{{x}}}" for x in part.split("-")) for part in text.split())


def split_pattern() -> str:
    """Byte-level words as a Java pattern. Newer characters are only looked at beyond U+0870, so common ones stay fast."""
    letter, number = rf"\p{{L}}[\x{{870}}-\x{{10FFFF}}&&[{_ranges(LETTERS)}]]", rf"\p{{N}}[\x{{870}}-\x{{10FFFF}}&&[{_ranges(NUMBERS)}]]"
    space = _ranges(SPACES)
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def _names() -> dict[int, str]:
    """The character that stands for a byte in the vocabulary: itself if it is printable, else the next one free from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary as the JSON file of a tokenizer has it."""

    def __init__(self, text: str):
        file = json.loads(text)
        model, added = file["model"], file.get("added_tokens") or []
        steps = file["pre_tokenizer"]
        if model["type"] != "BPE" or file.get("normalizer") or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps["use_regex"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens must be taken as they are")
        names = _names()
        byte_of = {c: b for b, c in names.items()}
        vocab = model["vocab"]
        self.first = [vocab[names[b]] for b in range(256)]
        #: pair of ids -> rank of their merge and the id that they become
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.added = {a["content"]: a["id"] for a in added}
        self.pieces = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.added}
        self.pieces |= {i: token.encode() for token, i in self.added.items()}

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the pair of the lowest rank merges first, the left one of equal pairs."""
        if word in self.added:
            return [self.added[word]]
        ids = [self.first[b] for b in word.encode("utf-8", "surrogatepass")]
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(*merges[pair], k, pair) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in merges]
        heapq.heapify(waiting)
        while waiting:
            # ranks are unique, so entries of one pair are in the order of their places
            _, new, k, pair = heapq.heappop(waiting)
            right = after[k]
            if right >= n or ids[k] < 0 or (ids[k], ids[right]) != pair:
                continue
            ids[k], ids[right], after[k] = new, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (found := merges.get((ids[a], ids[b]))):
                    heapq.heappush(waiting, (*found, a, (ids[a], ids[b])))
        return [i for i in ids if i >= 0]


def read_vocabulary(path: str) -> str:
    """The file's text, read on the driver and sent along: it is a few megabytes, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def words_of(text: Column, added: list[str]) -> Column:
    """The words of a text in order. Added tokens cut the text first, the longest one where several begin."""
    cut = "|".join(rf"\Q{a}\E" for a in sorted(added, key=lambda a: (-len(a), a)))
    split = lambda c: F.regexp_extract_all(c, F.lit(split_pattern()), F.lit(0))
    if not added:
        return split(text)
    between = F.transform(F.split(text, cut), split)
    marks = F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(0)), lambda m: F.array(m))
    parts = F.zip_with(between, marks, lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<string>"))))
    return F.when(text.rlike(cut), F.flatten(parts)).otherwise(split(text))


def _squeezed(data: bytes) -> bytes:
    """Compressed, with the length in front; short data as it is."""
    return b"\0" + data if len(data) < 256 else b"\1" + len(data).to_bytes(6, "little") + pa.compress(data, "zstd", asbytes=True)


def _opened(data: bytes) -> bytes:
    return data[1:] if data[0] == 0 else pa.decompress(data[7:], int.from_bytes(data[1:7], "little"), "zstd", asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^31 as compressed bytes: low, middle and high bytes apart."""
    return _squeezed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_opened(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pack_words(words: list[str]) -> bytes:
    """Lengths, then all bytes."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return _squeezed(len(data).to_bytes(4, "little") + np.fromiter(map(len, data), "<u4", len(data)).tobytes() + b"".join(data))


def _unpack_words(data: bytes) -> list[bytes]:
    data = _opened(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.asarray(batch.column("size")).astype(np.int64)
    part = (np.cumsum(size) - size) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def blocks(docs: DataFrame, added: list[str]) -> DataFrame:
    """Blocks of texts: doc_ids, words per text, the words' numbers (by falling frequency) and the distinct words.

    They are written once, so that a block has one name and one list for all that follows, and bucketed by that name, so that
    what comes back joins them without another shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _chunks(batch):
                lists = part.column("words")
                coded = lists.flatten().dictionary_encode()
                numbers = np.asarray(coded.indices)
                order = np.argsort(-np.bincount(numbers, minlength=len(coded.dictionary)), kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                counts = pc.fill_null(pc.list_value_length(lists), 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([counts.to_pylist()], pa.list_(pa.int32())), pa.array([_pack(rank[numbers])], pa.binary()),
                    pa.array([len(order)], pa.int32()), pa.array([_pack_words(coded.dictionary.take(pa.array(order)).to_pylist())], pa.binary()),
                ], ["block", "doc_ids", "counts", "numbers", "n_words", "words"])
                name += 1

    text = F.coalesce("text", F.lit(""))
    rows = doc_text(docs).select("doc_id", words_of(text, added).alias("words"), F.octet_length(text).alias("size")).mapInArrow(run, BLOCKS)
    spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    rows.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "none").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return table


def by_bucket(found: DataFrame, buckets: int) -> DataFrame:
    """The lists of words cut into pieces: bucket, block, places in the block's list, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                words = _unpack_words(data.as_py())
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                parts = np.split(order, first[1:]) if len(words) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([_pack(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                    pa.array([_pack_words([words[i].decode("utf-8", "surrogatepass") for i in p.tolist()]) for p in parts], pa.binary()),
                ], ["bucket", "block", "places", "words"])

    return found.select("block", "words").mapInArrow(run, PIECES)


def encode_words(parts: DataFrame, buckets: int, vocabulary_text: str) -> DataFrame:
    """The pieces with ids in place of words. A word is always in one bucket and is encoded once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = vocabulary(vocabulary_text), {}
        for batch in batches:
            sizes, ids = [], []
            for data in batch.column("words"):
                own = []
                for word in _unpack_words(data.as_py()):
                    if (found := known.get(word)) is None:
                        found = known[word] = np.array(table.encode(word.decode("utf-8", "surrogatepass")), np.uint32).tobytes()
                    own.append(found)
                sizes.append(_pack(np.fromiter((len(x) // 4 for x in own), np.int64, len(own))))
                ids.append(_pack(np.frombuffer(b"".join(own), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("places"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["block", "places", "sizes", "ids"])

    return parts.repartition(buckets, "bucket").mapInArrow(run, CODED)


def pieces(spark: SparkSession, vocabulary_text: str) -> DataFrame:
    """id, piece: a row per token of the vocabulary, whose size is fixed."""
    table = vocabulary(vocabulary_text).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(list(table), pa.int32()), "piece": pa.array(list(table.values()), pa.binary())}))


def put_together(tokens: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """key, decoded: the pieces of each row's ids, one after another. key must be unique; rows without ids are left out."""
    each = tokens.select(key, F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id")  # one row per token of the vocabulary
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))), lambda x: x["piece"])
    return each.groupBy(key).agg(F.unhex(F.array_join(in_order, "")).alias("decoded"))


def _filled(docs: DataFrame, path: str) -> DataFrame:
    """Blocks with the ids of their words: doc_ids, counts, numbers, n_words, table (pieces of places, sizes and ids)."""
    text = read_vocabulary(path)
    found = blocks(docs, list(vocabulary(text).added))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-(found.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    coded = encode_words(by_bucket(found, buckets), buckets, text)
    of_block = coded.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("places", "sizes", "ids")).alias("table"))
    return found.select("block", "doc_ids", "counts", "numbers", "n_words").join(of_block, "block", "left")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int]]]:
    """doc_id and ids of each document of the blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            at = lambda name: batch.column(name)[row]  # noqa: E731, B023
            counts = np.asarray(at("counts").values).astype(np.int64)
            numbers, parts = _unpack(at("numbers").as_py()), at("table").as_py() or []
            size, first, values = np.zeros(at("n_words").as_py(), np.int32), np.zeros(at("n_words").as_py(), np.int64), []
            done = filled = 0
            for part in parts:
                places, sizes = np.cumsum(_unpack(part["places"])), _unpack(part["sizes"])
                size[places], first[places] = sizes, done + np.cumsum(sizes) - sizes
                values.append(_unpack(part["ids"]))
                done, filled = done + len(values[-1]), filled + len(places)
            if filled != len(size):
                raise RuntimeError("a block and the words that came back do not belong together")
            every = np.concatenate([*values, np.zeros(0, np.int32)])
            for doc_id, count, end in zip(at("doc_ids").as_py(), counts.tolist(), np.cumsum(counts).tolist(), strict=True):
                own = numbers[end - count : end]
                n = size[own]
                yield doc_id, every[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tolist()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = _documents(batches)
        while some := list(islice(documents, 256)):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _filled(docs, path).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text. Bytes that are no UTF-8 become U+FFFD, unknown ids nothing, null ids no text."""
    rows = written(tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).withColumn("row", F.monotonically_increasing_id()))
    found = put_together(rows, "row", pieces(tokens.sparkSession, read_vocabulary(path)))
    return rows.join(found, "row", "left").select("doc_id", F.make_valid_utf8(F.coalesce(F.col("decoded").cast("string"), F.lit(""))).alias("text"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. The pieces join the blocks as one row: their list is of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            piece = {p["id"]: p["piece"] for p in batch.column("pieces")[0].as_py()} if batch.num_rows else {}
            name = {i: str(i) for i in piece}
            rows = (
                (i, len(x), sha(",".join(map(name.__getitem__, x)).encode()), sha(b"".join(map(piece.__getitem__, x)).decode("utf-8", "replace").encode()))
                for i, x in _documents(iter([batch]))
            )
            while some := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    listed = pieces(docs.sparkSession, read_vocabulary(path)).agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    return _filled(docs, path).crossJoin(F.broadcast(listed)).mapInArrow(run, DIGESTS)
