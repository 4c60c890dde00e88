"""Repeated passages: bytes covered by a string of a minimum length that also starts in an earlier document.

Candidates. In every string of `least` bytes one place is chosen by content: the smallest hash among its substrings of
ANCHOR bytes. Equal strings choose equal anchors, so equal strings meet where equal anchors meet. The strings that choose one
occurrence of an anchor lie next to each other; together they are the occurrence's fragment (under 2 * least bytes).

Deal. Anchors are dealt to buckets by hash, packed as byte planes, and compared there. An occurrence whose whole fragment
also occurs in an earlier document is removed as a whole at once, first within a batch, then within the bucket, so a passage
that very many documents share is one entry a batch. Of an anchor that several documents share with different fragments,
the remaining occurrences (leaders) go on.

A bucket is compared as a stream that is thinned on the way, so what a task holds does not grow with the number of entries of one
anchor.

A leader goes on only if it can share a string with another one: a string around an anchor has half of its other bytes on
one side at least, so a few bits of a hash of those bytes on either side must agree.

Suffix order. Leaders' fragments are dealt to blocks by anchor. A block's fragments are one text with separators; from its
Burrows-Wheeler transform, intervals are extended backwards breadth first, and the interval ends met at step l get common
prefix l. Extension stops at `least`: ends without a value are suffixes that share at least so many bytes. In each such run
of suffixes the earliest document keeps its copy. An anchor with more leaders than a block takes is dealt to several blocks;
the strings that each of them keeps are merged by an aggregation, which no key overloads.

Null text counts as empty. Null doc_ids come after all others and are not earlier than each other; rows with the same doc_id
are not earlier than each other either. Repeated rows give equal rows. Extra columns are ignored or, in `remove`, kept.

A text is named by doc_id and row: row is 0 where doc_id has one row, else a 64-bit hash of the text, to which the packed places
add 18 bits of another. Texts are grouped and joined by both; doc_id alone only decides which one is earlier. Repeated rows are
one text here, so no list is longer than a text's own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sovara.llm.common import cut_lineage, doc_text, mix, text_chunks, written

ANCHOR = 16
#: Entries that a Python worker compares at once, text bytes a bucket, fragment bytes a block, leaders of an anchor in a block.
FLUSH, BUCKET_BYTES, BLOCK_BYTES, BLOCK_LEADERS = 300_000, 6 << 20, 1 << 19, 4000
#: Occurrences of one anchor in a batch that go to its bucket; the rest are leaders without further comparison.
SENT = 16
#: Entries of a bucket that a Python worker holds before it thins them.
HELD = 600_000
#: Most repeated doc_ids that are broadcast; beyond that every row is named by a hash of its text.
REPEATED_IDS = 100_000
#: Starts hashed at once.
SEGMENT = 1 << 18
LAST = np.iinfo(np.int64).max
_R = np.uint64(0x9E3779B97F4A7C15)


def pack(variant: int | np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """18 bits that tell texts of a repeated doc_id apart besides row, 38 bits for the first start, 7 bits for the number of starts."""
    return (np.int64(variant) << 45) | (start.astype(np.int64) << 7) | count.astype(np.int64)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 45, (packed >> 7) & ((1 << 38) - 1), packed & 127


def variant_of(row: int, data: bytes) -> int:
    return zlib.crc32(data) & ((1 << 18) - 1) if row else 0


def named(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """docs with `__id` (LAST for a null doc_id) and `__row`; the distinct texts by these, which are docs themselves if no id
    repeats; the bytes of all texts.

    An id that has one row needs no more to name it, which keeps the entries small.
    """
    docs = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    ids = cut_lineage(docs.groupBy("__id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")))
    again = ids.filter("rows > 1").select("__id", F.lit(True).alias("__again"))
    size, repeated = ids.agg(F.sum("bytes"), F.count_if(F.col("rows") > 1)).first()
    by_text = F.xxhash64(F.col("text").cast("binary"))
    if not repeated:
        docs = docs.withColumn("__row", F.lit(0).cast("bigint"))
    elif repeated > REPEATED_IDS:
        docs = docs.withColumn("__row", by_text)
    else:
        docs = docs.join(F.broadcast(again), "__id", "left").withColumn("__row", F.when(F.col("__again"), by_text).otherwise(F.lit(0))).drop("__again")
    texts = docs
    if repeated:
        texts = docs.select("__id", "__row", "text")
        texts = texts.filter("__row = 0").union(texts.filter("__row <> 0").distinct())
    return docs, texts, int(size or 0)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base, and of its inverse."""
    out = []
    for base in (int(_R), pow(int(_R), -1, 1 << 64)):
        power = np.full(n, np.uint64(base))
        power[0] = 1
        out.append(np.cumprod(power))
    return out[0], out[1]


def anchors(data: np.ndarray, valid: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """For each anchor that a string of `least` bytes of data chooses: its hash, its fragment's hash, the first start and
    the number of starts of the strings that choose it, and 12 bits for what stands before and 12 for what stands after it
    (0 if no string reaches that far). Only starts marked valid count; data has some MB at most."""
    wide = data.astype(np.uint64) + np.uint64(1)
    step, h, length = np.array([_R]), wide, 1
    while length < ANCHOR:
        h = h[:-length] * step + h[length:]
        step, length = step * step, 2 * length
    h = mix(h)
    span = least - ANCHOR + 1
    place = np.uint64((1 << 24) - 1)
    low, length = (h & ~place) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * length <= span:
        low, length = np.minimum(low[:-length], low[length:]), 2 * length
    if length < span:
        low = np.minimum(low[: len(low) - (span - length)], low[span - length :])
    start = np.flatnonzero(valid[: len(low)])
    chosen = (low[start] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, count = start[new], np.diff(np.append(new, len(start)))
    # polynomial hash of the fragment's bytes, brought to a common power
    power, inverse = _powers(1 << int(len(wide)).bit_length())
    total = np.concatenate([[np.uint64(0)], np.cumsum(wide * power[: len(wide)])])
    fragment = (total[first + count - 1 + least] - total[first]) * inverse[first]
    at, half = chosen[new], (least - ANCHOR) // 2
    bits = lambda a: (mix((total[a + half] - total[a]) * inverse[a]) % np.uint64(4095)).astype(np.int64) + 1
    before = np.where(at - half >= first, bits(np.maximum(at - half, 0)), 0)
    after = np.where(at + ANCHOR + half <= first + count - 1 + least, bits(np.minimum(at + ANCHOR, len(wide) - half)), 0)
    return h[at], mix(fragment + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, count, before, after


def batch_anchors(texts: list[bytes], least: int):
    """Text number and what `anchors` returns, for all texts; short texts are hashed together, long ones in segments."""
    group: list[int] = []
    size = 0
    for i, data in enumerate([*texts, b""]):
        if len(data) > SEGMENT:
            raw = np.frombuffer(data, np.uint8)
            for a in range(0, len(raw) - least + 1, SEGMENT):
                part = raw[a : a + SEGMENT + least - 1]
                h, f, first, *rest = anchors(part, np.ones(len(part), bool), least)
                yield np.full(len(h), i), h, f, first + a, *rest
        elif len(data) >= least:
            group.append(i)
            size += len(data)
        if group and (size >= SEGMENT or i == len(texts)):
            length = np.array([len(texts[g]) for g in group])
            end = np.cumsum(length)
            valid = np.arange(size) + least <= np.repeat(end, length)
            h, f, first, *rest = anchors(np.frombuffer(b"".join([texts[g] for g in group]), np.uint8), valid, least)
            own = np.searchsorted(end, first, "right")
            yield np.array(group)[own], h, f, first - (end - length)[own], *rest
            group, size = [], 0


def planes(*columns: np.ndarray) -> bytes:
    """64-bit columns byte by byte, so that bytes which hardly change lie together and compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def unplanes(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, np.uint8).reshape(columns, 8, -1) for b in blobs]
    return [np.concatenate([np.ascontiguousarray(p[c].T).view(np.int64).ravel() for p in parts]) if parts else np.zeros(0, np.int64) for c in range(columns)]


def settle(h: np.ndarray, f: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, fragment, doc); whether an entry repeats a fragment of an earlier document; whether its anchor has several texts."""
    order = np.lexsort((at, doc, f, h))
    h, f, doc, row = h[order], f[order], doc[order], row[order]
    if not len(h):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
    earliest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    anchor = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.flatnonzero(anchor)
    several = (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)) | (np.minimum.reduceat(row, start) < np.maximum.reduceat(row, start))
    return order, doc > earliest, several[np.cumsum(anchor) - 1]


def _reorder(columns: list[np.ndarray], by: np.ndarray) -> None:
    """Takes rows of all columns, in place of the list, so that one column at a time is there twice."""
    for i in range(len(columns)):
        columns[i] = columns[i][by]


def thin(entries: list[np.ndarray], sent: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of entries (anchor, fragment, doc, row, at, mark): those left, in order; settled removals (doc, row, at); leaders (anchor,
    doc, row, at). The first `sent` of an anchor are left, marked by the lowest bit if others of it are leaders; the list given
    is used up."""
    order, repeats, several = settle(*entries[:5])
    _reorder(entries, order)
    gone = [entries[i][repeats] for i in (2, 3, 4)]
    if repeats.any():
        several = several[~repeats]
        _reorder(entries, ~repeats)
    h = entries[0]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    which = np.cumsum(new) - 1
    # of an anchor with many entries the first ones are compared; the others are leaders whatever comes of those
    beyond = (np.arange(len(h)) - np.flatnonzero(new)[which] >= sent) & several
    crowded = (np.bincount(which, beyond) > 0)[which]
    lead = [entries[i][beyond] for i in (0, 2, 3, 4)]
    entries[5] = entries[5] | crowded
    if beyond.any():
        _reorder(entries, ~beyond)
    return entries, gone, lead


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a key has several documents."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    several = np.minimum.reduceat(doc[order], start) < np.maximum.reduceat(doc[order], start)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(several, np.diff(np.append(start, len(key))))
    return out


def _name(h: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits of an anchor's hash besides its bucket."""
    return (((h // np.uint64(buckets)) & np.uint64((1 << 40) - 1)) * np.uint64(buckets) + h % np.uint64(buckets)).astype(np.int64)


def _deal(texts: DataFrame, least: int, buckets: int) -> DataFrame:
    """Rows of (bucket, kind, data): kind 0 entries to compare, 1 settled removals, 2 leaders."""

    def flush(held):
        entries = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()  # what follows copies columns; the pieces need not stay beside them
        # differs between batches also where all rows have one id
        salt = -1 - int(np.bitwise_xor.reduce(mix((entries[2] ^ entries[3] ^ entries[4]).view(np.uint64)) ^ entries[1], initial=np.uint64(0)) % np.uint64(buckets))
        entries, gone, lead = thin(entries, SENT)
        if len(gone[0]):
            yield salt, 1, planes(*gone)
        if len(lead[0]):
            yield salt, 2, planes(_name(lead[0], buckets), *lead[1:])
        del gone, lead
        entries[:2] = _name(entries[0], buckets), entries[1].view(np.int64)
        # document order, in which ids and places compress best
        _, _, doc, row, at, _ = entries
        order = np.lexsort((at, row, doc, entries[0] % buckets))
        del doc, row, at
        _reorder(entries, order)
        found, edge = np.unique(entries[0] % buckets, return_index=True)
        entries[0] //= buckets
        for b, s, e in zip(found.tolist(), edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            yield b, 0, planes(*(x[s:e] for x in entries))

    def rows(held):
        # some rows at a time, so that not all packed columns are there beside the plain ones
        out, size = [], 0
        for r in flush(held):
            out.append(r)
            size += len(r[2])
            if size >= 1 << 20:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "kind", "data"])

    def run(batches):
        held, n = [], 0
        for batch in text_chunks(batches, "data", SEGMENT):
            ids, row = np.asarray(batch.column("doc_id")), np.asarray(batch.column("row"))
            data = [t or b"" for t in batch.column("data").to_pylist()]
            names = np.array([variant_of(r, t) for r, t in zip(row.tolist(), data, strict=True)], np.int64)
            for who, h, f, start, count, before, after in batch_anchors(data, least):
                held.append((h, f, ids[who], row[who], pack(names[who], start, count), (before << 12 | after) << 1))
                n += len(h)
            if n >= FLUSH:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    return texts.select(F.col("__id").alias("doc_id"), F.col("__row").alias("row"), F.col("text").cast("binary").alias("data")).mapInArrow(run, "bucket int, kind int, data binary")


def _compare(buckets: int):
    """Of a bucket: settled removals (doc_id, row, at) and leaders, which have an anchor h too.

    A bucket comes in batches. Whenever it has more than HELD entries, or twice what was left the last time, they are thinned:
    what is held depends on the number of anchors in the bucket, not on how often one occurs.
    """
    names = ["doc_id", "row", "at", "h"]

    def found(gone, lead, bucket):
        columns = [pa.array(np.concatenate([x, y]), pa.int64()) for x, y in zip(gone, lead[1:], strict=True)]
        anchor = pa.array(lead[0] * buckets + bucket if bucket >= 0 else lead[0], pa.int64())
        return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(gone[0]), pa.int64()), anchor])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most, bucket = [], 0, HELD, -1
        nothing = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            bucket = batch.column("bucket")[0].as_py()
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                columns = unplanes([data.as_buffer()], (6, 3, 4)[kind])
                if kind:
                    yield found(columns, nothing, bucket) if kind == 1 else found(nothing[1:], columns, bucket)
                    continue
                held.append(columns)
                n += len(columns[0])
                if n > most:
                    entries = [np.concatenate(x) for x in zip(*held, strict=True)]
                    held.clear()
                    entries, gone, lead = thin(entries, SENT)
                    yield found(gone, lead, bucket)
                    held, n = [entries], len(entries[0])
                    most = max(HELD, 2 * n)
        if not held:
            return
        h, f, doc, row, at, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, repeats, _ = settle(h, f, doc, row, at)
        del f
        h, doc, row, at, mark = (x[order] for x in (h, doc, row, at, mark))
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(new)
        # others of a crowded anchor were kept by a batch; else another leader must agree on one side
        on = ~repeats & (np.bitwise_or.reduceat(mark & 1, start) > 0)[np.cumsum(new) - 1]
        left = np.flatnonzero(~repeats)
        for side in (mark >> 13, (mark >> 1) & 4095):
            own = left[side[left] > 0]
            on[own[_shared(h[own] << 12 | side[own], doc[own])]] = True
        yield found([x[repeats] for x in (doc, row, at)], [x[on] for x in (h, doc, row, at)], bucket)

    return run


def suffix_runs(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all texts that share at least `least` bytes with another: text number, offset, and number of the run of
    equal beginnings.

    The texts, each closed by a separator of its own, are sorted by suffix; the transform's last-to-first mapping then
    extends intervals backwards, all intervals of one length at once.
    """
    length = np.array([len(t) + 1 for t in texts])
    n = int(length.sum())
    code = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    close = np.cumsum(length) - 1
    code[close] = 0
    left = (np.repeat(close, length) - np.arange(n)).astype(np.int32)  # bytes before the separator
    # sort by the first 7 bytes, then by twice as many, and so on; equal texts stay in their order
    key, padded = np.zeros(n, np.int64), np.append(code, np.zeros(7, np.int16))
    for j in range(7):
        key <<= 9
        key |= np.where(left >= j, padded[j : j + n], np.int16(0))
    depth = 7
    while True:
        order = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        if depth > left.max() or rank[order[-1]] == n - 1:
            break
        key = rank * np.int64(n + 1)
        key[: max(0, n - depth)] += np.where(left[: max(0, n - depth)] >= depth, rank[depth:] + 1, 0)
        depth *= 2
    del key, rank, left
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    back = place[order - 1]  # last-to-first
    del place
    head = np.where(code[order] > 0, code[order], -np.arange(n, dtype=np.int32))  # separators differ
    prefix = np.full(n + 1, -1, np.int8 if least < 128 else np.int32)  # common prefix with the suffix before; unset where it is not found
    prefix[0] = prefix[n] = 0
    active, owner = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    of = np.empty(n, np.int32)
    flag = np.zeros(n, bool)
    for level in range(least):
        to = back[active]
        of[to] = owner
        flag[to] = True
        active = np.flatnonzero(flag).astype(np.int32) if len(to) * 16 > n else np.sort(to)
        flag[to] = False
        owner = of[active]
        # an interval: neighbours that come from one interval and begin with the same byte
        new = np.concatenate([[True], (active[1:] != active[:-1] + 1) | (owner[1:] != owner[:-1]) | (head[active[1:]] != head[active[:-1]])])
        start = np.flatnonzero(new)
        end = active[np.append(start[1:], len(active)) - 1] + 1
        fresh = prefix[end] < 0
        prefix[end[fresh]] = level
        if level == 0:
            fresh[:] = True  # the last interval ends with the text
        which = np.cumsum(new, dtype=np.int32) - 1
        keep = fresh[which]
        active, owner = active[keep], which[keep]
        if not len(active):
            break
    run = np.cumsum(prefix[:n] >= 0) - 1
    size = np.bincount(run)
    shared = np.flatnonzero(size[run] > 1)
    at = order[shared]
    text = np.searchsorted(close, at)
    return text, at - (close - length + 1)[text], run[shared]


def _block(least: int):
    """Of a block of leaders (doc_id, row, at, divided, fragment): packed, the strings that an earlier document of the block
    has; and one by one, with their bytes, the others of anchors that are divided among blocks."""

    def run(table: pa.Table) -> pa.Table:
        doc, row, at, divided = (np.asarray(table[c].combine_chunks()) for c in ("doc_id", "row", "at", "divided"))
        fragments = table["fragment"].to_pylist()
        text, offset, group = suffix_runs(fragments, least)
        earliest = np.full(int(group.max(initial=-1)) + 1, LAST)
        np.minimum.at(earliest, group, doc[text])
        later = doc[text] > earliest[group]
        text, offset = text[later], offset[later]
        order = np.lexsort((offset, text))
        text, offset = text[order], offset[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(text) else np.zeros(0, np.int64)
        variant, start, count = unpack(at)
        open_ = np.flatnonzero(divided)
        kept = np.repeat(open_, count[open_])
        place = np.arange(len(kept)) - np.repeat(np.cumsum(count[open_]) - count[open_], count[open_])
        still = ~np.isin(kept << 7 | place, text << 7 | offset)
        kept, place = kept[still], place[still]
        who = np.concatenate([text[new], kept])
        packed = pack(variant[who], start[who] + np.concatenate([offset[new], place]), np.concatenate([np.diff(np.append(new, len(text))), np.ones(len(kept), np.int64)]))
        strings = [None] * len(new) + [fragments[i][o : o + least] for i, o in zip(kept.tolist(), place.tolist(), strict=True)]
        return pa.table({"doc_id": doc[who], "row": row[who], "at": packed, "string": pa.array(strings, pa.binary())})

    return run


def squeezed(docs: DataFrame) -> DataFrame:
    """docs with `text` as compressed bytes in `__squeezed`: texts are shuffled twice here."""
    plain = docs.withColumn("text", F.col("text").cast("binary"))
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in text_chunks(batches):
            data = [None if t is None else shrink(t) for t in batch.column("text").to_pylist()]
            yield batch.select(rest).append_column("__squeezed", pa.array(data, pa.binary()))

    schema = StructType([*(plain.schema[c] for c in rest), StructField("__squeezed", BinaryType())])
    return plain.mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    stretch = zstandard.ZstdDecompressor().decompress
    return [b"" if t is None else stretch(t) for t in batch.column("__squeezed").to_pylist()]


def _fragments(texts: DataFrame, leaders: DataFrame, least: int) -> DataFrame:
    """The fragments of leaders (doc_id, row, at, block, divided); texts as `squeezed` gives them, with all their columns, so
    that they are exchanged once for this and for the result."""
    lists = leaders.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("at", "block", "divided")).alias("__leaders"))
    joined = texts.join(lists, ["__id", "__row"])
    names = ["doc_id", "row", "at", "block", "divided"]

    def run(batches):
        for batch in text_chunks(batches, "__squeezed"):
            own = batch.column("__leaders")
            flat = own.flatten()
            at = np.asarray(flat.field("at"))
            variant, start, count = unpack(at)
            parent = np.asarray(own.value_parent_indices())
            rows, data = np.asarray(batch.column("__row")), _texts(batch)
            tags = np.array([variant_of(r, t) for r, t in zip(rows.tolist(), data, strict=True)], np.int64)
            of = np.flatnonzero(variant == tags[parent])
            fragments = [data[p][s : s + c - 1 + least] for p, s, c in zip(parent[of].tolist(), start[of].tolist(), count[of].tolist(), strict=True)]
            columns = [pa.array(np.asarray(batch.column("__id"))[parent[of]]), pa.array(rows[parent[of]]), *(flat.field(c).take(pa.array(of)) for c in names[2:])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fragments, pa.binary())], [*names, "fragment"])

    return joined.mapInArrow(run, "doc_id bigint, row bigint, at bigint, block bigint, divided boolean, fragment binary")


def checked(least: int) -> int:
    """The length, if entries can hold it: ANCHOR bytes at least, and at most 127 starts that choose one anchor."""
    if not ANCHOR <= least <= ANCHOR + 126:
        raise ValueError(f"passages have {ANCHOR} to {ANCHOR + 126} bytes at least, not {least}")
    return least


def removals(texts: DataFrame, shrunk: DataFrame, size: int, least: int = 50) -> DataFrame:
    """doc_id, row and `gone`, packed starts of the strings to remove, of the texts that `named` gives with their size; shrunk
    are the same texts squeezed."""
    buckets = 1 << max(0, (size // BUCKET_BYTES).bit_length())
    found = written(_deal(texts, least, buckets).groupBy("bucket").applyInArrow(_compare(buckets), "doc_id bigint, row bigint, at bigint, h bigint"))
    leaders = found.filter("h is not null")
    counts = leaders.groupBy("h").count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    blocks = F.lit(max(1, (total or 0) * 2 * least // BLOCK_BYTES))
    divided = (most or 0) > BLOCK_LEADERS
    if divided:
        parts = counts.filter(F.col("count") > BLOCK_LEADERS).select("h", F.ceil(F.col("count") / BLOCK_LEADERS).alias("parts"))
        leaders = leaders.join(parts, "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "row", "at"), "parts"), F.lit(0)))
    else:
        leaders = leaders.withColumn("parts", F.lit(None).cast("bigint")).withColumn("part", F.lit(0))
    leaders = leaders.select("doc_id", "row", "at", F.pmod(F.xxhash64("h", "part"), blocks).alias("block"), F.col("parts").isNotNull().alias("divided"))
    blocked = _fragments(shrunk, leaders, least).groupBy("block").applyInArrow(_block(least), "doc_id bigint, row bigint, at bigint, string binary")
    if divided:
        blocked = written(blocked)
        left = blocked.filter("string is not null")
        first = left.groupBy("string").agg(F.min("doc_id").alias("earliest"))
        merged = left.join(first, "string").filter("doc_id > earliest").select("doc_id", "row", "at")
        blocked = blocked.filter("string is null").select("doc_id", "row", "at").union(merged)
    spans = found.filter("h is null").select("doc_id", "row", "at").union(blocked.select("doc_id", "row", "at"))
    return spans.groupBy("doc_id", "row").agg(F.collect_list("at").alias("gone"))


def _kept(row: int, data: bytes, gone: np.ndarray, least: int) -> tuple[bytes, int]:
    """The bytes left and the number of removed runs."""
    variant, start, count = unpack(gone)
    mine = variant == variant_of(row, data)
    start, count = start[mine], count[mine]
    if not len(start):
        return data, 0
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, start, 1)
    np.subtract.at(change, start + count - 1 + least, 1)
    out = np.cumsum(change)[:-1] > 0
    runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~out].tobytes(), runs


def _with_removals(docs: DataFrame, least: int) -> DataFrame:
    """docs with `__squeezed` for `text` and the packed removals in `__gone`."""
    docs, texts, size = named(docs)
    shrunk = squeezed(docs)
    gone = removals(texts, shrunk if texts is docs else squeezed(texts), size, least).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    return shrunk.join(gone, ["__id", "__row"], "left")


def passage_digests(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in text_chunks(batches, "__squeezed"):
            out = ([], [], [], [])
            for row, data, gone in zip(batch.column("__row").to_pylist(), _texts(batch), batch.column("__gone"), strict=True):
                left, runs = _kept(row, data, np.asarray(gone.values), least) if gone.is_valid else (data, 0)
                for column, value in zip(out, (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_removals(doc_text(docs), checked(least)).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs, all columns, with repeated passages cut from text; incomplete UTF-8 characters left at a cut go too."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = docs.columns

    def run(batches):
        for batch in text_chunks(batches, "__squeezed"):
            text = []
            for row, data, there, gone in zip(batch.column("__row").to_pylist(), _texts(batch), batch.column("__squeezed").is_valid().to_pylist(), batch.column("__gone"), strict=True):
                text.append((_kept(row, data, np.asarray(gone.values), least)[0] if gone.is_valid else data).decode(errors="ignore") if there else None)
            columns = {"text": pa.array(text, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] if c == "text" else batch.column(c) for c in names], names)

    return _with_removals(docs, checked(least)).mapInArrow(run, docs.schema)
