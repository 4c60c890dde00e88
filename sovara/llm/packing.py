"""Best-fit packing of documents into bins of a fixed capacity, with conflicts.

Items are written once with a number of their row and dealt evenly to shards by its hash, so repeated rows spread as others do;
each shard holds about SHARD_ITEMS items, and the number of shards grows with the corpus. In a shard items come in decreasing
size. Bins are kept by what is left in them; for an item, the search starts at the smallest sufficient rest and goes on to the
next until a bin has neither the item's duplicate cluster nor, beyond a limit, its source. Each bin carries both as bitmaps over
the shard's clusters and sources. Rests are found through bitmaps as well: one of all rests that bins have, and for each source
and cluster one of the rests at which every bin is closed to it, so these cost nothing. Only what a bin itself is closed to is
looked at when it moves.

The size of a document is its number of words. A document longer than a bin is cut into pieces of full bins, and its last
piece is packed with others. Copies (texts equal but for case and spacing) are a cluster. A document without words has size
0 and takes a bin's place without using it. A conflict between documents of different shards cannot arise.

Null text and null source count as empty. Repeated rows and null doc_ids are items of their own. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import written

#: Words in a bin, documents of a source in a bin, and items in a shard.
CAPACITY, PER_SOURCE, SHARD_ITEMS = 2048, 2, 4096


def pack_items(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each item, taken in the given order: the tightest bin that has room and no conflict, else a new one."""
    rest_bins: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    used = 0  # the rests that bins have, as bits
    closed: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # at a rest: how many bins are closed to a key
    shut: dict[int, int] = {}  # key -> the rests at which all bins are closed to it, as bits
    shut_at: list[set[int]] = [set() for _ in range(capacity + 1)]
    rest: list[int] = []
    held: list[int] = []  # cluster bitmaps
    full: list[int] = []  # bitmaps of sources that have reached their limit
    keys: list[list[int]] = []  # both as keys: sources even, clusters odd
    counts: list[dict[int, int]] = []

    def toggle(key: int, r: int, on: bool) -> None:
        shut[key] = shut.get(key, 0) ^ 1 << r
        (shut_at[r].add if on else shut_at[r].discard)(key)

    def put(b: int) -> None:
        nonlocal used
        r, own = rest[b], closed[rest[b]]
        first = not rest_bins[r]
        rest_bins[r][b] = None
        used |= 1 << r
        for key in keys[b]:
            own[key] = own.get(key, 0) + 1
        if first:
            for key in keys[b]:
                toggle(key, r, True)
        else:  # these are closed at every other bin of the rest, so they are few
            for key in [k for k in shut_at[r] if not (held[b] >> (k >> 1) & 1 if k & 1 else full[b] >> (k >> 1) & 1)]:
                toggle(key, r, False)

    def take(b: int) -> None:
        nonlocal used
        r, own = rest[b], closed[rest[b]]
        del rest_bins[r][b]
        for key in keys[b]:
            own[key] -= 1
            if not own[key]:
                del own[key]
        n = len(rest_bins[r])
        if n:
            for key in keys[next(iter(rest_bins[r]))]:
                if own[key] == n and key not in shut_at[r]:
                    toggle(key, r, True)
        else:
            used ^= 1 << r
            for key in list(shut_at[r]):
                toggle(key, r, False)

    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        found, bit = -1, 1 << cluster
        open_ = (used & ~(shut.get(2 * source, 0) | shut.get(2 * cluster + 1, 0))) >> size << size
        while found < 0 and open_:
            at = (open_ & -open_).bit_length() - 1
            found = next((b for b in rest_bins[at] if not held[b] & bit and not full[b] >> source & 1), -1)
            open_ &= open_ - 1
        if found < 0:
            found = len(rest)
            rest.append(capacity)
            held.append(0)
            full.append(0)
            keys.append([])
            counts.append({})
        else:
            take(found)
        rest[found] -= size
        held[found] |= bit
        keys[found].append(2 * cluster + 1)
        counts[found][source] = counts[found].get(source, 0) + 1
        if counts[found][source] == per_source:
            full[found] |= 1 << source
            keys[found].append(2 * source)
        put(found)
        out.append(found)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Per piece of a document: doc_id, piece, size, shard, bin (number in the shard), source, cluster."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = r"[\x20\x09-\x0D]+"
    items = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("int").alias("words"),
        F.xxhash64(F.lower(F.trim(F.regexp_replace(text, blank, " ")))).alias("cluster"),
    )
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity).cast("int") - 1, F.lit(0)))))
    items = items.withColumn("size", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity))
    # a piece has `capacity` words, which take two bytes each at least: no shard is dealt more than SHARD_ITEMS on average
    most = docs.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) / (2 * capacity)))).first()[0] or 0
    shards = max(1, -(-most // SHARD_ITEMS))
    # numbers of rows are written, so a task that runs again deals its items as before
    numbered = written(items.select("doc_id", "piece", "size", "source", "cluster", F.monotonically_increasing_id().alias("row")))
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        code = lambda name: np.unique(np.array(table[name].fill_null("" if name == "source" else 0)), return_inverse=True)[1].tolist()
        bins = pack_items(table["size"].to_pylist(), code("source"), code("cluster"), capacity, per_source)
        return table.select(["doc_id", "piece", "size", "shard", "source", "cluster"]).append_column("bin", pa.array(bins, pa.int32()))

    return dealt.select("doc_id", "piece", "size", "shard", "source", "cluster").groupBy("shard").applyInArrow(run, "doc_id bigint, piece int, size int, shard int, source string, cluster bigint, bin int")
