"""What cells say, read once per distinct text.

A Reading turns the text of one or more cells into columns and looks at nothing else. `in_place` reads every row. `by_distinct`
makes a dictionary first: one pass unpivots the cells of all readings into (reading, text) and counts them, every distinct text is
read once, and what was read is joined back.

The size of each dictionary decides how, never what:

* texts that hardly repeat are read in place, as a dictionary would only add work;
* a dictionary below BROADCAST_BYTES is broadcast;
* a larger one is joined by a shuffle. Its hottest texts, each with more than 1/HOT of the rows and so fewer than HOT of them, are
  broadcast, and their rows are dealt at random in the shuffle, as are those without text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sovara.sources.scratch import written

#: A dictionary with more entries than this share of the cells saves nothing.
REPEATS = 0.5
#: Bytes of text and rows up to which a dictionary is broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 400_000
#: A text is hot if it has more than 1/HOT of all cells of its reading.
HOT = 1000


@dataclass(frozen=True)
class Reading:
    """keys: columns of text that `read` looks at; results: columns that it adds. Both have names of their own."""

    name: str
    keys: tuple[str, ...]
    results: tuple[str, ...]
    read: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Use:
    """A reading of certain cells; its results get the suffix."""

    reading: Reading
    cells: tuple[Column, ...]
    suffix: str = ""

    @property
    def results(self) -> list[str]:
        return [f"{c}{self.suffix}" for c in self.reading.results]

    @property
    def key(self) -> Column:
        return F.array(*self.cells)


def in_place(df: DataFrame, use: Use) -> DataFrame:
    """The rows with the results of the reading; as they are if they have them."""
    if set(use.results) <= set(df.columns):
        return df
    rows = use.reading.read(df.withColumns(dict(zip(use.reading.keys, use.cells, strict=True))))
    return rows.withColumnsRenamed(dict(zip(use.reading.results, use.results, strict=True))).drop(*use.reading.keys)


def dictionary(df: DataFrame, uses: Iterable[Use]) -> DataFrame:
    """reading, key (array of texts), cells: how often each distinct text occurs. Equal texts meet within their task first."""
    cells = F.array(*[F.struct(F.lit(u.reading.name).alias("reading"), u.key.alias("key")) for u in uses])
    return df.select(F.inline(cells)).groupBy("reading", "key").agg(F.count("*").alias("cells"))


def _read_entries(entries: DataFrame, reading: Reading) -> DataFrame:
    rows = entries.filter(F.col("reading") == reading.name).select("key", "cells", *[F.get("key", F.lit(i)).alias(k) for i, k in enumerate(reading.keys)])
    return written(reading.read(rows).select("key", "cells", *reading.results))


def _joined(df: DataFrame, use: Use, entries: DataFrame, cells: int, small: bool) -> DataFrame:
    named = entries.select("key", "cells", *[F.col(c).alias(n) for c, n in zip(use.reading.results, use.results, strict=True)])
    rows = df.withColumn("_key", use.key)
    if small:
        return rows.join(F.broadcast(named.drop("cells")), F.col("_key") == F.col("key"), "left").drop("_key", "key")
    hot = named.filter(F.col("cells") * HOT > cells)  # fewer than HOT rows
    rows = rows.join(F.broadcast(hot.select(F.col("key").alias("_hot_key"), F.struct(*use.results).alias("_hot"))), F.col("_key") == F.col("_hot_key"), "left")
    # a key that no text has, spread over all partitions: texts of hot rows are found already
    spread = F.array(*[F.lit(None).cast("string")] * (len(use.cells) + 1), F.pmod(F.xxhash64(*[c for c in df.columns if c != "flags"][:1]), F.lit(1 << 16)).cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("_hot_key").isNull(), F.col("_key")).otherwise(spread))
    cold = named.filter(F.col("cells") * HOT <= cells).drop("cells").withColumnsRenamed({n: f"_cold{n}" for n in use.results})
    rows = rows.join(cold.hint("shuffle_hash"), F.col("_key") == F.col("key"), "left")
    found = {n: F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot.{n}")).otherwise(F.col(f"_cold{n}")) for n in use.results}
    return rows.withColumns(found).drop("_key", "key", "_hot_key", "_hot", *[f"_cold{n}" for n in use.results])


def by_distinct(df: DataFrame, uses: list[Use]) -> DataFrame:
    """The rows with the results of all uses."""
    entries = written(dictionary(df, uses))
    size = F.sum(F.coalesce(F.aggregate("key", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0)) + 64), F.lit(64)))
    found = {r["reading"]: r for r in entries.groupBy("reading").agg(F.count("*").alias("entries"), F.sum("cells").alias("cells"), size.alias("bytes")).collect()}  # a row per reading
    worth = {n: r for n, r in found.items() if r["entries"] <= REPEATS * r["cells"]}
    readings = {u.reading.name: u.reading for u in uses if u.reading.name in worth}
    with ThreadPoolExecutor(max(1, len(readings))) as pool:  # small jobs side by side
        read = dict(zip(readings, pool.map(lambda r: _read_entries(entries, r), readings.values()), strict=True))
    for use in uses:
        name = use.reading.name
        if name in read:
            about = worth[name]
            df = _joined(df, use, read[name], about["cells"], about["bytes"] <= BROADCAST_BYTES and about["entries"] <= BROADCAST_ROWS)
        else:
            df = in_place(df, use)
    return df
