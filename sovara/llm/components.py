"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import cut_lineage

#: Links of a partition: a small table is in few partitions, so its rounds exchange and write few files.
LINKS = 200_000


def packed(table: DataFrame) -> DataFrame:
    """A checkpointed or written table in partitions of about LINKS rows: a small one is one partition, so that its joins and
    aggregations exchange nothing, and the driver keeps no tasks for partitions that hold next to nothing."""
    return table.coalesce(max(1, -(-table.count() // LINKS)))


def connected(links: DataFrame) -> DataFrame:
    """links: a, b (bigint), in any direction. Returns vertex, component for the vertices that are not the smallest of theirs.

    Both steps are an aggregation and an equi-join, so a vertex with very many links is split by adaptive execution. Links
    with a null end or from a vertex to itself say nothing. Every round is checkpointed.
    """
    pairs = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = pairs.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        state = now
        pairs = pairs.coalesce(-(-now[0] // LINKS))
        both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))
        pairs = cut_lineage(large.join(low, "a").select(F.inline(ends)).filter("a <> b").distinct())
