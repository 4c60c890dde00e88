"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf; leaves of a group are numbered by their key, and FANOUT consecutive nodes have one parent. A level is one
aggregation: conditional aggregates spread the children of a parent into FANOUT columns. The columns together hash to the
parent; without a child's own column they are its siblings. Levels are written on the way up; on the way down every parent
hands its own path to its children, so paths travel once per parent and not once per leaf and level.

Numbers are distributed: rows are dealt into ranges of (group, key), numbered within their range, and what stands in the
ranges before is added. No group is a task of its own, however large.

Null doc_ids come first, null lang is a group of its own and the first, a null field is `-`. Equal doc_ids are ordered by
their digest, so repeated rows are consecutive leaves, each with its own proof. Without rows there is no root and no row.
Further columns are ignored, texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sovara.llm.common import fold, written

FANOUT = 8
SLOTS = range(FANOUT)
#: Rows of a table that may be broadcast; above it the same join is shuffled.
SMALL_ROWS = 50_000
#: Rows of a range in which leaves are numbered.
RANGE_ROWS = 200_000


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """UTF-8 length, colon, value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a document that has this text."""
    return digest(*[field(c) for c in (F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint"), text)])


def lower_third(docs: DataFrame) -> Column:
    """The text as somebody else has it: A-Z lower-cased where 3 divides the crc32 of doc_id, unchanged elsewhere."""
    hit = F.coalesce(fold(F.col("doc_id").cast("bigint"), 3) == 0, F.lit(False))
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def leaves(docs: DataFrame, seen: Column) -> DataFrame:
    """group, doc_id, digest of every row, and `seen`, the digest of the row as it is to be verified, with the text `seen`."""
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first, then lang by its bytes
    own = leaf(F.col("text"))
    return docs.select(group.alias("group"), F.col("doc_id").cast("bigint").alias("doc_id"), own.alias("digest"), F.when(seen.eqNullSafe(F.col("text")), own).otherwise(leaf(seen)).alias("seen"))


def _attached(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a table that is broadcast only where it is small."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL_ROWS else table, on)


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """The rows with `nth` (0, 1, .. within their group, in the order of key) and `size`, the number of rows of the group.

    Ties in key are broken arbitrarily, so what differs must be in key. Ranges are cut through ties as well.
    """
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()))
    ranges = max(1, -(-rows.count() // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["group", *key, "tie"]
    sorted_rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = written(sorted_rows.withColumn("id", F.monotonically_increasing_id()).drop("tie")).withColumn("range", F.shiftright("id", 33))
    runs = rows.groupBy("group", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("group", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(of_group).alias("size")))
    return _attached(rows, runs, ["group", "range"]).withColumn("nth", F.col("id") + F.col("shift")).drop("id", "range", "shift")


def climb(rows: DataFrame, item: Column) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all groups from the bottom, and the tops (group, digest).

    rows: group, nth, size, digest. A level has a row per parent: group, nth and size of the parents, c0 .. c7 with the digests
    of its children. The first level also has the children's items, i0 .. i7.
    """
    rows = rows.select("group", "nth", "size", "digest", item.alias("item"))
    most = rows.agg(F.max("size")).first()[0] or 0
    levels, tops = [], [rows.filter("size = 1").select("group", "digest")]
    while most > 1:
        spread = [F.expr(f"max(case when pmod(nth, {FANOUT}) = {k} then {what} end) as {name}{k}") for name, what in (("c", "digest"), ("i", "item")) for k in SLOTS if what in rows.columns]
        parents = rows.filter("size > 1").groupBy("group", F.expr(f"nth div {FANOUT} as nth")).agg(F.expr(f"(max(size) + {FANOUT - 1}) div {FANOUT} as size"), *spread)
        levels.append(written(parents))
        rows = levels[-1].selectExpr("group", "nth", "size", f"sha2(concat_ws('', {', '.join(f'c{k}' for k in SLOTS)}), 256) as digest")
        tops.append(rows.filter("size = 1").select("group", "digest"))
        most = -(-most // FANOUT)
    return levels, reduce(DataFrame.union, tops)


def children(parents: DataFrame, *more: str) -> DataFrame:
    """A row per child: group, nth, digest, `step` (its siblings before and after it), the parent's `more`, and item if the level has one."""
    side = lambda ks: f"concat_ws('', {', '.join(f'c{k}' for k in ks)})" if ks else "''"
    item = ", 'item', i{0}" if "i0" in parents.columns else ""
    child = lambda k: f"named_struct('nth', nth * {FANOUT} + {k}, 'digest', c{k}, 'step', named_struct('before', {side(SLOTS[:k])}, 'after', {side(SLOTS[k + 1 :])}){item.format(k)})"
    return parents.selectExpr("group", *more, f"inline(array({', '.join(map(child, SLOTS))}))").filter("digest is not null")


def descend(levels: list[DataFrame], singles: DataFrame, tops: DataFrame) -> DataFrame:
    """Every leaf with its path: group, digest, item, path (steps from the leaf up), and what tops have besides.

    singles: leaves without siblings (group, digest, item); tops: group, path, and further columns of a group.
    """
    more = [c for c in tops.columns if c not in ("group", "path")]
    out = _attached(singles, tops, ["group"]).select("group", "digest", "item", "path", *more)
    below = None
    for at in range(len(levels) - 1, -1, -1):
        ends = _attached(levels[at].filter("size = 1"), tops, ["group"])
        if below is not None:
            ends = ends.unionByName(levels[at].filter("size > 1").join(below.select("group", "nth", "path", *more), ["group", "nth"]))
        below = children(ends, "path", *more).withColumn("path", F.concat(F.array("step"), "path"))
    return out if below is None else out.unionByName(below.select("group", "digest", "item", "path", *more))


def proof(path: Column) -> Column:
    """Digest of all siblings on the path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(seen: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, seen, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]), 256))


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """A row per document: doc_id, lang, leaf, subroot, root, path, seen (the digest of the row with the text `seen`)."""
    rows = numbered(leaves(docs, F.col("text") if seen is None else seen), "doc_id", "digest")
    item = F.struct("doc_id", "seen")
    levels, tops = climb(rows, item)
    subroots = written(tops)
    langs = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), "name")
    upper, top = climb(langs, F.col("name"))
    root = top.select("digest").first()
    first = langs.sparkSession.createDataFrame([("", [])], "group string, path array<struct<before: string, after: string>>")
    lone = langs.filter("size = 1").select("group", "digest", F.col("name").alias("item"))
    paths = written(descend(upper, lone, first).select(F.col("item").alias("group"), "path", F.col("digest").alias("subroot")))
    found = descend(levels, rows.filter("size = 1").select("group", "digest", item.alias("item")), paths)
    lang = F.when(F.col("group") != "", F.substr("group", F.lit(2)))
    return found.select("item.doc_id", lang.alias("lang"), F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path", "item.seen")


def verify(entries: DataFrame) -> DataFrame:
    """Of a manifest: doc_id, leaf, subroot, root, proof_sha256, folded_root (from `seen` and the path) and whether it is the root."""
    rows = entries.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
