"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one row kept per group.

Centroids are learned in numpy on a bounded sample. Every vector belongs to the cell of its nearest centroid, and also visits
each cell with a smaller number in which a vector at the cosine in question could live: for unit vectors x (cell i) and y
(cell j) with |x - y| <= r, x.(c_i - c_j) <= r |c_i - c_j|. So the cells find every pair; nothing is approximate but the
choice of cells, which affects speed only.

A cell is cut into blocks, and one task multiplies one pair of blocks, so a cell with a third of all vectors is as many tasks
as it needs. A block product returns, for each of its vectors, how many vectors it links to and one link of a spanning
forest: output grows with the vectors of a block, not with their pairs. Copies of a vector are one row with a count.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of different
lengths. Equal rows are vectors of their own and link to each other. Rows with null vec_id count as links of others and have
no component of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import cut_lineage
from sovara.llm.components import connected

#: Vectors to learn centroids from, vectors in a cell aimed at, most cells, rows in a block, and rows of a block multiplied
#: at once.
SAMPLE, CELL, MOST_CELLS, BLOCK, TILE = 20_000, 4096, 4096, 4096, 512


def learn_centroids(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    random = np.random.default_rng(seed)
    centroids = vectors[random.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        home = (vectors @ centroids.T).argmax(1)
        order = np.argsort(home, kind="stable")
        found, start = np.unique(home[order], return_index=True)
        mean = np.add.reduceat(vectors[order], start)
        size = np.linalg.norm(mean, axis=1)
        centroids[found[size > 0]] = mean[size > 0] / size[size > 0, None]
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1)
    out = out / np.abs(out).max(1, keepdims=True)  # no overflow or underflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _places(vectors: DataFrame, centroids: np.ndarray, cosine: float) -> DataFrame:
    """One row for each vector and cell it is in: code, copies, vector, cell, and whether it only visits."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    reach = np.sqrt(2 - 2 * cosine) + 1e-9

    def run(batches):
        c = shared.value
        apart = np.linalg.norm(c[:, None] - c[None], axis=2) if len(c) <= 1024 else None
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = _matrix(batch.column("vector"))
                near = x @ c.T
                home = near.argmax(1)
                best = near[np.arange(len(x)), home]
                gap = apart[home] if apart is not None else np.sqrt(np.maximum(2 - 2 * (c @ c.T)[home], 0))
                inside = (best[:, None] - near <= reach * gap + 1e-9) & (np.arange(len(c))[None] < home[:, None])
                row, cell = np.nonzero(inside)
                row, cell, visits = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]), np.repeat([False, True], [len(x), len(row)])
                piece = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("copies"), piece.column("vector"), pa.array(cell.astype(np.int32)), pa.array(visits)], ["id", "copies", "vector", "cell", "visits"])

    return vectors.select("id", "copies", "vector").mapInArrow(run, "id bigint, copies bigint, vector array<double>, cell int, visits boolean")


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (left) and each column (right) of a block reaches through the block's links."""
    most = np.iinfo(np.int64).max
    parts = [slice(a, a + TILE) for a in range(0, len(left), TILE)]
    while True:
        new_left, new_right = left.copy(), right.copy()
        for p in parts:
            np.minimum(new_right, np.where(linked[p], left[p, None], most).min(0, initial=most), out=new_right)
        for p in parts:
            np.minimum(new_left[p], np.where(linked[p], new_right[None], most).min(1, initial=most), out=new_left[p])
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _product(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"].combine_chunks())
        x, ids, copies = _matrix(table["vector"].combine_chunks()), np.asarray(table["id"]), np.asarray(table["copies"])
        rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        if not len(columns) and (side == 2).all():  # a block with itself
            columns = rows
        y, itself, linked = x[columns].T, columns is rows, []
        row_links, column_links = [np.zeros(0, np.int64)], np.zeros(len(columns), np.int64)
        for a in range(0, len(rows), TILE):
            part = x[rows[a : a + TILE]] @ y >= cosine
            if itself:
                part[np.arange(len(part)), a + np.arange(len(part))] = False
            row_links.append(part @ copies[columns])
            column_links += copies[rows[a : a + TILE]] @ part
            linked.append(part)
        linked = np.concatenate([np.zeros((0, len(columns)), bool), *linked])
        if itself:
            links, to, where = column_links, _forest(linked, ids[rows], ids[rows])[1], rows
        else:
            links = np.concatenate([*row_links, column_links])
            to = np.concatenate(_forest(linked, ids[rows], ids[columns]))
            where = np.concatenate([rows, columns])
        some = links > 0
        return pa.table({"id": ids[where][some], "links": links[some].astype(np.int64), "to": to[some].astype(np.int64)})

    return run


def block_pairs(places: DataFrame) -> DataFrame:
    """Deals places to pairs of blocks: members among themselves (side 2, or 0 and 1), visitors (0) with members (1)."""
    counts = places.groupBy("cell").agg(F.count_if(~F.col("visits")).alias("members"), F.count_if("visits").alias("guests"))
    cut = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    counts = counts.select("cell", cut("members").alias("mb"), cut("guests").alias("gb"), "guests")  # a row for each of at most MOST_CELLS cells
    dealt = places.join(F.broadcast(counts), "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("visits"), F.col("gb")).otherwise(F.col("mb"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))
    own = F.col("own")
    inner = F.transform(every("mb"), lambda o: pair(0, F.least(o, own), F.greatest(o, own), F.when(o == own, 2).otherwise(F.when(own < o, 0).otherwise(1))))
    outer = F.when(F.col("guests") > 0, F.transform(every("gb"), lambda g: pair(1, g, own, F.lit(1)))).otherwise(F.array().cast("array<struct<kind:int,p:int,q:int,side:int>>"))
    guest = F.transform(every("mb"), lambda m: pair(1, own, m, F.lit(0)))
    return dealt.select("id", "copies", "vector", "cell", F.explode(F.when(F.col("visits"), guest).otherwise(F.concat(inner, outer))).alias("x")).select("id", "copies", "vector", "cell", "x.*")


def near_duplicates(table: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    fit = F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("code", F.when(F.coalesce(fit, F.lit(False)), F.concat_ws(":", F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), F.col("vector"))), F.size("vector"))))
    # a distinct vector is named by a hash of its code
    unique = rows.filter("code is not null").groupBy("code").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    unique = cut_lineage(unique.withColumn("id", F.xxhash64("code")))
    found = None
    sizes = {r[0]: r[1] for r in unique.groupBy(F.size("vector")).count().collect()}  # a row for each length of vectors
    for length, n in sorted(sizes.items()):
        own = unique.filter(F.size("vector") == length)
        rate = SAMPLE / n
        sample = (own.filter(F.pmod(F.col("id"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)))) if rate < 1 else own).select("id", "vector").toArrow().sort_by("id")
        if not sample.num_rows:
            sample = own.select("id", "vector").limit(1).toArrow()
        centroids = learn_centroids(_matrix(sample["vector"].combine_chunks()), int(min(MOST_CELLS, max(1, n // CELL))))
        blocks = block_pairs(cut_lineage(_places(own, centroids, cosine)))
        part = blocks.groupBy("cell", "kind", "p", "q").applyInArrow(_product(cosine), "id bigint, links bigint, to bigint")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found.groupBy("id", "to").agg(F.sum("links").alias("links")))
    reach = connected(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    unique = unique.select("code", "id", "least", "copies").join(links, "id", "left").join(reach, unique["id"] == reach["vertex"], "left").withColumn("group", F.coalesce("component", "id"))
    least = unique.groupBy("group").agg(F.min("least").alias("component_id"))
    result = unique.join(least, "group").select("code", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "code").join(result, "code", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
