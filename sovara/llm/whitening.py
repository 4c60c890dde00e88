"""Whitening of embeddings from a bit-sliced scatter matrix.

Entries become integers. Every block of rows is turned on its side: of each dimension, less the block's smallest value, each bit
plane is packed across the rows into 64-bit words. The cross-product of two dimensions is then the sum, over pairs of their
planes, of 2^(p+q) times the number of ones in the AND of the two planes. These sums are exact, so are the totals that Spark adds
up as decimals, and V = (n XX' - SS') / n^2 is centred as integers before the only rounding, in front of eigh.

What vectors of one length have to do with those of another is not defined, so each length is a fit list of its own: its
matrix is solved in one task, whose size is that of the matrix and not of the data.

Null vectors and vectors with null or non-finite entries are left out; an empty vector has no component and so no row. Entries
beyond +-2^40 / 1024 count as that bound. A component without variance has whitened null; explained is null if nothing varies.
Null or repeated vec_ids give rows of their own. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sovara.llm.common import written

SCALE, OFFSET = 1024, 100_000
#: Largest size of scaled entries: their squares, summed over 10^13 rows, fit a decimal of 38 digits.
BOUND = 1 << 40
#: Rows of a block, whose planes stay in a processor's cache.
BLOCK = 8_192
#: Lengths whose models are sent to all tasks; with more of them models are joined to their rows.
SENT_LENGTHS = 256

SCATTER = "dims int, i int, j int, total decimal(38,0)"
MODEL = "dims int, n bigint, sums array<bigint>, axes array<double>, spread array<double>, explained array<double>"
SCORES = "vec_id bigint, dims int, n bigint, deviation decimal(38,0), whitened array<double>"


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of bigint) and dims of the vectors that can be used."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = f"cast(floor(greatest(-{BOUND}D, least({BOUND}D, c * {SCALE}))) as bigint) + {OFFSET}"
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable)
    return rows.selectExpr("vec_id", f"transform(v, c -> {scaled}) as x", "size(v) as dims")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and integer matrix of each length in the batch, in blocks."""
    dims = np.asarray(batch.column("dims"))
    lists = batch.column("x")
    flat, start = np.asarray(lists.values), np.asarray(lists.offsets)
    for d in np.unique(dims):
        every = np.flatnonzero(dims == d)
        for a in range(0, len(every), BLOCK):
            at = every[a : a + BLOCK]
            yield int(d), at, flat[start[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)


def exact(values: np.ndarray) -> np.ndarray:
    """Python integers in place of 64-bit ones."""
    return values.astype(object)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums per dimension and sums of products per pair of dimensions of an integer matrix, from its bit planes."""
    n, d = x.shape
    low = x.min(axis=0)
    shifted = (x - low).T  # not negative, one row per dimension
    width = [int(v).bit_length() for v in shifted.max(axis=1)]
    owner = np.repeat(np.arange(d), width)
    place = np.concatenate([np.arange(w) for w in width]) if sum(width) else np.zeros(0, int)
    bits = np.zeros((len(owner), -(-n // 64) * 64), np.uint8)
    bits[:, :n] = (shifted[owner] >> place[:, None]) & 1
    planes = np.packbits(bits, axis=1).view(np.uint64)
    weight = np.array([1 << int(p) for p in place], object)
    product = np.zeros((d, d), object)
    starts = np.concatenate([[0], np.cumsum(width)])
    filled = np.flatnonzero(np.diff(starts))
    for plane in range(len(planes)):
        i = owner[plane]
        ones = np.bitwise_count(planes[plane] & planes[starts[i] :]).sum(axis=1, dtype=np.int64)
        later = filled[filled >= i]
        product[i, later] += weight[plane] * np.add.reduceat(exact(ones) * weight[starts[i] :], starts[later] - starts[i])
    product = np.triu(product) + np.triu(product, 1).T
    total = np.zeros(d, object)
    np.add.at(total, owner, exact(np.bitwise_count(planes).sum(axis=1, dtype=np.int64)) * weight)
    low = exact(low)
    return total + n * low, product + np.outer(low, total) + np.outer(total, low) + n * np.outer(low, low)


def scatter(rows: DataFrame) -> DataFrame:
    """Exact totals over all rows of integers(): dims, i, j, total; (-1, -1) is the number of rows, (-1, j) a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, at, x in matrices(batch):
                count, total, product = found.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
                more, products = cross_products(x)
                found[d] = [count + len(at), total + more, product + products]
        for d, (count, total, product) in found.items():
            i, j = np.triu_indices(d)
            values = [count, *total, *product[i, j]]
            left, right = np.concatenate([np.full(d + 1, -1), i]), np.concatenate([np.arange(-1, d), j])
            for a in range(0, len(values), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(left[part]), d), pa.int32()), pa.array(left[part], pa.int32()), pa.array(right[part], pa.int32()), pa.array(values[part], pa.decimal128(38, 0))], ["dims", "i", "j", "total"]
                )

    return rows.mapInArrow(run, SCATTER).groupBy("dims", "i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def solve(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes (a row per component), standard deviations and explained shares, by falling eigenvalue; a deviation of 0 is no variance."""
    d = len(sums)
    centred = n * products - np.outer(sums, sums)  # integers
    v = np.array([[int(c) / (n * n) for c in row] for row in centred], float).reshape(d, d)
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value, kind="stable")[:components]
    value, axes = value[order], vector[:, order].T
    trace = sum(int(centred[k, k]) for k in range(d)) / (n * n)
    spread = np.sqrt(np.where(value > d * np.finfo(float).eps * max(value[0], 0), value, 0.0))
    return axes, spread, value / trace if trace else np.full(len(value), np.nan)


def fit(totals: DataFrame, components: int = 8) -> DataFrame:
    """A model per length of vectors, from scatter(): dims, n, sums, axes (row by row), spread, explained."""

    def run(table: pa.Table) -> pa.Table:
        d = table["dims"][0].as_py()
        i, j, total = (table[c].to_pylist() for c in ("i", "j", "total"))
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for a, b, value in zip(i, j, map(int, total), strict=True):
            if b < 0:
                n = value
            elif a < 0:
                sums[b] = value
            else:
                products[a, b] = products[b, a] = value
        axes, spread, explained = solve(n, sums, products, components) if d else (np.zeros((0, 0)), np.zeros(0), np.zeros(0))
        share = [None if np.isnan(e) else float(e) for e in explained]
        return pa.table({
            "dims": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([[int(s) for s in sums]], pa.list_(pa.int64())), "axes": pa.array([axes.ravel().tolist()], pa.list_(pa.float64())),
            "spread": pa.array([spread.tolist()], pa.list_(pa.float64())), "explained": pa.array([share], pa.list_(pa.float64())),
        })

    return totals.groupBy("dims").applyInArrow(run, MODEL)


def project(x: np.ndarray, n: int, sums: np.ndarray, axes: np.ndarray, spread: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact sum of (n x - S)^2 and whitened values (nan where there is no variance) of each row."""
    d = x.shape[1]
    whole, rest = sums // n, sums % n  # n x - S = n (x - whole) - rest, whose parts are small
    near = x - whole
    most = int(np.abs(near).max(initial=0)) * n + n
    if d * most * most < 1 << 63:
        far = near * n - rest
        deviation = (far * far).sum(axis=1).tolist()
    else:
        far = exact(near) * n - exact(rest)
        deviation = (far * far).sum(axis=1).tolist()
    centred = near - rest / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return deviation, np.where(spread > 0, centred @ axes.reshape(len(spread), d).T / spread, np.nan)


def scores(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Per row of integers(): vec_id, dims, n, deviation (null beyond 38 digits), whitened."""
    names = ["n", "sums", "axes", "spread"]
    known = {m["dims"]: [m[c] for c in names] for m in models.select("dims", *names).limit(SENT_LENGTHS + 1).collect()}
    joined = len(known) > SENT_LENGTHS
    if joined:
        known = None
        rows = rows.join(models.select("dims", *names), "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in matrices(batch):
                model = [batch.column(c)[int(at[0])].as_py() for c in names] if known is None else known[d]
                n, sums, axes, spread = model[0], *map(np.array, model[1:])
                deviation, values = project(x, n, sums.astype(np.int64), axes.astype(float), spread.astype(float))
                k = values.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel())))
                fits = [v if v < 10**38 else None for v in deviation]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), n), pa.int64()), pa.array(fits, pa.decimal128(38, 0)), lists], ["vec_id", "dims", "n", "deviation", "whitened"]
                )

    return rows.mapInArrow(run, SCORES)


def identity_errors(found: DataFrame, components: int = 8) -> DataFrame:
    """dims, identity_error: how far the covariance of the whitened values, centred on their own means, is from the identity."""
    w = lambda k: f"get(whitened, {k})"
    means = found.groupBy("dims").agg(F.expr(f"array({', '.join(f'avg({w(k)})' for k in range(components))}) as mean"))
    off = lambda k: f"({w(k)} - get(mean, {k}))"
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    error = [f"abs(avg({off(i)} * {off(j)}) - {int(i == j)})" for i, j in pairs]
    rows = found.join(F.broadcast(means) if means.count() <= SENT_LENGTHS else means, "dims")
    return rows.groupBy("dims").agg(F.expr(f"array_max(array({', '.join(error)})) as identity_error"))


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error (of the list)."""
    rows = integers(embeddings)
    models = written(fit(scatter(rows), components))
    found = written(scores(rows, models))
    about = models.select("dims", "explained").join(identity_errors(found, components), "dims", "left")
    every = found.join(F.broadcast(about) if models.count() <= SENT_LENGTHS else about, "dims")
    return every.selectExpr("vec_id", "n", "deviation", "identity_error", "explained as shares", "posexplode(whitened) as (k, whitened)").selectExpr(
        "vec_id", "k + 1 as component", "n", "deviation", "whitened", "get(shares, k) as explained", "identity_error"
    )
