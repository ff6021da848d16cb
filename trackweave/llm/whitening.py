"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors, as whole numbers, are written in blocks. Each step is a pass over the
blocks: a task centres its rows X, takes u = X w and returns the sums of Xᵀu, of u's products
with all earlier left vectors, and of its squares. A left vector is X times a small vector, so
that left vectors need not be stored: the driver keeps those small vectors, both sides are
orthogonalised anew against all earlier ones in each step, and the singular values of the
small bidiagonal matrix give components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import Scratch, batched

COMPONENTS, SCALE = 4, 256
#: Vectors in a block; numbers in a block at most.
BLOCK, BLOCK_NUMBERS = 4_096, 1 << 20
#: Whole numbers beyond this are taken as this: doubles hold no more.
MOST = 1 << 53
EPS = np.finfo(float).eps
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x = floor(256 c) of each row whose vector isn't empty and holds no null or non-finite entry."""
    value = F.transform(vector_col, lambda c: c.cast("double"))
    sound = (F.size(vector_col) > 0) & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), value).alias("v")).where("v is not null").select("vec_id", x.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def in_blocks(distinct: DataFrame, dim: int) -> DataFrame:
    """Rows of up to BLOCK vectors each: their bytes and the smallest integer type that holds them."""
    size = max(1, min(BLOCK, BLOCK_NUMBERS // dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for a in range(0, len(x), size):
                part = x[a : a + size]
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["kind", "data"])

    return batched(distinct.select("x")).mapInArrow(run, "kind string, data binary")


def opened(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield np.frombuffer(data.as_buffer(), kind).reshape(-1, dim)


def moments(blocks: DataFrame, dim: int) -> tuple[int, list[int], list[int]]:
    """Number of vectors and, for each dimension, the exact sums of the numbers and of their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dim, object), np.zeros(dim, object)
        for x in opened(batches, dim):
            small = x.dtype.itemsize < 8 and len(x) < 1 << 31
            x = x.astype(np.int64) if small else x.astype(object)
            n, sums = n + len(x), sums + x.sum(axis=0)
            halves = (x >> 16, x & 0xFFFF) if small else (x, x * 0)  # squares of 32 bits in parts that can't overflow
            squares = squares + (halves[0] ** 2).sum(axis=0).astype(object) * (1 << 32 if small else 1) + (halves[0] * halves[1]).sum(axis=0).astype(object) * (1 << 17) + (halves[1] ** 2).sum(axis=0).astype(object)
        made = [range(dim), [n] * dim, [str(int(s)) for s in sums], [str(int(s)) for s in squares]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["k", "n", "s", "q"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "sq"]
    found = sorted(tuple(r) for r in blocks.mapInArrow(run, "k int, n long, s string, q string").groupBy("k").agg(F.sum("n").alias("n"), *exact).collect())
    return found[0][1], [int(s) for _, _, s, _ in found], [int(q) for *_, q in found]


def total(blocks: DataFrame, dim: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the vectors that fn makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: np.ndarray | None = None
        for x in opened(batches, dim):
            made = fn(x)
            out = made if out is None else out + made
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["k", "v"])

    found = sorted(blocks.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect())
    return np.array([v for _, v in found])


def apart(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """r without its parts along the basis; twice, so that rounding leaves none."""
    for _ in range(2):
        for v in basis:
            r = r - v * (v @ r)
    return r


def bidiagonalised(product: Product, dim: int, trace: float, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values (falling) and their right vectors, as columns.

    product(w, W) gives Xᵀu, Uᵀu and |u|² for u = X w and U = X W. trace is the sum of all squared
    singular values. Steps end when the leading triplets have settled and what the trace leaves
    is less than the smallest of them, so that no equal or larger one can have been missed; at
    the latest when the right vectors fill the space.
    """
    rng = np.random.default_rng(12)
    rights: list[np.ndarray] = []
    lefts, images = np.zeros((dim, 0)), np.zeros((dim, 0))  # u_k = X lefts[:, k]; images: their Xᵀu
    diagonal: list[float] = []
    beside: list[float] = []
    beta = 0.0

    def start() -> np.ndarray:
        v = apart(rng.standard_normal(dim), rights)
        return v / np.linalg.norm(v)

    v, largest = start(), 0.0
    while True:
        rights.append(v)
        w = v - beta * lefts[:, -1] if diagonal else v
        g, c, square = product(w, lefts)
        w, g = w - lefts @ c, g - images @ c
        alpha = float(np.sqrt(max(square - c @ c, 0.0)))
        if alpha <= EPS * dim * largest:  # v lies in what X maps to nothing or to the left vectors there are
            alpha, w, g = 0.0, 0 * w, 0 * g
        else:
            w, g = w / alpha, g / alpha
        largest = max(largest, alpha, beta)
        lefts, images = np.column_stack([lefts, w]), np.column_stack([images, g])
        diagonal.append(alpha)
        r = apart(g - alpha * v, rights)
        beta = float(np.linalg.norm(r))
        p, s, qt = np.linalg.svd(np.diag(diagonal) + np.diag(beside, 1))
        full = len(rights) == dim
        if full or len(s) >= most and (beta * np.abs(p[-1, :most]) <= EPS * s[0]).all() and trace - (s**2).sum() < s[most - 1] ** 2:
            keep = [k for k in range(min(most, len(s))) if s[k] > EPS * dim * s[0]]
            return s[keep], np.column_stack(rights) @ qt[keep].T
        if beta <= EPS * dim * largest:
            beta, v = 0.0, start()
        else:
            v = r / beta
        beside.append(beta)


def whiten(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each row's vector on the leading components, a row for each.

    vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (sum over the
    dimensions of (n x - S)², exact; null where a long can't hold it), whitened, explained (the
    eigenvalue over the trace) and identity_error (largest entry of the whitened covariance minus
    the identity). Components are those of the distinct whole-number vectors.

    Rows with null or empty vectors, or with null or non-finite entries, take no part; vectors must
    have one dimension: where there are several, only rows of the most common one (of equally common
    ones the largest) take part. Rows with a null id and repeated rows get their result each. Numbers
    beyond 2**53 count as that. Components without variance aren't returned, so a table whose vectors
    are all equal, and an empty one, give no rows. Equal eigenvalues are numbered in any order.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if not common:
        return spark.createDataFrame([], RESULT)
    dim = common["dim"]
    rows = rows.where(F.size("x") == dim)
    scratch = Scratch(spark)
    blocks = scratch.written(in_blocks(rows.select("x").distinct(), dim))
    n, sums, squares = moments(blocks, dim)
    mean, spread = np.array([s / n for s in sums]), sum(n * q - s * s for s, q in zip(sums, squares, strict=True))
    trace = spread / n**2

    def product(w: np.ndarray, lefts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ w
            return np.concatenate([u @ centred, u @ (centred @ lefts), [u @ u]])

        found = total(blocks, dim, part)
        return found[:dim], found[dim:-1], found[-1]

    if not spread:
        scratch.dropped()
        return spark.createDataFrame([], RESULT)
    singular, components = bidiagonalised(product, dim, trace * n, most)
    turn = components * (np.sqrt(n) / singular)
    k = turn.shape[1]
    middle = total(blocks, dim, lambda x: ((x - mean) @ turn).sum(axis=0)) / n

    def spread_of(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ turn - middle
        return (y.T @ y).ravel()

    error = float(np.abs(total(blocks, dim, spread_of).reshape(k, k) / n - np.eye(k)).max())
    scratch.dropped()
    explained = singular**2 / n / trace
    exact = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            if not len(x):
                continue
            reach = n * int(np.abs(x).max()) + max(map(abs, sums))
            off = n * x.astype(object if reach**2 * dim >= 1 << 63 else np.int64) - (exact if reach**2 * dim >= 1 << 63 else exact.astype(np.int64))
            deviation = [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]
            white = ((x - mean) @ turn).ravel()
            at = np.repeat(np.arange(len(x)), k)
            repeated = lambda v: pa.array(np.tile(v, len(x)))
            arrays = [batch.column(0).take(pa.array(at)), repeated(np.arange(1, k + 1, dtype=np.int32)), repeated(np.int64([n] * k)), pa.array(deviation, pa.int64()).take(pa.array(at))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(white), repeated(explained), repeated(np.float64([error] * k))], names=[c.split()[0] for c in RESULT.split(", ")])

    return batched(rows).mapInArrow(run, RESULT)


def brute_force(rows: list[tuple[int, list[float]]], most: int = COMPONENTS) -> list[tuple]:
    """vec_id, component, n, deviation, whitened (sign apart), explained: of the covariance matrix's eigenvectors."""
    whole = [(i, [int(np.floor(float(c) * SCALE)) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(1, most + 1):
            out.append((i, k, n, deviation, float((np.array(x) - np.array(sums) / n) @ vectors[:, -k] / np.sqrt(values[-k])), float(values[-k] / values.sum())))
    return out
