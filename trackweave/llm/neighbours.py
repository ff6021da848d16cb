"""Nearest neighbours by a block matrix join of quantised vectors.

Candidates are cut into row blocks and queries into column blocks; each pair of blocks
is one product tile, a task of its own. A vector is held as int8 steps of its own scale,
with the exact length of what rounding lost. The tile's whole-number products give the
distance of the rounded vectors, and the two residual lengths bound how far the true one
can be off. Only pairs whose lower bound doesn't exceed the k-th smallest upper bound are
computed from the original vectors; each tile keeps a heap of k for a query, and the
heaps of a row of tiles are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import written

#: Vectors of either side in one block.
CANDIDATES, QUERIES = 16_384, 4_096
#: Query rows of a tile that are multiplied at a time; numbers of surviving pairs' vectors that are gathered at a time.
STRIP, GATHERED = 64, 1 << 21


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps, the step size and the length of the residual of each row."""
    step = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    q = np.clip(np.rint(x / step[:, None]), -127, 127).astype(np.int8)
    lost = np.linalg.norm(x - q * step[:, None], axis=1) + np.finfo(float).tiny
    return q, step, lost


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, the squares added in the order of the components; where they would be too large or too small for a double, of differences over the largest."""
    d = x - y

    def root(d: np.ndarray) -> np.ndarray:
        total = np.zeros(len(d))
        for k in range(d.shape[1]):
            total += d[:, k] * d[:, k]
        return np.sqrt(total)

    with np.errstate(over="ignore", under="ignore"):
        out = root(d)
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        most = np.abs(d[odd]).max(axis=1)
        odd, most = odd[most > 0], most[most > 0]
        out[odd] = root(d[odd] / most[:, None]) * most
    return out


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest candidates of each query, ties to the smaller id; the own id takes no part."""
    unit = max(np.abs(q).max(), np.abs(c).max())  # bounds are of vectors in this unit, which can't overflow
    qq, qs, ql = quantised(q / unit)
    cq, cs, cl = quantised(c / unit)
    # Products of int8 are whole numbers; in doubles their sums stay exact.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right, c_norm = cq.astype(kind).T, (cq.astype(np.float64) ** 2).sum(axis=1) * cs**2
    out = []
    for a in range(0, len(q), STRIP):
        part = slice(a, a + STRIP)
        dots = (qq[part].astype(kind) @ right).astype(np.float64) * qs[part, None] * cs[None]
        q_norm = (qq[part].astype(np.float64) ** 2).sum(axis=1) * qs[part] ** 2
        square = q_norm[:, None] + c_norm[None] - 2 * dots
        slack = 1e-12 * (q_norm[:, None] + c_norm[None])
        lost = ql[part, None] + cl[None]
        low = np.sqrt(np.maximum(square - slack, 0)) - lost
        high = np.sqrt(np.maximum(square, 0) + slack) + lost
        same = qid[part, None] == cid[None]
        high[same] = np.inf
        width = high.shape[1]
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] if width >= k else np.full(len(high), np.inf)
        bound = bound * (1 + 1e-9)
        i, j = np.nonzero((low * (1 - 1e-9) <= bound[:, None]) & ~same)
        piece, own = max(1, GATHERED // q.shape[1]), q[part]  # where vectors are alike, all pairs survive
        exact = np.concatenate([distances(own[i[b : b + piece]], c[j[b : b + piece]]) for b in range(0, max(1, len(i)), piece)])
        order = np.lexsort((cid[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        out += zip(qid[part][i[top]].tolist(), cid[j[top]].tolist(), exact[top].tolist(), strict=True)
    return out


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest candidates.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows
    without an id, take no part; a query meets only candidates of its own dimension, never its own id.
    Rows that share an id are candidates each; query rows that share one are one query, with the pairs of all.
    Equally near candidates come by id; where all vectors are equal, all pairs are compared, in bounded pieces.
    Fewer than k candidates: all of them. Columns of other names don't matter. No queries or no candidates: no rows.
    """
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    sound = (F.size(vector_col) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias(vector_col)).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
        return rows.select("id", vector.alias("v"), F.size(vector_col).alias("dim"))

    q, c = written(usable(queries)), written(usable(candidates))
    n_q, n_c = q.count(), c.count()
    rows, columns = max(1, -(-n_c // CANDIDATES)), max(1, -(-n_q // QUERIES))
    # A row of tiles is dealt by a hash of the id; each side goes once to every block of the other.
    right = c.select(F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), "dim", "id", "v")
    left = q.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int").alias("j"), "dim", "id", "v")

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(left) and len(right):
            found = tile(left["id"].to_numpy(), np.stack(left["v"]).astype(float), right["id"].to_numpy(), np.stack(right["v"]).astype(float), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    heaps = left.groupBy("i", "j", "dim").cogroup(right.groupBy("i", "j", "dim")).applyInPandas(multiply, "query_id long, vec_id long, score double")
    merged = heaps.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // 1_000))).alias("part"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(rows["score"], rows["vec_id"], strict=True))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": range(1, len(best) + 1), "vec_id": [v for _, v in best], "score": [s for s, _ in best]})

    schema = "query_id long, rank int, vec_id long, score double"
    if rows >= 1_000:  # a query's heaps are many: merge by parts first
        heaps = merged.applyInPandas(merge, schema).drop("rank")
    return heaps.groupBy("query_id").applyInPandas(merge, schema)
