"""SimHash near-duplicates through vantage-point trees.

Two fingerprints that differ in at most 4 bits differ in at most 2 bits of one half, so
each half has a tree of its own. Level k of a tree parts by the Hamming distance of block
k (8 bits) to a vantage point; blocks share no bits, so along a path the triangle bounds
add: a pair within 2 bits has ring numbers whose differences sum to 2 at most. A
fingerprint lives in the shard of its own ring path and asks, besides it, only the shards
whose paths lie within that bound; all other branches are pruned. Shards compare their
fingerprints in blocks and return a spanning forest of the exact pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import connected, fresh, map_text, tag_of, written

WORDS, SEED, NEAR = 4, 42, 4
HALF_NEAR = NEAR // 2
#: Fingerprints of one shard that a task holds of either side; larger shards are cut into a grid.
SIDE = 20_000
#: A tree gets levels until its shards are expected to hold so many.
SHARD = 1_500
#: A Jaccard similarity of 4 in 5 makes texts alike. Of pairs just that alike, 1 - (1 - 0.8**5)**20 = 0.9996 share a band.
ALIKE, BANDS, ROWS = (4, 5), 20, 5
MASKS, FACTORS = np.random.default_rng(11).integers(0, 2**64 - 1, (2, BANDS * ROWS, 1), np.uint64, endpoint=True) | np.uint64(1)
#: Texts and shingles of one part of a group of candidates.
CELL_TEXTS, CELL_SHINGLES = 2_000, 400_000


def shingle_hashes(text: bytes, size: int = WORDS) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; none of a wordless text."""
    words = text.lower().split()  # of bytes: A-Z and the white space of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Majority bits as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over).view(">i8")[0])


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; as a signed 64-bit number."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = WORDS) -> DataFrame:
    """doc_id, tag (of the text) and fp of each row."""

    def run(rows: list[bytes]) -> list:
        return [np.array([fingerprint(t, size) for t in rows], np.int64)]

    tagged = docs.select("doc_id", F.coalesce(tag_of(text_col), F.lit(-1)).alias("tag"), F.col(text_col).alias("text"))
    return map_text(tagged, "text", [T.StructField("fp", T.LongType())], run, ["doc_id", "tag"])


def ring_moves(depth: int) -> np.ndarray:
    """All differences of ring paths within the bound."""
    steps = range(-HALF_NEAR, HALF_NEAR + 1)
    return np.array([m for m in itertools.product(steps, repeat=depth) if sum(map(abs, m)) <= HALF_NEAR], np.int64)


def visits(fp: np.ndarray, vantage: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards, fingerprints and whether each is at home there. Of two paths the earlier asks the later."""
    blocks = (fp ^ np.int64(vantage)).astype("<i8").view(np.uint8).reshape(-1, 8)
    rings, weights, moves = np.bitwise_count(blocks).astype(np.int64), 9 ** np.arange(depth), ring_moves(depth)
    shards, rows, home = [], [], []
    for tree in range(2):
        own = rings[:, 4 * tree : 4 * tree + depth]
        path = own @ weights
        for move in moves:
            to = own + move
            code = to @ weights
            ok = (to >= 0).all(axis=1) & (to <= 8).all(axis=1) & (code >= path)
            shards.append(code[ok] * 2 + tree)
            rows.append(fp[ok])
            home.append(np.full(int(ok.sum()), not move.any()))
    return np.concatenate(shards), np.concatenate(rows), np.concatenate(home)


def forest(home: np.ndarray, asking: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs (asking, home) that differ in at most `near` bits."""
    nodes = np.unique(np.concatenate([home, asking]))
    bits = home.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    at, block = np.searchsorted(nodes, home), 256
    parent = np.arange(len(nodes))
    for a in range(0, len(asking), block):
        part = asking[a : a + block]
        q, h = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ bits[None]) <= near)
        x, y = np.searchsorted(nodes, part)[q], at[h]
        x, y = x[x != y], y[x != y]
        while len(x):
            px, py = parent[x], parent[y]
            apart = px != py
            x, y, px, py = x[apart], y[apart], px[apart], py[apart]
            np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of column fp (distinct values) which differ in at most 4 bits."""
    spark = distinct.sparkSession
    count, vantage = distinct.agg(F.count("*"), F.min_by("fp", F.xxhash64("fp"))).first()
    depth = min(4, max(1, math.ceil(math.log(max(1, count) / SHARD, 5))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for a in range(0, len(fp), 2_000):
                shard, rows, home = visits(fp[a : a + 2_000], vantage, depth)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(rows), pa.array(home)], names=["shard", "fp", "home"])

    if not count:
        return spark.createDataFrame([], "a long, b long")
    asked = distinct.select("fp").mapInArrow(ask, "shard int, fp long, home boolean")
    # At most 2 * 9**depth shards, so that their sizes can be broadcast.
    sizes = written(asked.groupBy("shard").agg(F.ceil(F.count_if("home") / SIDE).cast("int").alias("h"), F.ceil(F.count("*") / SIDE).cast("int").alias("v")).where("h > 0"))
    asked = asked.join(F.broadcast(sizes), "shard")  # shards without a home hold nothing to find
    part = F.xxhash64("fp")
    # Homes are rows to find and also ask; a shard's grid has h * v cells.
    find = asked.where("home").select("shard", F.pmod(part, F.col("h")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("j"), "fp", F.lit(True).alias("home"))
    seek = asked.select("shard", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("i"), F.pmod(part, F.col("v")).cast("int").alias("j"), "fp", F.lit(False).alias("home"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        fp, home = cell["fp"].to_numpy(), cell["home"].to_numpy()
        a, b = forest(fp[home], fp[~home])
        return pd.DataFrame({"a": a, "b": b})

    return find.unionByName(seek).groupBy("shard", "i", "j").applyInPandas(compare, "a long, b long")


def wording(text: bytes) -> int:
    """One number for all texts of the same words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)).view(np.int64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 4_096):
        least = np.minimum(least, ((hashes[a : a + 4_096][None] ^ MASKS) * FACTORS).min(axis=1))
    return [int(np.uint64(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)).view(np.int64)) for k in range(BANDS)]


def alike_edges(fp: np.ndarray, part: np.ndarray, shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs whose shingles have a Jaccard similarity of 0.8 at least. If there are two parts, pairs across them only."""
    order = np.argsort([len(x) for x in shingles], kind="stable")
    fp, part, sets = fp[order], part[order], [frozenset(shingles[i].tolist()) for i in order]
    size, label, across, edges = np.array([len(x) for x in sets]), np.arange(len(sets)), len(set(part.tolist())) > 1, []
    for i in range(len(sets)):
        rest = slice(i + 1, None)
        able = (label[rest] != label[i]) & (size[rest] * ALIKE[0] <= size[i] * ALIKE[1])
        for j in np.flatnonzero(able & (part[rest] != part[i]) if across else able) + i + 1:
            if label[j] != label[i]:
                both = len(sets[i] & sets[j])
                if both * ALIKE[1] >= (size[i] + size[j] - both) * ALIKE[0]:
                    edges.append((fp[i], fp[j]))
                    label[label == label[j]] = label[i]
    a = np.array(edges, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def alike_pairs(docs: DataFrame, text_col: str = "text", size: int = WORDS) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all texts whose distinct shingles have a Jaccard similarity of 0.8 at least.

    Texts that share a band of minimum hashes are candidates, and so are those connected through
    others; their shingles are compared exactly. A large group is cut into a grid of cells.
    """

    def sketch(rows: list[bytes]) -> list:
        return [np.array([wording(t) for t in rows], np.int64), [bands(h) if len(h := shingle_hashes(t, size)) else [] for t in rows]]

    def content(rows: list[bytes]) -> list:
        found = [shingle_hashes(t, size) for t in rows]
        return [np.array([wording(t) for t in rows], np.int64), np.array([majority(h) for h in found], np.int64), [np.unique(h).view(np.int64) for h in found]]

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    tagged = docs.select("doc_id", F.coalesce(tag_of(text_col), F.lit(-1)).alias("tag"), F.col(text_col).alias("text"))
    sketched = map_text(tagged, "text", [T.StructField("whole", long), T.StructField("keys", longs)], sketch, ["doc_id", "tag"])
    texts = written(sketched.where("size(keys) > 0").groupBy("whole").agg(F.max(F.struct("doc_id", "tag")).alias("origin"), F.first("keys").alias("keys")))
    keyed = texts.select("whole", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("whole").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    nodes = written(connected(keyed.join(shared, "key").select(F.col("whole").alias("a"), "b").where("a <> b").distinct()))
    chosen = texts.join(nodes.select(F.col("node").alias("whole")), "whole", "left_semi").select("origin.*").withColumnsRenamed({"doc_id": "doc", "tag": "own"})
    found = tagged.join(chosen, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("tag") == F.col("own")), "left_semi")
    held = map_text(found, "text", [T.StructField("whole", long), T.StructField("fp", long), T.StructField("shingles", longs)], content, [])
    held = written(held.dropDuplicates(["whole"]).join(nodes.select(F.col("node").alias("whole"), "root"), "whole"))
    sides = held.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CELL_TEXTS, F.sum(F.size("shingles")) / CELL_SHINGLES)).cast("int").alias("h"))
    part = F.pmod(F.xxhash64("whole"), F.col("h")).cast("int").alias("part")
    dealt = held.join(sides, "root").select("root", part, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("other"), "fp", "shingles")
    dealt = dealt.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "shingles")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        a, b = alike_edges(cell["fp"].to_numpy(), cell["part"].to_numpy(), list(cell["shingles"]))
        return pd.DataFrame({"a": a, "b": b})

    # One column, so that rows which a join has dealt by root are dealt anew, a cell to a task.
    return dealt.groupBy(F.struct("root", "i", "j").alias("cell")).applyInPandas(compare, "a long, b long").where("a <> b")


def grouped(docs: DataFrame, text_col: str, size: int, alike: bool) -> DataFrame:
    """doc_id, tag, fp, root (one fp for each group) and component_id of each row."""
    prints = written(fingerprints(docs, text_col, size))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = near_pairs(distinct)
    nodes = connected(pairs.unionByName(alike_pairs(docs, text_col, size)) if alike else pairs)
    linked = nodes.withColumnRenamed("node", "fp").join(distinct, "fp").select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = distinct.join(linked.join(least, "root").select("fp", "root", "component_id"), "fp", "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("root"), F.least(F.coalesce("component_id", "first_id"), "first_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "tag", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text_col: str = "text", size: int = WORDS, alike: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of each row.

    A null or wordless text has fingerprint 0 and is linked like any other; equal
    fingerprints are linked; repeated rows are reported each. A row with a null id has the
    component of its group's smallest id, null if there is none. An empty table gives none.
    With `alike`, texts whose shingles have a Jaccard similarity of 0.8 at least are linked too.
    Very long texts are taken whole; columns of any other names don't matter.
    """
    return grouped(docs, text_col, size, alike).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", size: int = WORDS, alike: bool = False) -> DataFrame:
    """docs with one document of each group, that of the smallest id; rows without an id stay.

    Rows with one id and other texts are documents of their own, of which a hash of the text comes first in
    a group; of rows with one id and text one stays. Columns may have any names.
    """
    known = docs.where("doc_id is not null")
    found, key = grouped(known, text_col, size, alike), F.struct("doc_id", "tag")
    gone = found.join(found.groupBy("root").agg(F.min(key).alias("first")), "root").where(key != F.col("first")).select("doc_id", "tag").distinct()
    doc, tag = fresh(docs.columns, "doc", "tag")
    own = F.coalesce(tag_of(text_col), F.lit(-1))
    kept = docs.join(gone.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag)), (F.col("doc_id") == F.col(doc)) & (own == F.col(tag)), "left_anti")
    if not known.groupBy("doc_id", own).count().where("count > 1").limit(1).count():
        return kept
    single = kept.where("doc_id is not null").withColumn(tag, own).dropDuplicates(["doc_id", tag]).drop(tag)
    return single.unionByName(kept.where("doc_id is null"))


def brute_force(rows: list[tuple[int, str | None]], near: int = NEAR) -> list[tuple[int, str, int]]:
    """The same by comparing all pairs; the fingerprint bit by bit."""
    prints = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        grams = [" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))] if words else []
        hashes = [xxhash.xxh64(g.encode(), seed=SEED).intdigest() for g in grams]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)))
    group = {i: i for i in range(len(rows))}

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= near:
            group[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, f"{prints[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(rows)]
