"""Prefix tries of conversations by ternary search trees over range shards.

Turns are dictionary encoded: a distinct (role, text) is a number. A conversation is a sequence
of numbers, cut into pieces of PIECE turns; a piece hangs on its anchor, a hash of all that goes
before it, so that no row holds a long conversation. Pieces are sorted by ranges, and a bounded
slice of the order is a shard: its distinct sequences are inserted into a ternary search tree,
medians first, so that the tree is balanced, and a traversal with a stack of its own accumulates
members, leaves and savings. What a shard's first and last sequence and unfinished pieces pass
through may go on elsewhere: such boundary nodes are merged by their hash, and subtree sums among
them come from pointer doubling, in as many rounds as the depth has bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import Scratch, batched

#: Turns in a piece; turn numbers (and sequences) in a shard.
PIECE, SHARD = 64, 200_000
#: A conversation begins with turns of the first of its group of so many; how many, from 0, below this.
GROUP, HEADS = 5, 9
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
PARTIAL = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends binary, ends_sha256 string"


def placed(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 0, by turn), turn_id and size (UTF-8 bytes of the text) of each turn.

    Turns are sorted by ranges and numbered within runs, so that a conversation may span partitions;
    those that do are two for each partition at most, and their offsets are broadcast.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("salt")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "salt"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0  # of the run that the batch before ended with
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            at = np.arange(len(conv)) - np.repeat(starts, np.diff([*starts, len(conv)]))
            if conv[0] == last:
                at[conv == last] += before
            last, before = conv[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "conv_id", "digest", "size")), pa.array(at)], names=["part", "conv_id", "digest", "size", "pos"])

    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "digest", "size")
    runs = scratch.written(batched(spread).mapInArrow(number, "part int, conv_id long, digest binary, size long, pos long"))
    ends = runs.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    cut = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    parts = runs.join(F.broadcast(cut), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = parts.select("conv_id", F.col("part").alias("of"), "n").join(parts.select("conv_id", "part"), "conv_id").where("of < part").groupBy("conv_id", "part").agg(F.sum("n").alias("offset"))
    dictionary = scratch.written(runs.select("digest").distinct().withColumn("turn_id", F.monotonically_increasing_id()))
    whole = runs.join(F.broadcast(earlier), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "size")
    return scratch.written(whole.join(dictionary, "digest").select("conv_id", "pos", "turn_id", "size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, turn_id, size) of the rebuilt conversations, and all their ids.

    Conversation c gets the first h turns of conversation c - c % 5 and then its own after the first h; h = crc32(c) % 9.
    """
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    heads = turns.where(F.col("pos") < HEADS - 1).where(F.col("conv_id") % GROUP == 0).withColumnRenamed("conv_id", "base")
    convs = own.where("pos = 0").select("conv_id", "base", "h")
    first = convs.where("h > 0").join(heads, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_id", "size")
    counts = heads.groupBy("base").agg(F.count("*").alias("heads"))
    rest = own.where("pos >= h").join(counts, "base", "left")
    rest = rest.select("conv_id", (F.least("h", F.coalesce("heads", F.lit(0))) + F.col("pos") - F.col("h") + 1).alias("depth"), "turn_id", "size")
    return first.unionByName(rest), convs.select("conv_id")


def below(anchor: bytes, ids: np.ndarray) -> bytes:
    """The key of the node that the ids lead to from an anchor."""
    return hashlib.sha256(anchor + ids.astype("<i8").tobytes()).digest()[:16] if len(ids) else anchor


def pieces(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, piece (its number), anchor, ids, sizes and last (whether the conversation ends there); one without turns for a turnless conversation."""
    at = ((F.col("depth") - 1) / PIECE).cast("long")
    cut = turns.groupBy("conv_id", at.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("depth", "turn_id", "size"))).alias("t"))
    cut = scratch.written(cut.select("conv_id", "piece", F.col("t.turn_id").alias("ids"), F.col("t.size").alias("sizes")))
    short = (F.col("piece") == 0) & (F.size("ids") < PIECE)
    schema = T.StructType([*cut.schema.fields, T.StructField("anchor", T.BinaryType()), T.StructField("last", T.BooleanType())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # a piece is passed on when the next row tells whether it is the last
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                same = held is not None and held["conv_id"] == row["conv_id"]
                row["anchor"] = below(held["anchor"], np.array(held["ids"], np.int64)) if same else ROOT
                if held is not None:
                    out.append(held | {"last": not same})
                held = row
            yield pa.RecordBatch.from_pylist(out, schema=target)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"last": True}], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    chained = batched(cut.where(~short).repartition("conv_id").sortWithinPartitions("conv_id", "piece")).mapInArrow(chain, schema)
    start, none = F.lit(ROOT).alias("anchor"), F.array().cast("array<long>")
    whole = cut.where(short).select("*", start, F.lit(True).alias("last"))
    turnless = convs.join(cut.where("piece = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("piece"), none.alias("ids"), none.alias("sizes"), start, F.lit(True).alias("last"))
    return scratch.written(whole.unionByName(chained).unionByName(turnless))


class TernaryTree:
    """Sequences of numbers; node 0 stands above the first symbols."""

    def __init__(self) -> None:
        self.symbol, self.low, self.equal, self.high = [-1], [0], [0], [0]

    def insert(self, sequence: list[int]) -> int:
        """The node of the last symbol, made with those before it where they are missing."""
        symbol, low, equal, high = self.symbol, self.low, self.equal, self.high
        at = 0
        for s in sequence:
            branch, node = equal, at
            while (below := branch[node]) and symbol[below] != s:
                branch, node = (low if s < symbol[below] else high), below
            if not below:
                below = branch[node] = len(symbol)
                symbol.append(s)
                low.append(0)
                equal.append(0)
                high.append(0)
            at = below
        return at

    def traversed(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes, each before what is below it, and by node its parent (one symbol shorter) and its depth."""
        order, up, depth = [], [0] * len(self.symbol), [0] * len(self.symbol)
        stack = [(self.equal[0], 0, 0)]
        while stack:
            node, parent, d = stack.pop()
            if node:
                order.append(node)
                up[node], depth[node] = parent, d
                stack += (self.low[node], parent, d), (self.high[node], parent, d), (self.equal[node], node, d + 1)
        return order, up, depth


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle before the halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += (a, middle), (middle + 1, b)


def shard_nodes(rows: list[tuple]) -> list[tuple]:
    """Rows of PARTIAL for a sorted slice of (anchor, ids, conv_id, piece, sizes, last).

    A node inside has its results, and its parent's key where the parent is a boundary node. A
    boundary node has what the slice adds to it: members, inner children and their sums, and the
    ids that end there.
    """
    anchors = {a: k for k, a in enumerate(dict.fromkeys(r[0] for r in rows))}
    firsts = [i for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0] or r[1] != rows[i - 1][1]]
    tree, ends = TernaryTree(), {}
    for k in medians(len(firsts)):
        first = firsts[k]
        ends[tree.insert([anchors[rows[first][0]], *rows[first][1]])] = rows[first : firsts[k + 1] if k + 1 < len(firsts) else len(rows)]
    order, up, depth = tree.traversed()
    size = len(tree.symbol)
    through: list[tuple] = [()] * size  # a sequence that passes
    members, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    boundary = [False] * size
    extremes = {id(rows[firsts[0]]), id(rows[firsts[-1]])}
    for node, own in ends.items():
        if id(own[0]) in extremes or not all(r[5] for r in own):
            while node and not boundary[node]:
                boundary[node], node = True, up[node]
    out = []
    for node in reversed(order):
        own = ends.get(node, ())
        if own:
            through[node] = own[0]
            members[node] += len(own)
            least[node] = own[0][2] if least[node] is None else min(least[node], own[0][2])
        row, d, above = through[node], depth[node], up[node]
        bytes_ = row[4][d - 1] if d else 0
        boundary[node] = boundary[node] or d == 0
        if not boundary[node]:
            leaves[node] += children[node] == 0
            saved[node] += (members[node] - 1) * bytes_
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
        through[above], members[above] = row, members[above] + members[node]
        least[above] = least[node] if least[above] is None else min(least[above], least[node])
    keys: dict[int, bytes] = {}
    for node in order:
        row, d, above = through[node], depth[node], up[node]
        at, ended = row[3] * PIECE + d, ",".join(str(r[2]) for r in ends.get(node, ()) if r[5]).encode()
        if boundary[node]:
            keys[node] = below(row[0], np.array(row[1][:d], np.int64))
            counted = d > 0 or row[3] == 0  # an anchor's members are counted in the piece before
            out.append((keys[node], keys[above] if d else None, least[node] if counted else None, at, None, members[node] if counted else 0, children[node], leaves[node], saved[node], row[4][d - 1] if d else 0, ended or None, None))
        else:
            inner = not boundary[above]
            out.append((None, None if inner else keys[above], least[node], at, least[above] if inner else None, members[node], children[node], leaves[node], saved[node], None, None, hashlib.sha256(ended).hexdigest()))
    return out


def sharded(held: DataFrame) -> DataFrame:
    """Rows of PARTIAL of all pieces, sorted by ranges and cut into shards."""
    columns = ["anchor", "ids", "conv_id", "piece", "sizes", "last"]
    order = columns[:3]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(PARTIAL)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0

        def made() -> Iterator[pa.RecordBatch]:
            found = shard_nodes(rows)
            for a in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[a : a + 10_000], strict=True), target, strict=True)], schema=target)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                rows.append(row)
                weight += 1 + len(row[1])
                if weight >= SHARD:
                    yield from made()
                    rows, weight = [], 0
        if rows:
            yield from made()

    return batched(held.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)).mapInArrow(run, schema)


def ends_hashed(parts: DataFrame) -> DataFrame:
    """key and the hash of all its lists of ids (key, conv_id the first of each), one after another in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "first").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """key and the sums over all nodes (key, parent) of its subtree, itself included.

    After k rounds a node has the sums of what lies less than 2**k below it and its 2**k-th ancestor.
    """
    state, before = scratch.written(nodes.select("key", F.when(F.col("key") != F.lit(ROOT), F.col("parent")).alias("above"), *sums)), None
    while state.where("above is not null").limit(1).count():
        given = state.where("above is not null").groupBy(F.col("above").alias("key")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
        higher = state.where("above is not null").select(F.col("key").alias("above"), F.col("above").alias("higher"))
        # What hangs on the root or on a node without a further ancestor is done; only the rest asks.
        moved = state.join(higher, "above", "left").join(given, "key", "left")
        round_ = Scratch(nodes.sparkSession)
        state = round_.written(moved.select("key", F.col("higher").alias("above"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)))
        if before:
            before.dropped()
        before = round_
    return state.drop("above")


def trie_nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the prefix trie of conversations given as turns (conv_id, depth from 1, turn_id, size) and all ids (conv_id).

    For each node: conv_id (smallest member), depth, parent_conv_id (null of the root), n_convs,
    n_children, n_leaves, saved_tokens (summed over the subtree: (members - 1) times the bytes of
    a node's last text) and ends_sha256 (of the ids that end there, ascending, comma-joined).
    """
    scratch = scratch or Scratch(turns.sparkSession)
    made = scratch.written(sharded(pieces(turns, convs, scratch)), "zstd")
    part = made.where("key is not null")
    merged = part.groupBy("key").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("size").alias("size"))
    merged = scratch.written(merged)
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    own = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = own.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
    own = scratch.written(own)
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"], scratch)
    ended = ends_hashed(part.where("ends is not null").select("key", F.col("conv_id").alias("first"), "ends"))
    parents = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    boundary = own.select("key", "parent", "conv_id", "depth", "n_convs", "n_children").join(sums, "key").join(ended, "key", "left").join(parents, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    inner = made.where("key is null and parent is null")
    hanging = made.where("key is null and parent is not null").drop("parent_conv_id").join(parents, "parent")
    return boundary.select(*RESULT).unionByName(inner.select(*RESULT)).unionByName(hanging.select(*RESULT))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """trie_nodes of the rebuilt conversations of a table with conv_id, turn, role and text.

    Rows without a conv_id take no part. Null turns come first; rows of one turn are ordered by the
    SHA-256 of role and text, repeated rows count each. Null roles and texts are empty. Texts may be
    very long, and conversations too: no row holds more than 64 turns. Columns of other names don't
    matter. An empty table gives no nodes.
    """
    scratch = Scratch(conversations.sparkSession)
    turns, convs = rebuilt(placed(conversations, scratch))
    return trie_nodes(turns, convs, scratch)


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same from all prefixes of all rebuilt conversations; rows are (conv_id, turn, role, text)."""
    import zlib

    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            r, t = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest(), r, t))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % HEADS
        base = sorted(own.get(conv - conv % GROUP if conv >= 0 else conv + -conv % GROUP, []))
        whole[conv] = [x[3:] for x in base[:h] + sorted(turns)[h:]]
    members: dict[tuple, list[int]] = {}
    for conv in sorted(whole):
        for d in range(len(whole[conv]) + 1):
            members.setdefault(tuple(whole[conv][:d]), []).append(conv)
    children: dict[tuple, list] = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(str(c) for c in m if len(whole[c]) == len(p)) for p, m in members.items()}
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()]
