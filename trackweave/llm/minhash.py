"""MinHash near-duplicates with tensored banding.

A text's set is its distinct word shingles. Of each set COLLECTIONS small collections of WIDTH
minimum hashes are taken, 72 hashes in all. Every pair of collections that two sets may agree on
is a table of its own: its key combines the two collections' values, so that 72 hashes serve 276
tables of six hashes each, for which plain banding needs 1,656. Only values that two sets share
take part in keys, so an unlike text emits none.

Texts of one key are candidates. Each is first compared with the key's leader, the set whose
values are the most common ones, since copies lie nearer to their origin than to each other.
Then keys whose texts are still in several components are brought together and all pairs across
components are compared, on full sets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import Scratch, connected, fresh, map_text, tag_of
from trackweave.llm.simhash import SEED, shingle_hashes

WORDS = 2
#: Sets are linked if their intersection is this share of their union, in hundredths.
ALIKE = 80
#: Two sets that are 0.8 alike agree on a collection with probability 0.8**3, and on two of 24 at least but for 9 in ten million.
COLLECTIONS, WIDTH = 24, 3
MASKS, FACTORS = np.random.default_rng(13).integers(0, 2**64 - 1, (2, COLLECTIONS * WIDTH, 1), np.uint64, endpoint=True) | np.uint64(1)
#: Texts and shingles of one side of a cell.
CELL_TEXTS, CELL_SHINGLES = 2_000, 400_000


def shingles(text: bytes) -> np.ndarray:
    """The set: distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def name_of(held: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return xxhash.xxh3_128_digest(held.tobytes(), SEED)


def collections(held: np.ndarray) -> list[int]:
    """A value for each collection of minimum hashes."""
    least = np.full(COLLECTIONS * WIDTH, np.iinfo(np.uint64).max)
    for a in range(0, len(held), 4_096):
        least = np.minimum(least, ((held[a : a + 4_096][None] ^ MASKS) * FACTORS).min(axis=1))
    return [int(np.uint64(xxhash.xxh64_intdigest(least[k * WIDTH : (k + 1) * WIDTH].tobytes(), k)).view(np.int64)) for k in range(COLLECTIONS)]


def sketched(docs: DataFrame, text_col: str) -> DataFrame:
    """doc_id, tag, whole (name of the set), n_shingles and values (none of an empty set) of each row."""

    def run(rows: list[bytes]) -> list:
        held = [shingles(t) for t in rows]
        return [[name_of(h) for h in held], np.array([len(h) for h in held], np.int64), [collections(h) if len(h) else [] for h in held]]

    fields = [T.StructField("whole", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("values", T.ArrayType(T.LongType()))]
    tagged = docs.select("doc_id", F.coalesce(tag_of(text_col), F.lit(-1)).alias("tag"), F.col(text_col).alias("text"))
    return map_text(tagged, "text", fields, run, ["doc_id", "tag"])


def alike(both: Column, a: Column, b: Column) -> Column:
    return both * 100 >= (a + b - both) * ALIKE


def table_keys(texts: DataFrame) -> DataFrame:
    """key, whole, n_shingles and score (how common its values are) of each text in each table where its key may have another text."""
    held = texts.select("whole", "n_shingles", F.posexplode("values").alias("i", "value"))
    shared = held.groupBy("i", "value").agg(F.count("*").alias("n")).where("n > 1")
    own = held.join(shared, ["i", "value"]).groupBy("whole", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v"), F.sum("n").alias("score")).where("size(v) > 1")
    paired = F.expr("flatten(transform(v, (x, p) -> transform(slice(v, p + 2, size(v)), y -> xxhash64(x.i, x.value, y.i, y.value))))")
    return own.select("whole", "n_shingles", "score", F.explode(paired).alias("key"))


def full_sets(docs: DataFrame, text_col: str, texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """whole and held (its shingles) of the chosen sets, from one text of each."""

    def run(rows: list[bytes]) -> list:
        held = [shingles(t) for t in rows]
        return [[name_of(h) for h in held], [h.view(np.int64) for h in held]]

    fields = [T.StructField("whole", T.BinaryType()), T.StructField("held", T.ArrayType(T.LongType()))]
    wanted = texts.join(chosen, "whole", "left_semi").select("origin.*").withColumnsRenamed({"doc_id": "doc", "tag": "own"})
    found = docs.select("doc_id", F.col(text_col).alias("text"), F.coalesce(tag_of(text_col), F.lit(-1)).alias("tag"))
    found = found.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("tag") == F.col("own")), "left_semi")
    return map_text(found, "text", fields, run, []).dropDuplicates(["whole"])


def across(labels: np.ndarray, stray: np.ndarray, held: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Pairs (of row numbers) that link all alike rows, each a stray and any other with another label.

    Counts of common shingles come from the lists of rows that hold each shingle; linked labels become one.
    """
    _, label = np.unique(labels, return_inverse=True)
    sizes = np.array([len(h) for h in held])
    flat, rows = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(flat, kind="stable")
    _, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    lists, starts = rows[order], np.concatenate([[0], np.cumsum(counts)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a, b = [], []
    for i in np.flatnonzero(stray).tolist():
        able = (label != label[i]) & (np.minimum(sizes, sizes[i]) * 100 >= np.maximum(sizes, sizes[i]) * ALIKE)
        if not able.any():
            continue
        own = code[ends[i] : ends[i + 1]]
        length = counts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(lists[at], minlength=len(held))
        for j in np.flatnonzero(able & (both * 100 >= (sizes + sizes[i] - both) * ALIKE)).tolist():
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return a, b


def rest_links(members: DataFrame, labels: DataFrame, texts: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links between candidates that the comparison with leaders left in different components; None if there are none.

    Candidates that hang together through such keys are a group. In a group all but the largest
    component are strays; a grid of cells meets each part of the strays with each part of the group.
    """
    now = members.select("key", "whole").join(labels, "whole", "left").withColumn("label", F.coalesce("root", "whole"))
    mixed = now.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("whole").alias("b")).where("least <> most").select("key", "b")
    links = scratch.written(now.join(mixed, "key").select(F.col("whole").alias("a"), "b", "label").distinct())
    if not links.limit(1).count():
        return None
    nodes = connected(links.select("a", "b").where("a <> b").distinct()).select(F.col("node").alias("whole"), F.col("root").alias("group"))
    placed = nodes.join(labels, "whole", "left").withColumn("label", F.coalesce("root", "whole")).join(texts, "whole")
    # Small rows without the sets, so that nothing large is dealt by group; written, so that a join may split a hot group.
    rows = scratch.written(placed.select("whole", "group", "label", "n_shingles"))
    main = rows.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    marked = scratch.written(rows.join(main, "group").withColumn("stray", F.col("label") != F.col("main")))
    size = lambda n, s: F.greatest(F.lit(1), F.ceil(F.greatest(n / CELL_TEXTS, s / CELL_SHINGLES))).cast("int")
    held = F.col("n_shingles")
    grid = marked.groupBy("group").agg(size(F.count("*"), F.sum(held)).alias("h"), size(F.count_if("stray"), F.sum(F.when(F.col("stray"), held).otherwise(0))).alias("v"))
    dealt = marked.join(grid, "group").join(sets, "whole")
    part = lambda n: F.pmod(F.xxhash64("whole"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["whole", "label", "stray", "held"]
    cells = dealt.where("stray").select("group", part("v").alias("i"), each("h").alias("j"), *columns).unionByName(dealt.select("group", each("v").alias("i"), part("h").alias("j"), *columns[:2], F.lit(False).alias("stray"), "held"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("stray", ascending=False, kind="stable").drop_duplicates("whole")  # a text on both sides is a stray
        whole = cell["whole"].to_numpy()
        a, b = across(cell["label"].to_numpy(), cell["stray"].to_numpy(), list(cell["held"])) if cell["stray"].any() else ([], [])
        return pd.DataFrame({"a": whole[a], "b": whole[b]})

    # One column, so that rows which a join has dealt by group are dealt anew, a cell to a task.
    return cells.groupBy(F.struct("group", "i", "j").alias("cell")).applyInPandas(compare, "a binary, b binary")


def grouped(docs: DataFrame, text_col: str) -> DataFrame:
    """doc_id, tag, n_shingles, root (one set for each component; null without words) and component_id of each row."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.written(sketched(docs, text_col), "zstd")
    origin = F.max(F.struct("doc_id", "tag")).alias("origin")
    texts = scratch.written(prints.where("n_shingles > 0").groupBy("whole", "n_shingles", "values").agg(F.min("doc_id").alias("first_id"), origin), "zstd")
    keyed = scratch.written(table_keys(texts), "zstd")
    leaders = keyed.groupBy("key").agg(F.max(F.struct("score", "whole", "n_shingles")).alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = scratch.written(keyed.join(leaders, "key").select("key", "whole", "n_shingles", "leader"), "zstd")
    n, m = F.col("n_shingles"), F.col("leader.n_shingles")
    pairs = members.where(F.col("whole") != F.col("leader.whole")).where(F.least(n, m) * 100 >= F.greatest(n, m) * ALIKE).select(F.col("whole").alias("a"), F.col("leader.whole").alias("b")).distinct()
    sets = scratch.written(full_sets(docs, text_col, texts, members.select("whole").distinct()))
    of = lambda c: sets.select(F.col("whole").alias(c), F.col("held").alias(f"held_{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    links = scratch.written(met.where(alike(F.size(F.array_intersect("held_a", "held_b")), F.size("held_a"), F.size("held_b"))).select("a", "b"))
    nodes = connected(links)
    more = rest_links(members, nodes.withColumnRenamed("node", "whole"), texts.select("whole", "n_shingles"), sets, scratch)
    if more is not None:
        nodes = connected(links.unionByName(more))
    linked = nodes.withColumnRenamed("node", "whole").join(texts.select("whole", "first_id"), "whole")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least"))
    named = texts.select("whole", "first_id").join(linked.join(least, "root").select("whole", "root", "least"), "whole", "left")
    named = named.select("whole", F.coalesce("root", "whole").alias("root"), F.coalesce("least", "first_id").alias("component_id"))
    alone = F.col("n_shingles") == 0
    worded = prints.where(~alone).join(named, "whole").select("doc_id", "tag", "n_shingles", "root", "component_id")
    wordless = prints.where(alone).select("doc_id", "tag", "n_shingles", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"))
    return worded.unionByName(wordless)


def near_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (the smallest id reachable) and kept (doc_id is component_id) of each row.

    Texts are linked where the intersection of their sets is 0.8 of the union at least. A text of
    one word has that word as its set; null, empty and wordless texts have an empty set and are
    linked with nothing. Rows with a null id have their group's smallest id, null if there is none,
    and aren't kept; repeated rows are reported each. Very long texts are taken whole. Columns of
    any other names don't matter. An empty table gives none.
    """
    return grouped(docs, text_col).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one document of each group, that of the smallest id; wordless texts and rows without an id stay.

    Of rows with one id and other texts in a group the one whose text hashes lowest stays, of
    repeated rows all that are like it. Columns may have any names.
    """
    found, key = grouped(docs.where("doc_id is not null"), text_col).where("root is not null"), F.struct("doc_id", "tag")
    gone = found.join(found.groupBy("root").agg(F.min(key).alias("first")), "root").where(key != F.col("first")).select("doc_id", "tag").distinct()
    doc, tag = fresh(docs.columns, "doc", "tag")
    own = F.coalesce(tag_of(text_col), F.lit(-1))
    return docs.join(gone.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag)), (F.col("doc_id") == F.col(doc)) & (own == F.col(tag)), "left_anti")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, bool]]:
    """The same by comparing all pairs of sets of shingles."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sets.append({tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if group[i] != group[j] and both and 100 * both >= ALIKE * (len(sets[i]) + len(sets[j]) - both):
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in set(group)}
    return [(d, len(s), least[g], d is not None and d == least[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)]
