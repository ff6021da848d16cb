"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of one partition's documents. Words that no benchmark phrase holds
can't lie in an occurrence, so a shard indexes only the runs of phrase words that are as
long as the shortest phrase. The index is a suffix array (prefix doubling), its
Burrows-Wheeler transform in a wavelet tree, and every eighth suffix position. All
phrases search backward at once through wavelet ranks; rows found walk to the next
sampled position, and the spans of words that they cover are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import batched, fresh, slices, texts, written

#: Phrases of about so many bytes of benchmark text are searched in one pass over the text: some 60 MB of arrays, whatever the benchmark's size.
PHRASE_BYTES = 8 << 20
SAMPLE = 8

#: A-Z to lower case; of ASCII only digits and letters belong to words, all bytes from 0x80 do.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Phrases:
    """Distinct windows of the items' words, by length, with the items that hold each, in flat arrays."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        """items: name (null: counted, but not named) and text."""
        self.ids: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(FOLDED).split()], np.int32)
            size = min(window, len(words))
            if size:
                own = np.lib.stride_tricks.sliding_window_view(words, size)
                held.setdefault(size, []).append((own, np.full(len(own), k, np.int32)))
        self.by_length = {size: self.distinct(*map(np.concatenate, zip(*own, strict=True))) for size, own in sorted(held.items())}

    @staticmethod
    def distinct(windows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows, where the owners of each begin, and the owners."""
        found, which = np.unique(windows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owners], axis=1), axis=0)
        return found, np.searchsorted(pairs[:, 0], np.arange(len(found) + 1)), pairs[:, 1]


class FMIndex:
    """Over symbols 0..top of one shard; symbol 0 parts the runs and occurs in no phrase. All are kept one higher, above an end mark."""

    def __init__(self, symbols: np.ndarray, top: int):
        symbols, top = np.append(symbols + 1, 0), top + 1
        n = len(symbols)
        rank = symbols.astype(np.int64)
        width, order = 1, np.argsort(rank, kind="stable")
        while True:  # the end mark occurs once, so all suffixes differ
            second = np.full(n, -1, np.int64)
            second[: max(0, n - width)] = rank[width:]
            key = rank * (n + top + 2) + second + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            width *= 2
        bwt = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        sampled = order % SAMPLE == 0
        self.sampled, self.sample_rank, self.samples = sampled, np.concatenate([[0], np.cumsum(sampled)]), order[sampled]
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.levels, self.planes, level = [], [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.planes.append(bit)
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.n = n

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row of the transform."""
        lo, hi = np.zeros_like(at), at
        for k, ones in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            one_lo, one_hi = ones[lo], ones[hi]
            lo = np.where(bit, self.zeros[k] + one_lo, lo - one_lo)
            hi = np.where(bit, self.zeros[k] + one_hi, hi - one_hi)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for k, ones in enumerate(self.levels):
            bit = self.planes[k][at]
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
        return symbol

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of the suffixes that begin with each phrase."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k] + 1
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, where = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            got = open_[done]
            where[got] = self.samples[self.sample_rank[at[got]]] + steps[got]
            open_ = open_[~done]
            c = self.access(at[open_])
            at[open_] = self.first[c] + self.rank(c, at[open_])
            steps[open_] += 1
        return where % self.n


def shard_hits(docs: list[bytes], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each text its number of words, merged spans of hit words and the items found."""
    n_words, spans, items = [], [[] for _ in docs], [set() for _ in docs]
    shortest, top = min(phrases.by_length, default=0), len(phrases.ids)
    runs, doc_of, word_of = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)]
    get = phrases.ids.get
    for d, text in enumerate(docs):
        words = text.translate(FOLDED).split()
        n_words.append(len(words))
        if not shortest or len(words) < shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = end - begin >= shortest
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            runs += [ids[a:b], np.zeros(1, np.int64)]
            doc_of += [np.full(b - a + 1, d)]
            word_of += [np.arange(a, b + 1)]
    if len(runs) == 1:
        return n_words, spans, items
    text, doc_at, word_at = np.concatenate(runs), np.concatenate(doc_of), np.concatenate(word_of)
    index, cover = FMIndex(text, top), np.zeros(len(text) + 1, np.int64)
    for size, (windows, begin, owners) in phrases.by_length.items():
        lo, hi = index.search(windows)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        counts = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        where, which = index.locate(rows), np.repeat(found, counts)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + size, -1)
        for d, w in set(zip(doc_at[where].tolist(), which.tolist(), strict=True)):
            items[d].update(phrases.names[k] for k in owners[begin[w] : begin[w + 1]].tolist())
    hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]])
    for a, b in zip(np.flatnonzero(np.diff(hit) == 1).tolist(), np.flatnonzero(np.diff(hit) == -1).tolist(), strict=True):
        spans[doc_at[a]].append((int(word_at[a]), int(word_at[b - 1]) + 1))
    return n_words, spans, items


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def marked(batches: Iterator[pa.RecordBatch], phrases: Phrases, text_col: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches with the number of words, and with what the phrases hit added to spans and items; names: of these three columns."""
    for batch in batches:
        for rows in slices(batch, text_col):
            n, spans, found = shard_hits(texts(rows, text_col), phrases)
            spans = [merged([*((s["start"], s["end"]) for s in old or ()), *new]) for old, new in zip(rows.column(names[1]).to_pylist(), spans, strict=True)]
            found = [sorted({*(old or ()), *new}, key=lambda x: (x is None, x or "")) for old, new in zip(rows.column(names[2]).to_pylist(), found, strict=True)]
            for name, values in zip(names, (n, [[{"start": a, "end": b} for a, b in x] for x in spans], found), strict=True):
                at = rows.schema.get_field_index(name)
                rows = rows.set_column(at, rows.schema.field(at), pa.array(values, type=rows.schema.field(at).type))
            yield rows


def cut_out(batches: Iterator[pa.RecordBatch], text_col: str, spans_col: str) -> Iterator[pa.RecordBatch]:
    """The batches with their hit words, and what stands between them, taken out of the texts."""

    def cut(text: bytes, spans: list[dict]) -> bytes:
        flat = np.frombuffer(b" " + text.translate(FOLDED) + b" ", np.uint8) != 32
        edge = np.flatnonzero(np.diff(flat.view(np.int8)))
        begin, end, out, at = edge[::2], edge[1::2], [], 0
        for s in spans:
            out.append(text[at : begin[s["start"]]])
            at = int(end[s["end"] - 1])
        return b"".join([*out, text[at:]])

    for rows in batches:
        spans = rows.column(spans_col).to_pylist()
        if any(spans):
            at = rows.schema.get_field_index(text_col)
            kept = [None if t is None else cut(t.encode(), s).decode() if s else t for t, s in zip(rows.column(text_col).to_pylist(), spans, strict=True)]
            rows = rows.set_column(at, rows.schema.field(at), pa.array(kept, rows.schema.field(at).type))
        yield rows


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, cut: bool = False, names: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all, if None) with n_words, hit_spans (merged word ranges) and items (sorted ids found, a null id last).

    A phrase is `window` consecutive words of an item, or a shorter item whole. Null or
    wordless texts and items have no words and no hits; repeated rows are reported each;
    items with a null id are one item, counted but not named, an empty id is a name; of an empty table nothing is found.
    names: of the three new columns; columns of docs named like them are replaced. cut: the texts come without what was hit.

    Items are searched in passes over the text, so that a worker holds the phrases of PHRASE_BYTES
    of them at a time; what a pass found is written, and its phrases are freed.
    """
    names = names or [f.name for f in FOUND]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    bytes_ = items.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text))), F.lit(0))).first()[0]
    passes = max(1, -(-int(bytes_) // PHRASE_BYTES))
    out = batched(docs).select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col]))).withColumns({n: F.lit(None).cast(f.dataType) for n, f in zip(names, FOUND, strict=True)})
    schema, sent = out.schema, None
    for k in range(passes):
        if sent is not None:
            out = written(out)
            sent.unpersist()
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(passes)) == k)
        rows = [(None if r[0] is None else str(r[0]), (r[1] or "").encode()) for r in part.select(item_id, item_text).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(rows, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=cut and k == passes - 1) -> Iterator[pa.RecordBatch]:
            batches = marked(batches, sent.value, text_col, names)
            return cut_out(batches, text_col, names[1]) if last else batches

        out = out.mapInArrow(run, schema)
    return out.select(*(F.col(f"`{c}`") for c in [*keep, *names]))


def digest(found: DataFrame) -> DataFrame:
    """The report of one row per document, from find_overlaps."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_overlaps(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without the hit words (and what stands between them); a document left without words goes.

    n_chars follows the text, if docs has it. Documents without hits stay as they are, null and
    wordless texts and repeated rows too. Columns may have any names. Empty tables: docs as they are.
    """
    names = fresh(docs.columns, "n_words", "hit_spans", "items")
    words, spans, _ = (F.col(n) for n in names)
    found = find_overlaps(docs, items, window, cut=True, names=names)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    cleaned = found.where((hit == 0) | (hit < words))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int | str | None, str | None]], window: int = 10) -> list[tuple]:
    """The same report by comparing every window with every place."""
    owners: dict[tuple[bytes, ...], set[str | None]] = {}
    for name, text in items:
        words = (text or "").encode().translate(FOLDED).split()
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners.setdefault(tuple(words[i : i + size]), set()).add(None if name is None else str(name))
    out = []
    for doc, text in docs:
        words, hit, found = (text or "").encode().translate(FOLDED).split(), set(), set()
        for size in {len(p) for p in owners}:
            for i in range(len(words) - size + 1):
                if names := owners.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)))
    return out
