"""Packing along a Hilbert curve.

A document's byte trigrams are hashed into a vector, which fixed random directions
project to a few dimensions; its place on the Hilbert curve through them is its key.
Key quantiles over all documents cut the curve into ranges of equal size, a hash of the id
parts equal keys. Each range is one partition: sorted along the curve, its documents'
token ids run on without gaps and are cut where a sequence is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import batched, map_text, packed, slices, texts, written

LENGTH = 2048
DIMENSIONS, BITS, FEATURES = 4, 10, 128
TIE_BITS = 22
#: Bytes of text in one range of the curve.
RANGE_BYTES = 16 << 20
#: So many ranges are cut by quantiles at once, each into so many at most by quantiles of its own: a range grows beyond RANGE_BYTES past 4 TB of text only.
QUANTILES, FINER = 2048, 128
#: Words that a worker's store may hold before it is emptied.
MEMORY = 400_000
#: Bytes of text that are split into words at a time.
SLICE = 4 << 20
LETTERS = "^[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{17F}]+$"
MARKS = ".,;:!?*$%&#"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers under 2**bits."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrorings, coarse to fine
        q, below = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 > 0, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key * 2 + (((x[i] ^ turn) >> level) & 1)
    return key


def curve_keys(rows: list[bytes]) -> np.ndarray:
    """The Hilbert key of each text's projected vector."""
    data, starts = packed(rows)
    code = (data[:-2] * np.uint8(31) + data[1:-1] * np.uint8(57) + data[2:] * np.uint8(101)) & np.uint8(FEATURES - 1)
    counts = np.zeros((len(rows), FEATURES))
    for k, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
        if b - a > 3:
            counts[k] = np.bincount(code[a : b - 3], minlength=FEATURES)
    vector = np.sqrt(counts)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
    vector -= 1 / np.sqrt(FEATURES)
    plane = np.random.default_rng(20240501).normal(size=(FEATURES, DIMENSIONS))
    unit = (1 + np.tanh(2 * vector @ plane)) / 2
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[begin : begin + length] one after the other, and where each ends (0 first)."""
    end = np.concatenate([[0], np.cumsum(length)])
    return flat[np.repeat(begin - end[:-1], length) + np.arange(end[-1])], end


class Encoder:
    """Ids of a whole text, looked up by stretches without white space.

    Pre-tokens of this tokenizer never hold white space, so a text's ids are those of its
    stretches in turn. A stretch of letters below U+0180 (normalisation leaves them in place,
    and case folds letter by letter) and marks after them is two words of the store; any other is one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same model for words that need no normalising and are parted by spaces
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """An empty store: words, their ids one after the other, and where those of each begin."""
        self.words, self.ids, self.cuts = pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def __call__(self, rows: list[str]) -> list[bytes]:
        """Little-endian unsigned ids of the vocabulary's kind."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(rows, pa.large_string()), "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        flat, size = self.stretches(coded.dictionary)
        at = coded.indices.to_numpy()
        out, end = gathered(flat, (np.cumsum(size) - size)[at], size[at])
        cut = end[lists.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]

    def stretches(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches, one after the other, and how many each has."""
        core = pc.utf8_rtrim(found, MARKS)
        plain = pc.match_substring_regex(core, LETTERS)
        marked = np.flatnonzero(pc.and_(plain, pc.not_equal(core, found)).to_numpy(zero_copy_only=False))
        head = pc.if_else(plain, pc.utf8_lower(core), found)
        tail = pc.replace_substring_regex(found.take(pa.array(marked)), LETTERS.rstrip("$"), "").dictionary_encode()
        both = pa.concat_arrays([head, tail.dictionary]).dictionary_encode()
        at = self.places(both.dictionary)[both.indices.to_numpy()]
        part = np.full((len(found), 2), -1)
        part[:, 0] = at[: len(found)]
        part[marked, 1] = at[len(found) :][tail.indices.to_numpy()]
        length = np.where(part < 0, 0, self.cuts[part + 1] - self.cuts[part])
        ids, _ = gathered(self.ids, self.cuts[np.maximum(part, 0)].ravel(), length.ravel())
        return ids, length.sum(axis=1)

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Where the store has each of these distinct words; it learns new ones, and forgets all first if it grew too large."""
        if len(self.words) > MEMORY:
            self.forget()
        at = pc.fill_null(pc.index_in(wanted, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        new = wanted.take(pa.array(fresh))
        plain = pc.match_substring_regex(new, LETTERS).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        words, ids, sizes = new.take(pa.array(order)), [self.ids], []
        n = int(plain.sum())
        some = [" ".join(words.slice(a, min(2_000, n - a)).to_pylist()) for a in range(0, n, 2_000)]
        for e in self.plain.encode_batch_fast(some, add_special_tokens=False):  # many words in one text, told apart by the pieces that end a word
            ids.append(np.array(e.ids, self.kind))
            sizes.append(np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1))
        for a in range(n, len(words), 2_000):
            made = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(a, 2_000).to_pylist(), add_special_tokens=False)]
            ids += [np.array(x, self.kind) for x in made]
            sizes.append(np.array([len(x) for x in made]))
        at[fresh[order]] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate(ids)
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        return at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


@lru_cache(maxsize=8)
def id_kind(path: str) -> str:
    """The kind of number that holds the tokenizer's ids. The driver needs no more of it, and keeps no tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


#: Ids of pieces that a worker holds before it hands them on, however long the texts of a batch are.
HELD_IDS = 1 << 20
PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def bounds_of(places: DataFrame, ranges: int) -> np.ndarray:
    """Ascending bounds that cut column place into about so many equal ranges: quantiles and, if there are more than QUANTILES, quantiles within those."""

    def quantiles(n: int):
        return F.percentile_approx("place", [i / n for i in range(1, n)], 10 * QUANTILES)

    if ranges < 2:
        return np.zeros(0, np.int64)
    if ranges <= QUANTILES:
        return np.unique(np.array(places.agg(quantiles(ranges)).first()[0] or [], np.int64))
    places = written(places)
    first = np.unique(np.array(places.agg(quantiles(QUANTILES)).first()[0] or [], np.int64))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(first, batch.column(0).to_numpy()), pa.int32()), batch.column(0)], names=["range", "place"])

    inner = min(FINER, -(-ranges // QUANTILES))
    finer = places.mapInArrow(within, "range int, place long").groupBy("range").agg(quantiles(inner).alias("own")).collect()
    return np.unique(np.concatenate([first, *(np.array(r["own"], np.int64) for r in finer)]))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of sequences of at most `length` ids.

    Null and empty texts are the end id alone; repeated rows and rows without an id are packed
    each; an empty table gives no pieces. Only the last sequence of a range can be short. Other
    columns are not read. Very long texts are cut over many sequences and handed on in bounded parts.
    """
    from trackweave.llm.common import to_arrow

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    keys = map_text(docs.select("doc_id", "text"), "text", [T.StructField("curve", T.LongType())], lambda rows: [curve_keys(rows)], ["doc_id"])
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bounds = bounds_of(keys.select((F.shiftleft("curve", TIE_BITS) + salt).alias("place")), -(-size // RANGE_BYTES))
    doc_type, kind = to_arrow(docs.schema["doc_id"].dataType), np.dtype(id_kind(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = encoder(tokenizer)
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                own = texts(rows, "text")
                at = curve_keys(own) * (1 << TIE_BITS) + rows.column("salt").to_numpy()
                ids = encode_([t.decode() for t in own])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(doc_type), pa.array(np.searchsorted(bounds, at), pa.int32()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "range_id", "place", "ids"])
        encode_.forget()  # a worker that waits for other stages' tasks holds nothing

    coded = T.StructType([docs.schema["doc_id"], T.StructField("range_id", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("ids", T.BinaryType())])
    dealt = batched(docs).select("doc_id", "text", salt.alias("salt")).mapInArrow(encode, coded).repartitionById(len(bounds) + 1, "range_id").sortWithinPartitions("range_id", "place", "doc_id", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_id, at = None, 0

        def made(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            rows, *columns, parts = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in columns), pa.array(parts, pa.binary())], names=["doc_id", *PIECES.names, "ids"])

        for batch in batches:
            out: list[tuple] = []
            held = 0
            for k, (r, coded_) in enumerate(zip(batch.column("range_id").to_pylist(), batch.column("ids"), strict=True)):
                if r != range_id:
                    range_id, at = r, 0
                ids = np.append(np.frombuffer(coded_.as_buffer(), kind).astype("<u4"), np.uint32(end_id)).astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - at % length)
                    part = ids[start : start + n].tobytes()
                    out.append((k, start, n, zlib.crc32(part), len(ids), (r << 40) + at // length, at % length, part))
                    start, at, held = start + n, at + n, held + n
                    if held >= HELD_IDS:
                        yield made(batch, out)
                        out, held = [], 0
            if out:
                yield made(batch, out)

    return dealt.mapInArrow(cut, T.StructType([docs.schema["doc_id"], *PIECES, T.StructField("ids", T.BinaryType())]))
