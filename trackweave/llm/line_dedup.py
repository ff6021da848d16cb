"""Line dedup through deletion neighbourhoods.

Lines are compared as words (A-Z in lower case). Two lines are near if they are equal, or
if one insertion, deletion or replacement of a word turns one into the other and the longer
has five words at least, which is a similarity of 0.8 or more. A line goes if an
earlier one (by doc_id, tag of the text, line number) is near it.

Every line that can have a partner emits all its variants with one word left out, as
hashed keys, and its own key. Equal keys join: two lines that agree with the word at the
same place left out differ by a replacement; a line that equals another's variant differs by an
insertion. Only the earliest line of a key is carried on, so no key makes pairs. The
earliest partner found is then verified on the words. Lines that share neither their front
nor their back half with another can't have a partner and emit nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import Scratch, batched, fresh, slices, tag_of, texts

#: The longer line of a near pair has so many words.
LEAST = 5
#: Bits of the filter for lines to be read again, and the step between a document's lines in it. Beyond some 10**8 such lines it lets most others through too: more lines are then shuffled, none is lost.
BITMAP_BITS, STEP = 1 << 27, 40_503_467
#: Rows of variants in one Arrow batch.
VARIANTS = 50_000
#: What tells lines apart.
ROW = ["doc_id", "tag", "line_no"]


def least_size(n: int) -> int:
    """Lengths are taken together: n itself up to 8 words, then four steps to each doubling."""
    return n - n % (1 << max(0, n.bit_length() - 3))


def halves(words: list[bytes]) -> list[int]:
    """Keys that two lines share if one edit parts them: one half, for either length that the longer line can have."""
    n, out = len(words), []
    for size in {least_size(m) for m in (n, n + 1) if m >= LEAST}:
        a = (size - 1) // 2
        out += [xxhash.xxh64_intdigest(b" ".join(words[:a]), 2 * size), xxhash.xxh64_intdigest(b" ".join(words[n - a :]), 2 * size + 1)]
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """Lines that hold words: doc_id, tag, line_no, own (how many the text has), a 128-bit hash of the words and the half keys."""
    doc = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                owner, number, digests, keys, own = [], [], [], [], []
                for k, text in enumerate(texts(rows, "text")):
                    before = len(owner)
                    for no, line in enumerate(text.lower().split(b"\n")):
                        if words := line.split():
                            owner.append(k)
                            number.append(no)
                            digests.append(xxhash.xxh128_digest(b" ".join(words)))
                            keys.append(halves(words))
                    own += [len(owner) - before] * (len(owner) - before)
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.array([x for each in keys for x in each], np.uint64).view(np.int64)
                at = pa.array(owner, pa.int64())
                arrays = [rows.column("doc_id").take(at), rows.column("tag").take(at), pa.array(number, pa.int32()), pa.array(own, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(ends, pa.array(flat))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*ROW, "own", "h1", "h2", "halves"])

    kept = docs.where("doc_id is not null and text is not null").select("doc_id", "text", tag_of("text").alias("tag"))
    return batched(kept).mapInArrow(run, f"doc_id {doc}, tag long, line_no int, own int, h1 long, h2 long, halves array<long>")


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=64)
def ladders(n: int) -> list[tuple[np.ndarray, np.uint64]]:
    """For each lane the powers of its base and the inverse of the base, modulo 2**64."""
    return [(powers(b, n), np.uint64(pow(b, -1, 1 << 64))) for b in BASES]


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hash lanes of the line itself (first) and of the line without each word in turn."""
    n, lanes = len(words), []
    for seed, (rise, inverse) in enumerate(ladders(1 << (len(words) + 1).bit_length())):
        own = np.array([xxhash.xxh64_intdigest(w, seed + 1) for w in words], np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(own * rise[:n])])
        lanes.append(np.concatenate([[sums[n]], sums[:-1] + (sums[n] - sums[1:]) * inverse]).view(np.int64))
    return lanes[0], lanes[1]


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one edit of a word or none turns a into b, and the longer is long enough for it."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < LEAST:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def bitmap_of(values: DataFrame) -> np.ndarray:
    """The numbers of the one column of values, modulo BITMAP_BITS, as set bits: 16 MB whatever the input."""
    name, size = values.columns[0], 1 << 15  # the bitmap functions count values from 1 in buckets of so many bits
    bit = values.select((F.pmod(F.col(name), F.lit(BITMAP_BITS)) + 1).alias("bit"))
    pieces = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in pieces.toLocalIterator():
        at = (row["bucket"] - 1) * size // 8
        bitmap[at : at + size // 8] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each number is set."""
    place = values % BITMAP_BITS
    return ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def read_again(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h1, h2 and line of the wanted lines (doc_id, tag, line_no, id, h1, h2), found by a bitmap of fixed size, so that only lines are shuffled and not texts."""
    doc = docs.schema["doc_id"].dataType.simpleString()
    origin = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(BITMAP_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select((origin + F.col("line_no").cast("long") * STEP).alias("place"))))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", tag_of("text").alias("tag")).withColumn("origin", origin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, number, found = [], [], []
                for k, (text, origin) in enumerate(zip(texts(part, "text"), part.column("origin").to_pylist(), strict=True)):
                    hit = np.flatnonzero(in_bitmap(sent.value, origin + np.arange(text.count(b"\n") + 1, dtype=np.int64) * STEP))
                    if len(hit):
                        lines = text.split(b"\n")
                        owner += [k] * len(hit)
                        number += hit.tolist()
                        found += [lines[no] for no in hit.tolist()]
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("tag").take(at), pa.array(number, pa.int32()), pa.array(found, pa.binary())], names=[*ROW, "line"])

    lines = batched(rows).mapInArrow(run, f"doc_id {doc}, tag long, line_no int, line binary")
    return lines.join(wanted, ROW).groupBy("id").agg(*(F.any_value(c).alias(c) for c in ("h1", "h2", "line")))  # repeated rows give a line again


def variant_keys(lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """id, v1, v2 and place of each variant of the lines (id, line): place -1 for the line itself, else that of the word left out.

    wanted: the v1 that are asked for; of the others most are left out here already, by a bitmap of fixed size, and needn't be shuffled.
    """
    sent = None if wanted is None else lines.sparkSession.sparkContext.broadcast(bitmap_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "line", 1 << 17):
                lanes, places, owner = ([], []), [], []
                for k, line in enumerate(texts(rows, "line")):
                    words = line.lower().split()
                    made = variants(words)
                    upto = len(made[0]) if len(words) >= LEAST else 1
                    for lane, m in zip(lanes, made, strict=True):
                        lane.append(m[:upto])
                    places.append(np.arange(-1, upto - 1, dtype=np.int32))
                    owner.append(np.full(upto, k))
                out = pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(np.concatenate(owner))), *(pa.array(np.concatenate(x)) for x in (*lanes, places))], names=["id", "v1", "v2", "place"])
                if sent is not None:
                    out = out.filter(pa.array(in_bitmap(sent.value, out.column("v1").to_numpy())))
                for a in range(0, out.num_rows, VARIANTS):
                    yield out.slice(a, VARIANTS)

    return batched(lines).select("id", "line").mapInArrow(run, "id long, v1 long, v2 long, place int")


def removable(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that go (doc_id, tag, line_no), and own, the number of lines with words, of each text (doc_id, tag) that has any. See near_lines for the cases."""
    scratch = Scratch(docs.sparkSession)
    lines = Scratch(docs.sparkSession).written(line_table(docs))
    row = F.struct(*ROW)
    firsts = scratch.written(lines.groupBy("h1", "h2").agg(F.min(row).alias("first"), (F.count("*") > 1).alias("many")))

    # Lines that share a half with another. Of 128 bits 64 will do here, as nothing is lost by more lines.
    keyed = lines.select("h1", F.explode("halves").alias("half"))
    shared = scratch.written(keyed.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half"))
    possible = scratch.written(keyed.join(shared, "half", "left_semi").select("h1").distinct())
    wanted = firsts.join(possible, "h1", "left_semi").select("first.*", "h1", "h2")
    wanted = scratch.written(wanted.orderBy(*ROW).withColumn("id", F.monotonically_increasing_id()))  # ids in the order of lines
    read = scratch.written(read_again(docs, wanted), "zstd")

    shared = scratch.written(variant_keys(read).groupBy("v1").count().where("count > 1").select("v1"))
    keys = scratch.written(variant_keys(read, shared).join(shared, "v1"))
    at_place = scratch.written(keys.groupBy("v1", "v2", "place").agg(F.min("id").alias("same")))
    whole, cut = (F.min(F.when(on, F.col("same"))) for on in (F.col("place") < 0, F.col("place") >= 0))
    of_key = at_place.join(at_place.groupBy("v1", "v2").agg(whole.alias("whole"), cut.alias("cut")), ["v1", "v2"])
    partner = F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("same", "whole"))
    joined = keys.join(scratch.written(of_key), ["v1", "v2", "place"]).withColumn("partner", partner).where("partner < id")
    found = joined.groupBy("id").agg(F.min("partner").alias("partner"))
    # The words of both, to verify the distance.
    pairs = found.join(read.select("id", "h1", "h2", F.col("line").alias("a")), "id").join(read.select(F.col("id").alias("partner"), F.col("line").alias("b")), "partner").select("h1", "h2", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [one_edit(a.lower().split(), b.lower().split()) for a, b in zip(texts(batch, "a"), texts(batch, "b"), strict=True)]
            yield batch.select(["h1", "h2"]).filter(pa.array(ok, pa.bool_()))

    near = pairs.mapInArrow(verify, "h1 long, h2 long").withColumn("near", F.lit(True))
    state = firsts.join(near, ["h1", "h2"], "left").withColumn("near", F.col("near").isNotNull()).where("near or many")
    state = Scratch(docs.sparkSession).written(state.select("h1", "h2", "first", "near"))
    scratch.dropped()
    gone = lines.drop("halves").join(state, ["h1", "h2"]).where(F.col("near") | (row > F.col("first"))).select(*ROW)
    return gone, lines.select("doc_id", "tag", "own").distinct()


def near_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with words), n_removed and removed_lines (numbers from 0, ascending, comma-joined) of each document.

    Lines are parted by line feeds; those without words are neither counted nor removed.
    Null and empty texts have no lines. Rows with the same id and text are one document,
    given once for each; rows with the same id and other texts are documents of their own, in order of a hash
    of the text. Rows without an id neither remove lines nor lose any. A text of one long line is one
    line whatever its length. Other columns are not read. An empty table gives no rows.
    """
    gone, counts = removable(docs)
    marks = gone.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("line_no")).alias("numbers"))
    marks = docs.select("doc_id", tag_of("text").alias("tag")).join(counts, ["doc_id", "tag"], "left").join(marks, ["doc_id", "tag"], "left")
    removed = F.when(F.col("numbers").isNull(), 0).otherwise(F.size("numbers"))
    return marks.select("doc_id", F.coalesce("own", F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.coalesce(F.array_join("numbers", ","), F.lit("")).alias("removed_lines"))


def drop_near_lines(docs: DataFrame) -> DataFrame:
    """docs without those lines; a document that loses all its lines with words goes. n_chars follows the text, if docs has it.

    Cases as in near_lines; null and empty texts and rows without an id stay as they are. Columns may have any names.
    """
    gone, counts = removable(docs)
    doc, tag, own, lost = fresh(docs.columns, "doc", "tag", "own", "lost")
    marks = gone.groupBy("doc_id", "tag").agg(F.collect_set("line_no").alias(lost)).join(counts, ["doc_id", "tag"]).select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), F.col("own").alias(own), lost)
    joined = docs.join(marks, (F.col("doc_id") == F.col(doc)) & (tag_of("text") == F.col(tag)), "left").where(F.col(lost).isNull() | (F.size(lost) < F.col(own)))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col(lost), i)), "\n")
    new = {"text": F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return joined.withColumns(new).select(*(F.col(f"`{c}`") for c in docs.columns))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """The same report by comparing each line with all earlier ones; a row for each of docs, whose ids are not null."""
    seen: list[list[bytes]] = []
    report = {}
    for doc, tag, text in sorted({(d, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), t or "") for d, t in docs}):
        n, gone = 0, []
        for no, line in enumerate(text.encode().lower().split(b"\n")):
            if words := line.split():
                n += 1
                if any(one_edit(words, old) for old in seen):
                    gone.append(no)
                seen.append(words)
        report[doc, text] = (doc, n, len(gone), ",".join(map(str, gone)))
    return [report[d, t or ""] for d, t in docs]
