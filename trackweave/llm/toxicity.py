"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the words that toxic
text is marked by (in many more contexts than chance allows). Text is cut into windows of one
word; each is compressed, between fixed lead-in and lead-out bytes, once with the ordinary
dictionary and once with that and the toxic one together. What the toxic dictionary saves
is the window's gap. Numbers of windows beyond several gaps enter a calibrated logistic.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import batched, fold, map_text, slices, tag_of, texts, written

#: The most labelled rows that the dictionaries and the calibration are fitted on.
TOXIC_ROWS, ORDINARY_ROWS = 3_000, 6_000
#: The most words that either dictionary is trained on; its size; least contexts and log-likelihood ratio of a marking word.
MARKED_WORDS, ORDINARY_WORDS, TOXIC_BYTES, ORDINARY_BYTES, CONTEXTS, EVIDENCE = 2_000, 20_000, 4 << 10, 16 << 10, 4, 20.0
GAPS = (2, 3, 4, 5, 6, 7, 9, 12)
MARKS = b".,;:!?*$%&#|\"'()[]{}<>-_"
#: Words whose gap a worker remembers.
MEMORY = 500_000


def trained(words: list[tuple[bytes, int]], size: int) -> bytes:
    samples = [b" " + w + b" " for w, n in words for _ in range(min(n, 200))]
    random.Random(5).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text: what there is serves as the dictionary
        return b" ".join(w for w, _ in words)[-size:]


def dictionaries(marked: list[tuple[bytes, int]], ordinary: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Of one length, so that what both hold is equally far away: ordinary and filling, ordinary and toxic."""
    base, toxic = trained(ordinary, ORDINARY_BYTES), trained(marked, TOXIC_BYTES) if marked else b""
    left_out = [w for w, _ in reversed(marked) if w not in toxic]
    toxic = b" " + b" ".join(left_out) + b" " + toxic
    return base + bytes([1]) * len(toxic), base + toxic


class Gap:
    """Bytes that the second dictionary saves on a word."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.squeeze = [self.compressor(d) for d in (ordinary, toxic)]
        self.lead, self.tail = ordinary[2000:2040] or b"lead", ordinary[2000:2012] or b"lead"  # a block's first and last bytes aren't matched otherwise
        self.seen: dict[bytes, int] = {}

    @staticmethod
    def compressor(content: bytes):
        settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=7, min_match=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=settings).compress

    def __call__(self, word: bytes) -> int:
        if (gap := self.seen.get(word)) is None:
            window = self.lead + b" " + word + b" " + self.tail
            gap = len(self.squeeze[0](window)) - len(self.squeeze[1](window))
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            if len(word) <= 64:
                self.seen[word] = gap
        return gap


@lru_cache(maxsize=2)
def gaps(ordinary: bytes, toxic: bytes) -> Gap:
    return Gap(ordinary, toxic)


def words_of(text: bytes) -> list[bytes]:
    return [w for x in text.lower().split() if (w := x.strip(MARKS))]


def describe(text: bytes, gap: Gap) -> list[float]:
    words = words_of(text)
    own = np.fromiter((gap(w) for w in words), np.int64, len(words))
    counts = [int((own >= g).sum()) for g in GAPS]
    return [*(math.log1p(n) for n in counts), *(n / max(1, len(words)) for n in counts), *(float(n > 0) for n in counts)]


def contexts(sample: DataFrame) -> DataFrame:
    """word, toxic, n: in how many different pairs of neighbours each word stands. A copied passage counts once."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                found = set()
                for text, toxic in zip(texts(rows, "text"), rows.column("toxic").to_pylist(), strict=True):
                    words = words_of(text)
                    found.update((w, toxic, a + b"\n" + b) for a, w, b in zip([b"", *words], words, [*words[1:], b""], strict=False))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["word", "toxic", "beside"])

    return batched(sample).select("text", "toxic").mapInArrow(run, "word binary, toxic int, beside binary").groupBy("word", "toxic", F.xxhash64("beside").alias("beside")).count().groupBy("word", "toxic").agg(F.count("*").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, counts: tuple[float, float] | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, by Newton's method. counts: how many ordinary and toxic rows the sampled ones stand for."""
    y = np.asarray(y, float)
    each = np.array([n / max(1, (y == k).sum()) for k, n in enumerate(counts)])[y.astype(int)] if counts else np.ones(len(y))
    each = each / each.mean()
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + ridge * w
        step = np.linalg.solve((x * (each * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[bytes, bytes, np.ndarray] | None:
    """Both dictionaries and the calibration, from labelled rows outside the held-out fold; of either class those whose ids hash lowest. Classes count in the calibration by all their labelled rows. None without both."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id"), folds) != held_out).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.distinct()
    labelled = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    chosen = None
    for value, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most so many ids: small enough to broadcast. Their rows may be more: equal ones count once, and the limits hold for rows.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").withColumn("tag", tag_of("text")).dropDuplicates(["doc_id", "toxic", "tag"])
    few = [rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "tag").limit(most) for value, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    sample = written(few[0].unionByName(few[1]).drop("tag"))
    table = written(contexts(sample).groupBy("word").agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("n0")))
    all1, all0 = table.agg(F.sum("n1"), F.sum("n0")).first()
    if not all1 or not all0:
        return None
    rate = (F.col("n1") + F.col("n0")) / (all1 + all0)
    evidence = 2 * (F.col("n1") * F.log(F.col("n1") / (rate * all1)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (rate * all0))).otherwise(0))
    strong = table.where(F.col("n1") >= CONTEXTS).where(F.col("n1") / all1 > 3 * (F.col("n0") + 0.5) / all0).withColumn("evidence", evidence).where(F.col("evidence") > EVIDENCE)
    toxic_words = [(bytes(r[0]), r[1]) for r in strong.orderBy(F.desc("evidence"), "word").limit(MARKED_WORDS).select("word", "n1").collect()]
    common = [(bytes(r[0]), min(50, r[1])) for r in table.where("n0 > 0").orderBy(F.desc("n0"), "word").limit(ORDINARY_WORDS).select("word", "n0").collect()]
    ordinary, toxic = dictionaries(toxic_words, common)
    rows = described(sample, ordinary, toxic, ["doc_id", "toxic"]).select("toxic", "features").collect()
    y = np.array([r[0] for r in rows], float)
    # Sampled rows without a text are as rare among those that they stand for.
    counts = tuple((y == value).sum() * max(1, labelled[value] / most) for value, most in ((0, ORDINARY_ROWS), (1, TOXIC_ROWS)))
    return ordinary, toxic, logistic(np.array([r[1] for r in rows], float), y, counts)


def described(docs: DataFrame, ordinary: bytes, toxic: bytes, keep: list[str]) -> DataFrame:
    def run(rows: list[bytes]) -> list:
        gap = gaps(ordinary, toxic)
        return [[describe(t, gap) for t in rows]]

    return map_text(docs, "text", [T.StructField("features", T.ArrayType(T.DoubleType()))], run, keep)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each row; only the text enters a score.

    Null and wordless texts are scored like texts without toxic windows; repeated rows are
    scored each, a null id is not held out. Without labels of both classes all scores are 0.
    Labels other than 0 and 1 or without an id teach nothing. Very long texts are read whole; columns of
    other names don't matter. An empty table gives none.
    """
    model = fit(docs, labels)
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ordinary, toxic, weights = model

    def run(rows: list[bytes]) -> list:
        gap = gaps(ordinary, toxic)
        x = np.array([describe(t, gap) for t in rows], float).reshape(len(rows), -1)
        return [1 / (1 + np.exp(-np.clip((x * weights[:-1]).sum(axis=1) + weights[-1], -500, 500)))]

    scored = map_text(docs, "text", [T.StructField("score", T.DoubleType())], run, ["doc_id"])
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


