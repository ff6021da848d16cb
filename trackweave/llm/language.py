"""Language identification by a convolutional network over bytes.

Filters of several widths run over windows of fixed length, each filter keeps its largest
answer in the window, and a softmax layer names the language. A whole text is cut into
windows; their logits are averaged by length. The network is trained in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from trackweave.llm.common import batched, fold, map_text, slices, tag_of, texts

LENGTH, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: The most labelled rows that it is trained on, for a language (1,000 at most, so that Spark limits each group before it is shuffled) and in all; windows of each row.
ROWS, ALL_ROWS, WINDOWS = 1_000, 12_000, 2
UNKNOWN = "und"
#: Windows that a worker computes at a time.
BATCH = 512


def windows(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Rows of bytes, A-Z in lower case and digits and marks of ASCII as spaces, the last row filled up with spaces."""
    data = np.frombuffer(text.translate(PLAIN), np.uint8)
    rows = max(1, -(-len(data) // length))
    out = np.full(rows * length, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, length)


def lettered(text: bytes) -> bool:
    """Whether there is a letter; digits, fractions and numerals of any script are none."""
    return any(map(str.isalpha, text.decode()))


PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Network:
    def __init__(self, classes: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.taps = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.top = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.last = np.zeros(classes, np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter and where it begins."""
        most, where = [], []
        for taps, bias in zip(self.taps, self.bias, strict=True):
            n = x.shape[1] - len(taps) + 1
            answer = taps[0][x[:, :n]]
            for j in range(1, len(taps)):
                answer += taps[j][x[:, j : j + n]]
            at = answer.argmax(axis=1)
            most.append(np.take_along_axis(answer, at[:, None], axis=1)[:, 0] + bias)
            where.append(at)
        return np.concatenate(most, axis=1), np.concatenate(where, axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x)[0], 0) @ self.top + self.last

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 2e-3, seed: int = 12) -> None:
        """Adam; only the place of a filter's largest answer passes its slope on."""
        draw = np.random.default_rng(seed)
        held = [*self.taps, *self.bias, self.top, self.last]
        first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                hidden, where = self.pooled(x[rows])
                alive = np.maximum(hidden, 0)
                z = alive @ self.top + self.last
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.top.T) * (hidden > 0)
                slopes_t, slopes_b = [], []
                for k, taps in enumerate(self.taps):
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    slope, at = np.zeros_like(taps), where[:, part]
                    for j in range(len(taps)):
                        seen = np.take_along_axis(x[rows], at + j, axis=1)
                        np.add.at(slope[j], (seen, np.arange(FILTERS)[None]), back[:, part])
                    slopes_t.append(slope)
                    slopes_b.append(back[:, part].sum(axis=0))
                step += 1
                for q, s, m, v in zip(held, [*slopes_t, *slopes_b, alive.T @ p, p.sum(axis=0)], first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * s
                    v *= 0.999
                    v += 0.001 * s * s
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


class Quick:
    """The trained network with neighbouring taps summed for byte pairs."""

    def __init__(self, net: Network):
        self.net, self.tables = net, []
        for taps in net.taps:
            own = [(j, (taps[j][:, None] + taps[j + 1][None]).reshape(1 << 16, FILTERS)) for j in range(0, len(taps) - 1, 2)]
            self.tables.append((len(taps), own, taps[-1] if len(taps) % 2 else None))

    def logits(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        most = []
        for (width, own, single), bias in zip(self.tables, self.net.bias, strict=True):
            n = x.shape[1] - width + 1
            answer = None
            for j, table in own:
                part = table.take(pair[:, j : j + n], axis=0)
                answer = part if answer is None else np.add(answer, part, out=answer)
            if single is not None:
                answer += single.take(x[:, width - 1 : width - 1 + n], axis=0)
            most.append(answer.max(axis=1) + bias)
        # Row by row, so that equal texts have equal logits whatever stands beside them.
        return np.einsum("nk,kc->nc", np.maximum(np.concatenate(most, axis=1), 0), self.net.top) + self.net.last


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[list[str], Network] | None:
    """Languages and network, from rows with a language outside the held-out fold: of each language the ROWS whose ids hash lowest. None without any."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id"), folds) != held_out)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).distinct().withColumn("rank", rank).where(F.col("rank") <= ROWS).orderBy("rank", "lang").limit(ALL_ROWS)
    # At most ALL_ROWS ids: small enough to broadcast. Their rows may be more: equal ones count once, and the limits hold for rows.
    rows = known.select("doc_id", "lang", "text", tag_of("text").alias("tag")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    again = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "tag"))
    sample = rows.dropDuplicates(["doc_id", "lang", "tag"]).withColumn("rank", again).where(F.col("rank") <= ROWS).orderBy("rank", "lang").limit(ALL_ROWS)

    def cut(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                lang, parts = [], []
                for text, own in zip(texts(rows, "text"), rows.column("lang").to_pylist(), strict=True):
                    if own is None or not lettered(text):
                        continue
                    cuts = windows(text)
                    for k in {0, len(cuts) // 2} if WINDOWS == 2 else range(min(WINDOWS, len(cuts))):
                        lang.append(own)
                        parts.append(cuts[k].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(parts, pa.binary())], names=["lang", "window"])

    rows = sorted((r[0], bytes(r[1])) for r in batched(sample).mapInArrow(cut, "lang string, window binary").collect())
    if not rows:
        return None
    names = sorted({lang for lang, _ in rows})
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, LENGTH)
    net = Network(len(names))
    net.train(x, np.array([names.index(lang) for lang, _ in rows]))
    return names, net


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each row; only the text enters a prediction.

    Null texts and those without a letter are `und` with score 0; so are all, if no row has a
    language to learn. Repeated rows are predicted each, a null id is not held out. Very long texts are read
    whole; columns of other names don't matter. An empty table gives none.
    """
    model = fit(docs)
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names, net = model
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(rows: list[bytes]) -> list:
        quick = Quick(sent.value)
        letters = [lettered(t) for t in rows]
        cuts = [windows(t) for t in rows]
        counts = [len(c) for c in cuts]
        x = np.concatenate(cuts)
        z = np.concatenate([quick.logits(x[a : a + BATCH]) for a in range(0, len(x), BATCH)])
        weight = np.full(len(x), 1.0)
        ends = np.cumsum(counts)
        weight[ends - 1] = [max(1, len(t) - (n - 1) * LENGTH) / LENGTH for t, n in zip(rows, counts, strict=True)]
        first = np.concatenate([[0], ends[:-1]])
        mean = np.add.reduceat(z * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lang = [names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return [lang, np.where(letters, p[np.arange(len(best)), best].astype(np.float64), 0.0)]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, "text", fields, run, ["doc_id"]).select("doc_id", held_out, "lang_pred", "score")
