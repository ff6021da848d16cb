"""Quality scores by pairwise ranking (Bradley-Terry).

A document's score is linear in features of its whole text. Labelled documents give
preference pairs, a good one over a poor one; the chance that the first is preferred is the
logistic of the difference of scores, and the weights minimise the logistic loss on feature
differences. Documents whose score lies under a quantile of the scores of all training documents,
that of the share of poor ones, are poor. Only the weights are fitted on a sample.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import fold, map_text, written

#: The most labelled rows of either class that the weights are fitted on, and pairs drawn from them.
SAMPLE, PAIRS = 10_000, 40_000
#: Bins that a range of scores is cut into to find a quantile, and the most scores that are sorted on the driver.
BINS, SORTED = 4_096, 20_000
WINDOW = 512

CLASSES = ("upper", "lower", "high", "digit", "white", "stop", "shout", "bar", "mark", "other")
CLASS_OF = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if b >= 128 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\x0b\x0c" else 5 if b in b".,;:'\"-" else 6 if b in b"!?" else 7 if b in b"|<>/\\{}[]=_~" else 8 if b in b"#$%&*@^+" else 9 for b in range(256)], np.uint8)
NAMES = (
    "bytes", "words", "word_length", "distinct", "repeated_next", "commonest", "lines", "distinct_lines",
    *(f"share_{c}" for c in CLASSES), *(f"most_{c}" for c in CLASSES), "least_distinct", "short_lines",
)


def features(text: bytes) -> list[float]:
    """Shares over the whole text, and the extremes over its windows, so that a poor part of a long text shows."""
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    if not words:
        return [0.0] * len(NAMES)
    n, counts = len(words), Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    kinds = CLASS_OF[np.frombuffer(text, np.uint8)]
    parts = max(1, len(kinds) // WINDOW)
    at = np.minimum(np.arange(len(kinds)) // WINDOW, parts - 1)
    table = np.bincount(at * len(CLASSES) + kinds, minlength=parts * len(CLASSES)).reshape(parts, -1)
    shares = table / table.sum(axis=1, keepdims=True)
    step = 64
    least = min(len(set(words[a : a + step])) / len(words[a : a + step]) for a in range(0, max(1, n - step // 2), step))
    short = sum(len(line) < 40 for line in lines) / len(lines)
    return [
        np.log1p(len(text)), np.log1p(n), len(text) / n, len(counts) / n, again / n, max(counts.values()) / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        *(table.sum(axis=0) / len(kinds)), *shares.max(axis=0), least, short,
    ]


def spread(x: np.ndarray) -> np.ndarray:
    """Features with their square roots, which tell small shares apart."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


class Ranking:
    """Weights of a Bradley-Terry model."""

    def __init__(self, good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, rounds: int = 400, ridge: float = 1e-4):
        z = spread(np.concatenate([good, poor]))
        self.mean, self.scale = z.mean(axis=0), z.std(axis=0) + 1e-6
        z -= self.mean
        z /= self.scale
        draw = np.random.default_rng(7)
        x, part = z[draw.integers(0, len(good), pairs)], z[len(good) + draw.integers(0, len(poor), pairs)]
        x -= part  # the driver holds two tables of pairs and makes no others
        w, speed, square = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
        del z
        for t in range(1, rounds + 1):  # Adam on the whole set of pairs
            slope = -np.multiply(x, (1 / (1 + np.exp(np.clip(x @ w, -30, 30))))[:, None], out=part).mean(axis=0) + ridge * w
            speed, square = 0.9 * speed + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            w -= 0.05 * (speed / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        self.weights = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that equal texts have equal scores whatever stands beside them."""
        return ((spread(x) - self.mean) / self.scale * self.weights).sum(axis=1)


def at_rank(values: DataFrame, rank: int) -> float:
    """The value of column raw that has so many before it in ascending order: bins are counted and the one that holds it is cut again."""
    raw = F.col("raw")
    low, high, n = values.agg(F.min(raw), F.max(raw), F.count(raw)).first()
    while low < high and n > SORTED:
        place = F.least(F.floor((raw - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        for _, first, last, n in sorted(values.where(raw.between(low, high)).groupBy(place.alias("place")).agg(F.min(raw), F.max(raw), F.count(raw)).collect()):
            if rank < n:
                low, high = first, last
                break
            rank -= n
    return low if low == high else sorted(r[0] for r in values.where(raw.between(low, high)).select(raw).collect())[rank]


def border(training: DataFrame) -> tuple[float, float]:
    """The quantile of column raw over all training rows that is the share of poor ones (label 0), and a unit to measure distances from it in."""
    n, poor, spread_ = training.agg(F.count("*"), F.count_if(F.col("label") == 0), F.stddev_pop("raw")).first()
    place = (n - 1) * poor / n
    below = at_rank(training, int(place))
    above = at_rank(training, min(n - 1, int(place) + 1))
    return below + (above - below) * (place - int(place)), spread_ / 4 + 1e-9


def feature_table(docs: DataFrame) -> DataFrame:
    def run(rows: list[bytes]) -> list:
        return [[features(t) for t in rows]]

    return map_text(docs, "text", [T.StructField("features", T.ArrayType(T.DoubleType()))], run, ["doc_id"])


def training_labels(labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id and label of the rows outside the held-out fold."""
    known = labels.where(f"doc_id is not null and {label} in (0, 1)").where(fold(F.col("doc_id"), folds) != held_out)
    return known.select("doc_id", F.col(label).alias("label")).distinct()


def fit(table: DataFrame, marked: DataFrame, sample: int = SAMPLE) -> Ranking | None:
    """The model of the marked rows: of either class the `sample` rows whose ids hash lowest, rows of one id and equal features once. None without both classes."""
    rows = []
    for value in (1, 0):
        chosen = table.join(marked.where(F.col("label") == value).select("doc_id"), "doc_id", "left_semi")
        rows.append(np.array([r[0] for r in chosen.select("doc_id", "features").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).select("features").collect()]))
    return Ranking(*rows) if all(map(len, rows)) else None


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each row; only the text enters a score.

    Null, empty and wordless texts have features 0 and are scored like any; repeated rows are
    scored each, a null id is not held out. Without labels of both classes all scores are 0.5.
    Labels other than 0 and 1 or without an id teach nothing. Very long texts are read whole; columns of
    other names don't matter. An empty table gives none.
    """
    from trackweave.llm.common import to_arrow
    import pyarrow as pa

    table, marked = written(feature_table(docs)), training_labels(labels)
    model = fit(table, marked, sample)
    doc, held_out = to_arrow(docs.schema["doc_id"].dataType), (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    if model is None:
        return table.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(doc), pa.array(model(x) if len(x) else [], pa.float64())], names=["doc_id", "raw"])

    scored = written(table.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("raw", T.DoubleType())])))
    threshold, unit = border(written(scored.join(marked, "doc_id").select("raw", "label")))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (F.col("raw") - threshold) / unit))))
    return scored.select("doc_id", held_out, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted poor. Rows without an id stay."""
    poor = score_quality(docs.where("doc_id is not null"), labels).where("predicted = 0").select("doc_id").distinct()
    return docs.join(poor, "doc_id", "left_anti").select(*docs.columns)
