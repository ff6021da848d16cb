"""Held-out accuracy, and odd rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import language, quality, toxicity
from trackweave.llm.common import fold
from trackweave.llm.queries import read

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 50_000
    return spark.createDataFrame([(1, None, "en", "s", "x"), (2, "", None, "s", "x"), (3, "!!! 123", "en", None, "x"), (None, "some words", "de", "s", "x"), (4, long, "en", "s", "x"), (4, long, "en", "s", "x")], DOCS)


def held_out_accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.select("doc_id", label), "doc_id").select("predicted", label).collect()
    assert len(rows) > 50
    return sum(p == y for p, y in rows) / len(rows)


def test_quality(spark, odd):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    scored = quality.score_quality(docs, labels).persist()
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert held_out_accuracy(scored, labels, "quality") > 0.97
    got = quality.score_quality(odd.unionByName(docs.select("doc_id", "text", "lang", "source").withColumn("score", docs.text)), labels)
    assert got.count() == docs.count() + 6 and got.where("score is null or held_out is null").count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_ranking_holds_two_tables_of_pairs():
    r = np.random.default_rng(3)
    good, poor = r.random((2_000, 30)), r.random((2_000, 30)) + 0.1
    tracemalloc.start()
    quality.Ranking(good, poor, pairs=40_000, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 40_000 * 60 * 8  # four and more before


def test_toxicity(spark, odd):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    scored = toxicity.score_toxicity(docs, labels).persist()
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert held_out_accuracy(scored, labels, "toxic") > 0.93
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(odd, labels).count() == 6 and toxicity.score_toxicity(odd.limit(0), labels).count() == 0


def test_language(spark, odd):
    docs = read(spark, SF, "documents")
    found = language.identify(docs).persist()
    assert found.count() == docs.count() and found.where("score < 0 or score > 1").count() == 0
    rows = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("en", "de")
    assert language.identify(odd.limit(0)).count() == 0


def test_quick_network_equals_the_trained_one():
    net = language.Network(3)
    x = np.random.default_rng(0).integers(0, 256, (20, 128)).astype(np.uint8)
    assert np.allclose(net.logits(x), language.Quick(net).logits(x), atol=1e-4)


def test_sampling_does_not_move_the_border(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    marked = quality.training_labels(labels).join(docs.select("doc_id"), "doc_id")
    n, poor = marked.count(), marked.where("label = 0").count()
    found = quality.score_quality(docs, labels, sample=30).join(marked, "doc_id").where("predicted = 0").count()
    assert poor > 40 and poor / n < 0.25 and abs(found - poor) <= 2  # a balanced sample's own quantile calls about half of them poor


def test_rank_among_many(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED", 10)
    monkeypatch.setattr(quality, "BINS", 3)
    values = np.random.default_rng(2).normal(size=300).round(2).tolist() + [0.5] * 40
    table = spark.createDataFrame([(v, i % 5 and 1) for i, v in enumerate(values)], "raw double, label int").cache()
    assert all(quality.at_rank(table, k) == sorted(values)[k] for k in (0, 1, 150, 240, 339))
    threshold, unit = quality.border(table)
    assert abs(threshold - np.quantile(values, 0.2)) < 1e-12 and abs(unit - np.std(values) / 4) < 1e-6


def test_calibration_has_the_shares_of_all_labelled_rows():
    r = np.random.default_rng(1)
    x, y = np.concatenate([r.normal(0, 1, (9_000, 1)), r.normal(1.5, 1, (1_000, 1))]), np.repeat([0.0, 1.0], [9_000, 1_000])
    share = lambda w: (1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))).mean()
    capped = np.concatenate([np.arange(1_000), np.arange(9_000, 10_000)])
    assert abs(share(toxicity.logistic(x, y)) - 0.1) < 0.005 and abs(share(toxicity.logistic(x[capped], y[capped], (9_000, 1_000))) - 0.1) < 0.01
    assert share(toxicity.logistic(x[capped], y[capped])) > 0.25


def test_repeats_of_one_row_teach_once(spark, monkeypatch):
    """A labelled row that stands there very often is one row of the sample, and pushes no other out."""
    monkeypatch.setattr(language, "ROWS", 20)
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang")
    often = docs.orderBy(F.xxhash64("doc_id")).where("text is not null").where(fold(F.col("doc_id"), 5) != 0).limit(1)
    many = docs.unionByName(often.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("k"))
    names, net = language.fit(docs)
    again, other = language.fit(many)
    assert names == again and all((a == b).all() for a, b in zip(net.taps, other.taps))
    labels, marked = read(spark, SF, "labels"), docs.select("doc_id", "text")
    copied = many.select("doc_id", "text")
    one, two = toxicity.fit(marked, labels), toxicity.fit(copied, labels)
    assert one[:2] == two[:2] and (one[2] == two[2]).all()
    a, b = (quality.fit(quality.feature_table(x), quality.training_labels(labels), 50) for x in (marked, copied))
    x = quality.feature_table(marked.limit(50)).toPandas()["features"].tolist()
    assert (a(np.array(x)) == b(np.array(x))).all()


@pytest.mark.parametrize("text,found", [("½ ² ①", False), ("① 12", False), ("Ⅷ", False), ("", False), ("_ - 3", False), ("٣", False), ("é", True), ("12 x", True), ("日", True), ("ª", True)])
def test_letters(text, found):
    assert language.lettered(text.encode()) is found


def by_id(rows, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows.collect()}


@pytest.fixture(scope="module")
def small(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90_001, None, None), (90_002, "", None), (90_003, "12 ½ --", None), (90_004, "word " * 40_000, None)], docs.schema)
    return docs.unionByName(odd).cache(), read(spark, "/root/testdata/sf0.001", "labels")


def test_quality_scores_as_computed_one_by_one(small):
    docs, labels = small
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    marks = {r["doc_id"]: r["label"] for r in quality.training_labels(labels).collect() if r["doc_id"] in texts}
    import xxhash

    order = lambda d: np.uint64(xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), 42)).view(np.int64)
    held = [[quality.features(texts[d]) for d in sorted((d for d, y in marks.items() if y == value), key=order)] for value in (1, 0)]
    model = quality.Ranking(np.array(held[0][: quality.SAMPLE]), np.array(held[1][: quality.SAMPLE]))
    raw = {d: float(model(np.array([quality.features(t)], float))[0]) for d, t in texts.items()}
    training = np.array([raw[d] for d in marks])
    threshold, unit = np.quantile(training, np.mean([y == 0 for y in marks.values()])), training.std() / 4 + 1e-9
    got = by_id(quality.score_quality(docs, labels), "score", "predicted")
    for d, x in raw.items():
        expected = 1 / (1 + np.exp(-np.clip((x - threshold) / unit, -500, 500)))
        assert abs(got[d][0] - expected) < 1e-6 and (got[d][1] == (expected >= 0.5) or abs(expected - 0.5) < 1e-6)


def test_toxicity_scores_as_computed_one_by_one(small):
    docs, labels = small
    ordinary, toxic, weights = toxicity.fit(docs, labels)
    import math

    import zstandard

    settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=7, min_match=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    squeeze = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings) for d in (ordinary, toxic)]
    got = by_id(toxicity.score_toxicity(docs, labels), "score")
    for r in docs.collect():
        words = [w for x in (r["text"] or "").encode().lower().split() if (w := x.strip(toxicity.MARKS))][:3_000]
        if r["doc_id"] == 90_004:
            continue  # the same word forty thousand times
        gaps = [len(a) - len(b) for w in words for a, b in [[s.compress(ordinary[2000:2040] + b" " + w + b" " + ordinary[2000:2012]) for s in squeeze]]]
        counts = [sum(g >= k for g in gaps) for k in toxicity.GAPS]
        x = [*(math.log1p(n) for n in counts), *(n / max(1, len(words)) for n in counts), *(float(n > 0) for n in counts)]
        assert abs(got[r["doc_id"]][0] - 1 / (1 + math.exp(-float(np.dot(x, weights[:-1]) + weights[-1])))) < 1e-9


def test_languages_as_computed_one_by_one(small):
    docs, _ = small
    names, net = language.fit(docs)
    got = by_id(language.identify(docs), "lang_pred", "score")
    for r in docs.collect():
        text = (r["text"] or "").encode()
        if not any(c.isalpha() for c in text.decode()):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        cuts = language.windows(text)
        weight = np.ones(len(cuts))
        weight[-1] = max(1, len(text) - (len(cuts) - 1) * language.LENGTH) / language.LENGTH
        z = (net.logits(cuts).astype(float) * weight[:, None]).sum(axis=0) / weight.sum()
        p = np.exp(z - z.max())
        p /= p.sum()
        assert abs(got[r["doc_id"]][1] - p.max()) < 1e-3 and (got[r["doc_id"]][0] == names[int(p.argmax())] or np.sort(p)[-2] > p.max() - 2e-3)
