"""Null, empty, very long, tied and repeated rows, empty tables and clashing columns in every pipeline stage and in the operators of pages and scores."""

import pytest
from pyspark.sql import functions as F

from trackweave.llm import fixity, language, quality, toxicity
from trackweave.llm.queries import read

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "predicted", "held_out", "features", "raw", "label", "toxic", "doc", "tag", "own", "lost", "n_words", "hit_spans", "items", "fp", "root", "component_id", "fingerprint", "place", "salt", "ids", "curve", "lang_pred", "origin")


@pytest.fixture(scope="module")
def odd(spark):
    docs = read(spark, SF, "documents")
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "!!! ... 123"), (None, "a row without an id"), (900_005, long), (900_006, "tied text here for all"), (900_007, "tied text here for all"), (900_006, "tied text here for all"), (900_008, "one text"), (900_008, "another text of the same id")]
    extra = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    whole = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).limit(120).unionByName(extra)
    return whole.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(4).cache()


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, k):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    rows = out.collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if k == 4:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
        return
    assert out.dtypes == odd.dtypes and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    held = [(r["doc_id"], r["text"]) for r in rows]
    assert len(rows) > 80 and (None, "a row without an id") in held
    if name == "line_dedup":
        assert (900_001, None) in held and (900_002, "") in held and (900_003, " \n\t ") in held
        assert [x for x in held if x[1] == "tied text here for all"] == [(900_006, "tied text here for all")] * 2 and (900_007, "tied text here for all") not in held
    if name == "simhash_near_dedup":
        assert sum(d in (900_001, 900_002, 900_003) for d, _ in held) <= 1 and sum(t == "tied text here for all" for _, t in held) == 1
        assert (900_008, "one text") in held and (900_008, "another text of the same id") in held
    if name == "decontamination":
        assert len([x for x in held if x[0] is not None and x[0] > 900_000]) == 10


@pytest.mark.parametrize("score", [lambda d, x: quality.score_quality(d, x), lambda d, x: toxicity.score_toxicity(d, x), lambda d, x: language.identify(d)])
def test_scores(spark, odd, score):
    labels = read(spark, SF, "labels")
    out = score(odd, labels)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], set()).add(r["score"])
    assert own[900_006] == own[900_007] and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert score(odd.limit(0), labels).count() == 0
    nothing = score(odd.withColumn("lang", F.lit(None).cast("string")), labels.limit(0))
    assert nothing.select("score").distinct().count() == 1


def test_pages(spark):
    long = "x" * 3_000_000
    pages = spark.createDataFrame([(5, "u", long, "f", 1), (60, None, None, "f", 1), (31, "", "", "f", 1), (31, "", "", "f", 1), (322, "v", "b", "f", 1)], "page_id long, url string, html string, file string, offset int")
    got = sorted((r["page_id"], r["file"], r["status"]) for r in fixity.audit_pages(pages).collect())
    assert got == [(5, "pages-0.warc", "changed"), (31, "pages-0.warc", "missing"), (60, "pages-0.warc", "changed"), (322, "pages-1.warc", "missing")]
    assert fixity.audit_pages(pages.limit(0)).count() == 0
