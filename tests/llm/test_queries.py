"""Queries with SQL against DuckDB, and the pipeline against its stages done by brute force."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import same
from trackweave.llm import decontaminate, line_dedup, queries, simhash
from trackweave.llm.quality import score_quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, entry.queries()[name], queries.SQL[name], SF)


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_equals_stages_by_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = queries.read(spark, SF, "documents").limit(150).cache()
    labels, items = queries.read(spark, SF, "labels"), [(r["item_id"], r["text"]) for r in queries.read(spark, SF, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, SF).cache()
    poor = {r["doc_id"] for r in score_quality(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - poor

    cut = stages["line_dedup"](spark, kept, SF).cache()
    report = {d: (n, {int(x) for x in gone.split(",") if x}) for d, n, _, gone in line_dedup.brute_force([(r["doc_id"], r["text"]) for r in kept.collect()])}
    expected = {r["doc_id"]: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in report[r["doc_id"]][1]) for r in kept.collect() if len(report[r["doc_id"]][1]) < report[r["doc_id"]][0]}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == expected

    single = stages["simhash_near_dedup"](spark, cut, SF).cache()
    words = simhash.WORDS
    simhash.WORDS = 5
    groups = {g for _, _, g in simhash.brute_force([(r["doc_id"], r["text"]) for r in cut.collect()])}
    simhash.WORDS = words
    assert {r["doc_id"] for r in single.collect()} == groups

    clean = stages["decontamination"](spark, single, SF).cache()
    hits = {d: (n, h) for d, n, h, *_ in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert {r["doc_id"]: len(r["text"].encode().translate(decontaminate.FOLDED).split()) for r in clean.collect()} == {d: n - h for d, (n, h) in hits.items() if h == 0 or h < n}
    assert clean.columns == docs.columns

    packed = stages["packing"](spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}
