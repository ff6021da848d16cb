"""Near copies against all pairs compared, with odd rows, near copies of one origin and chains."""

import random

import numpy as np
import pytest

from trackweave.llm import minhash
from trackweave.llm.queries import read

DOCS = "doc_id long, text string, whole string, Held int"


def words(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


def made():
    r = random.Random(8)
    texts = [" ".join(words(r, r.randint(1, 120))) for _ in range(60)]
    for origin in ([*words(r, 150)], [*words(r, 40)]):  # copies alike with their origin, hardly with each other
        for _ in range(40):
            copy = list(origin)
            for k in r.sample(range(len(copy)), max(1, len(copy) // r.randint(15, 30))):
                copy[k] = f"c{r.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(origin))
    chain = words(r, 60)
    for _ in range(12):
        chain = chain[3:] + words(r, 3)
        texts.append(" ".join(chain))
    shared = " ".join(words(r, 30))  # a passage of many documents that aren't alike
    texts += [shared + " " + " ".join(words(r, 20)) for _ in range(30)]
    texts += texts[:6] + [texts[3].upper(), texts[4].replace(" ", "\n\t ")] + [None, "", " \n\t ", None, "one", "One", "two words", "two  words", "x " * 3000, "é É", "é É"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, (None, texts[0]), (None, None), rows[5], rows[5]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in made()], DOCS).repartition(5).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_as_by_brute_force(table):
    assert rows(minhash.near_copies(table)) == sorted(minhash.brute_force(made()), key=str)


@pytest.mark.parametrize("texts,numbers", [(7, 300), (1, 1)])
def test_in_small_cells(table, monkeypatch, texts, numbers):
    monkeypatch.setattr(minhash, "CELL_TEXTS", texts * 4)
    monkeypatch.setattr(minhash, "CELL_SHINGLES", numbers * 10**3)
    assert rows(minhash.near_copies(table)) == sorted(minhash.brute_force(made()), key=str)


def test_kept_rows(table, spark):
    first = {(d, n) for d, n, _, kept in minhash.brute_force([x for x in made() if x[0] is not None]) if kept or n == 0}
    out = minhash.drop_near_copies(table)
    assert out.columns == table.columns and {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == {d for d, _ in first}
    assert sum(r["doc_id"] is None for r in out.collect()) == 2 and all(r["whole"] == "x" and r["Held"] == 1 for r in out.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert rows(minhash.near_copies(none)) == [] and rows(minhash.drop_near_copies(none)) == []
    assert rows(minhash.near_copies(spark.createDataFrame([(1, None, "", 1), (2, "", "", 1)], DOCS))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_share_of_alike_sets_that_meet():
    """Sets that are 0.8 alike agree on two collections at least."""
    r, met, far = np.random.default_rng(4), 0, 0
    for _ in range(2_000):
        both, a, b, c = (r.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10, 300))
        x, y = (np.array(minhash.collections(np.unique(np.concatenate([both, own])))) for own in (a, b))
        met += (x == y).sum() >= 2
        far += (x == np.array(minhash.collections(np.unique(np.concatenate([both[:20], c]))))).sum() >= 2
    assert met == 2_000 and far <= 4


def test_query_on_its_table(spark):
    from trackweave.llm.queries import op13_tensored_minhash

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    assert rows(op13_tensored_minhash(spark, sf)) == sorted(minhash.brute_force(docs), key=str)
