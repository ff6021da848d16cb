"""Each operator against a brute-force version, an exact round trip or the tokenizer itself, on small tables with odd rows."""

import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import decontaminate, fixity, line_dedup, neighbours, packing, simhash, token_counts
from trackweave.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta,", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def made_docs(seed=1, n=60):
    """Documents with copies, near copies, repeated lines, blank, null, empty and very long texts."""
    r = random.Random(seed)
    line = lambda k: " ".join(r.choices(WORDS, k=k))
    texts = ["\n".join(line(r.randint(1, 14)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    for i in range(0, n, 3):
        words = texts[i].split(" ")
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += texts[:5] + [None, "", " \n\t ", "one", "one", "!!!", "x " * 3000, line(4000)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_as_by_brute_force(docs):
    expected = line_dedup.brute_force([(d, t) for d, t, *_ in made_docs()])
    assert rows(line_dedup.near_lines(docs)) == sorted(expected)


def test_lines_cut_from_texts(docs, spark):
    expected = {d: {int(x) for x in gone.split(",") if x} for d, _, _, gone in line_dedup.brute_force([(d, t) for d, t, *_ in made_docs()])}
    counts = {d: n for d, n, _, _ in line_dedup.brute_force([(d, t) for d, t, *_ in made_docs()])}
    kept = {r["doc_id"]: r for r in line_dedup.drop_near_lines(docs).collect()}
    for d, text, *_ in made_docs():
        if expected[d] and len(expected[d]) == counts[d]:
            assert d not in kept
        elif text is None:
            assert kept[d]["text"] is None
        else:
            left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in expected[d])
            assert kept[d]["text"] == left and kept[d]["n_chars"] == len(left)


def test_lines_without_rows_or_ids(none, spark):
    assert rows(line_dedup.near_lines(none)) == [] and rows(line_dedup.drop_near_lines(none)) == []
    odd = spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y")], "doc_id long, text string, gone string")
    assert sorted(line_dedup.near_lines(odd).collect(), key=str) == sorted([(1, 1, 0, ""), (1, 1, 0, ""), (None, 0, 0, "")], key=str)
    assert line_dedup.drop_near_lines(odd).count() == 3


def test_lines_of_repeated_ids_and_clashing_columns(spark):
    """Rows of one id with other texts are documents of their own; a line of very many words and lines of other documents between don't matter."""
    long = " ".join(f"w{k}" for k in range(60_000))
    data = [(1, "p q r s t u"), (1, "a b c d e f"), (2, "a b c d e g"), (3, "p q r s t v"), (3, "p q r s t v"), (4, long + "\n" + long.replace("w500 ", "")), (5, None), (6, "x\nx\n\ny")]
    docs = spark.createDataFrame([(d, t, "own", "x", "y", 1) for d, t in data], "doc_id long, text string, doc string, tag string, _lost string, Own int").repartition(3)
    expected = line_dedup.brute_force(data)
    assert rows(line_dedup.near_lines(docs)) == sorted(expected) and [r[1:3] for r in expected] == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 1), (2, 1), (0, 0), (3, 1)]
    kept = line_dedup.drop_near_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {(r["doc_id"], r["text"], r["doc"], r["tag"], r["_lost"], r["Own"]) for r in kept.collect()} == {(d, t, "own", "x", "y", 1) for d, t in ((1, "a b c d e f"), (1, "p q r s t u"), (4, long), (5, None), (6, "x\n\ny"))}


def test_halves_of_near_lines_meet():
    r = random.Random(3)
    for _ in range(3_000):
        a = [str(r.randrange(50)).encode() for _ in range(r.randint(4, 70))]
        b, k = list(a), r.randrange(len(a))
        change = r.randrange(3)
        b[k : k + (change > 0)] = [] if change == 2 else [b"new"]
        if max(len(a), len(b)) >= line_dedup.LEAST:
            assert set(line_dedup.halves(a)) & set(line_dedup.halves(b)) and line_dedup.one_edit(a, b)


@pytest.mark.parametrize("a,b,near", [("a b c d e", "a b x d e", True), ("a b c d", "a b c d e", True), ("a b c d", "a b x d", False), ("a b c d e", "b a c d e", False), ("a b c d e", "a b c d", True), ("a", "a", True)])
def test_one_edit(a, b, near):
    assert line_dedup.one_edit(a.encode().split(), b.encode().split()) is near


def test_simhash_as_by_brute_force(docs):
    expected = simhash.brute_force([(d, t) for d, t, *_ in made_docs()])
    assert rows(simhash.near_duplicates(docs)) == sorted(expected)


def test_simhash_pairs_of_chained_fingerprints(spark):
    r = random.Random(4)
    prints = set()
    for _ in range(150):
        x = r.getrandbits(64)
        for _ in range(6):
            prints.add(x - (1 << 64) if x >> 63 else x)
            for bit in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << bit
    prints = sorted(prints)
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                group[max(root(a), root(b))] = min(root(a), root(b))
    from trackweave.llm.common import connected

    got = dict(rows(connected(simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")))))
    assert {p: got.get(p, p) for p in prints} == {p: root(p) for p in prints}


def test_a_round_of_components_reads_its_pairs_four_times(spark):
    from trackweave.llm.common import stars

    step = stars(spark.createDataFrame([(3, 1), (3, 2), (4, 3)], "a long, b long"))
    assert rows(step) == [(2, 1), (3, 1), (4, 1)]
    assert step._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 4  # sixteen before


def test_ring_bounds_lose_no_pair():
    r = np.random.default_rng(3)
    a = r.integers(-(2**63), 2**63 - 1, 4000)
    b = a.copy()
    for _ in range(4):
        b ^= np.int64(1) << r.integers(0, 64, 4000)
    for depth in (1, 2, 4):
        at = defaultdict(set)
        shard, fp, home = simhash.visits(np.concatenate([a, b]), 12345, depth)
        for s, f, h in zip(shard.tolist(), fp.tolist(), home.tolist()):
            at[f, h].add(s)
        assert all(at[x, True] & (at[y, True] | at[y, False]) or at[y, True] & (at[x, True] | at[x, False]) for x, y in zip(a.tolist(), b.tolist()))


def test_simhash_keeps_one_of_each_group(docs, none, spark):
    expected = {g for _, _, g in simhash.brute_force([(d, t) for d, t, *_ in made_docs()])}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == expected
    assert rows(simhash.near_duplicates(none)) == [] and rows(simhash.drop_near_duplicates(none)) == []
    odd = spark.createDataFrame([(3, "a b", 1), (3, "a b", 1), (None, "a b", 2)], "doc_id long, text string, fp long")
    assert sorted(r["doc_id"] or 0 for r in simhash.drop_near_duplicates(odd).collect()) == [0, 3]


def test_simhash_of_repeated_ids_and_clashing_columns(spark):
    """Of rows with one id, those of other groups stay."""
    r = random.Random(20)
    a, b, c = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    data = [(1, a), (1, b), (0, b), (2, c), (2, c), (2, a), (3, None), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, "tag", 5, "root") for d, t in data], "doc_id long, text string, Tag string, fp int, root string").repartition(3)
    kept = simhash.drop_near_duplicates(docs, size=5, alike=True)
    assert kept.dtypes == docs.dtypes
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([(1, a), (0, b), (2, c), (3, None), (None, a), (None, a)], key=str)


def test_alike_texts_without_an_id(spark):
    r = random.Random(31)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    near = lambda k: " ".join([*words[:k], f"n{k}", *words[k + 1 :]])
    docs = spark.createDataFrame([(None, near(50)), (7, near(150)), (9, near(250)), (None, "quite another text of its own words")], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(docs, size=5, alike=True).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (9, 7), (None, None)], key=str)


def test_simhash_in_deep_trees_and_grids(docs, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 2)
    monkeypatch.setattr(simhash, "SIDE", 3)
    assert rows(simhash.near_duplicates(docs)) == sorted(simhash.brute_force([(d, t) for d, t, *_ in made_docs()]))


def test_decontamination_as_by_brute_force(docs, spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 14)))) for i in range(30)] + [(30, None), (31, ""), (32, "alpha beta"), (33, "alpha beta")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 10):
        expected = decontaminate.brute_force([(d, t) for d, t, *_ in made_docs()], items, window)
        assert rows(decontaminate.digest(decontaminate.find_overlaps(docs, table, window, keep=["doc_id"]))) == sorted(expected)
    cleaned = decontaminate.remove_overlaps(docs, table, 3)
    hit = {d: (n, h) for d, n, h, *_ in decontaminate.brute_force([(d, t) for d, t, *_ in made_docs()], items, 3)}
    assert {r["doc_id"] for r in cleaned.collect()} == {d for d, (n, h) in hit.items() if h == 0 or h < n}
    for r_ in cleaned.collect():
        n, h = hit[r_["doc_id"]]
        assert len((r_["text"] or "").encode().translate(decontaminate.FOLDED).split()) == n - h


def test_decontamination_in_chunks_and_empty(docs, none, spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(WORDS[i : i + 3])) for i in range(9)], "item_id long, text string")
    whole = rows(decontaminate.digest(decontaminate.find_overlaps(docs, items, 3)))
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", 30)
    assert rows(decontaminate.digest(decontaminate.find_overlaps(docs, items, 3))) == whole
    assert rows(decontaminate.digest(decontaminate.find_overlaps(none, items))) == []
    assert all(not r["contaminated"] for r in decontaminate.digest(decontaminate.find_overlaps(docs, items.limit(0))).collect())


def test_decontamination_with_odd_items_and_clashing_columns(spark):
    items = spark.createDataFrame([("", "alpha beta gamma"), (None, "delta eta"), ("x", "delta eta"), ("x", None), ("y", "zz \u00e9\u00e9")], "item_id string, text string")
    data = [(1, "x alpha beta gamma y"), (2, "delta, ETA!"), (3, None), (3, "q zz \u00e9\u00e9 r"), (3, "q zz \u00e9\u00e9 r"), (None, "alpha beta gamma delta eta k"), (4, "w " * 30_000 + "delta eta")]
    docs = spark.createDataFrame([(d, t, 7, "own", "h") for d, t in data], "doc_id long, text string, n_words int, items string, Hit_Spans string").repartition(3)
    expected = decontaminate.brute_force(data, [("", "alpha beta gamma"), (None, "delta eta"), ("x", "delta eta"), ("y", "zz \u00e9\u00e9")], 10)
    assert {t[0]: t[3] for t in expected}[2] == 2
    assert sorted(map(str, (tuple(r) for r in decontaminate.digest(decontaminate.find_overlaps(docs, items, keep=["doc_id"])).collect()))) == sorted(map(str, expected))
    cleaned = decontaminate.remove_overlaps(docs, items)
    assert cleaned.dtypes == docs.dtypes and {(r["n_words"], r["items"], r["Hit_Spans"]) for r in cleaned.collect()} == {(7, "own", "h")}
    assert sorted((str(r["doc_id"]), " ".join((r["text"] or "-").split())) for r in cleaned.collect()) == [("1", "x y"), ("3", "-"), ("3", "q r"), ("3", "q r"), ("4", ("w " * 30_000).strip()), ("None", "k")]


def test_index_finds_every_place():
    r = np.random.default_rng(5)
    for top in (1, 2, 7):
        text = np.concatenate([[0], r.integers(0, top + 1, 300), [0]])
        index = decontaminate.FMIndex(text, top)
        for size in (1, 2, 5):
            phrases = r.integers(1, top + 1, (20, size))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                places = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_packing_gives_every_id_back(docs, none, spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in packing.pack(docs, path, length=64).collect():
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text, *_ in made_docs():
        expected = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        got = []
        for start, ids, total in sorted(pieces[d]):
            assert start == len(got) and total == len(expected)
            got += ids
        assert got == expected
    for own in places.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 64
    assert sum(sum(n for _, n in own) < 64 for own in places.values()) <= 1
    assert rows(packing.pack(none, path)) == []


@pytest.mark.parametrize("quantiles", [3, 64])
def test_packing_over_many_ranges(spark, monkeypatch, quantiles):
    """Ranges of the curve don't overlap, none is packed out of order, sequence ids are unique, and clashing columns, null and repeated ids and texts do no harm."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    monkeypatch.setattr(packing, "RANGE_BYTES", 4_000)
    monkeypatch.setattr(packing, "QUANTILES", quantiles)
    monkeypatch.setattr(packing, "HELD_IDS", 500)
    data = [(d, t, "salt", "place") for d, t, *_ in made_docs()] + [(500 + k, "one and the same text", "", "") for k in range(60)] + [(None, "no id", "", ""), (None, None, "", ""), (7, "other text", "", ""), (7, "other text", "", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, salt string, range_id string").withColumn("place", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("curve", F.lit("x")).repartition(7)
    made = [r.asDict() for r in packing.pack(docs, path, length=64).collect()]
    ranges = defaultdict(list)
    for r in made:
        ranges[r["sequence_id"] >> 40].append(r)
    assert len(ranges) > 8
    tokenizer, found = Tokenizer.from_file(path), []
    key = {d: int(packing.curve_keys([(t or "").encode()])[0]) for d, t, *_ in data if d is not None and d != 7}
    last = -1
    for _, own in sorted(ranges.items()):
        own.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        keys, at = [key[r["doc_id"]] for r in own if r["doc_id"] in key and r["start"] == 0], 0
        assert keys == sorted(keys) and (not keys or keys[0] >= last)
        last = keys[-1] if keys else last
        for r in own:
            assert (r["sequence_id"] & (1 << 40) - 1, r["offset"]) == divmod(at, 64)
            at += r["length"]
            if r["start"] == 0:
                found.append((r["doc_id"], []))
            found[-1][1].extend(struct.unpack(f"<{r['length']}I", r["ids"]))
    assert sorted(found, key=str) == sorted(((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in data), key=str)


def test_encoder_that_forgets(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    encode = packing.Encoder(tokenizer_file("word_bpe_49k.json"))
    for text in ("one two, three", "Three! four five's 6", "", "two two two", "日本 ok..."):
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_hilbert_steps_to_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        key = packing.hilbert(grid, bits)
        walk = grid[np.argsort(key)]
        assert sorted(key.tolist()) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_encoder_equals_tokenizer():
    encode = packing.Encoder(tokenizer_file("word_bpe_49k.json"))
    r = random.Random(6)
    texts = ["", " ", "Don't 's", "<|endoftext|>x, ÉCOLE. ë İΣ", "a\tb c\x1cd"] + ["".join(r.choices("abÉz ,.'!\n日́Σ0", k=40)) for _ in range(500)]
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_neighbours_as_by_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 7)).astype(np.float32)
    x[10] = x[11] = x[12]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(300, None), (301, [0.0] * 7), (302, [float("nan")] * 7), (303, [None] * 7), (304, [float("inf")] + [0.0] * 6), (305, []), (306, [1.0, 2.0]), (None, [1.0] * 7)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4)
    got = rows(neighbours.nearest(table.where("vec_id % 10 = 0"), table))
    expected = []
    for q in range(0, 300, 10):
        d = sorted((float(neighbours.distances(x[q : q + 1].astype(float), x[c : c + 1].astype(float))[0]), c) for c in range(300) if c != q)
        expected += [(q, i + 1, c, s) for i, (s, c) in enumerate(d[:10])]
    assert got == sorted(expected)
    few = table.where("vec_id in (1, 2, 306)")
    assert [(r[0], r[2]) for r in rows(neighbours.nearest(few, few))] == [(1, 2), (2, 1)]
    assert rows(neighbours.nearest(few.limit(0), table)) == []


def test_neighbours_of_very_large_and_small_vectors(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(30, 4)) * 1e160, r.normal(size=(30, 4)) * 1e-170, r.normal(size=(20, 4))])
    x[5] = x[6]
    data = [(i, [float(v) for v in row], "id", 1) for i, row in enumerate(x)] + [(3, [float(v) for v in x[3]], "id", 1), (40, [9e300] * 4, "id", 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, id string, rank int").repartition(3)
    got = rows(neighbours.nearest(table.where("vec_id % 5 = 0"), table, k=4))
    expected = []
    for q in range(0, 80, 5):
        d = sorted((math.hypot(*(a - b for a, b in zip(v, w))), c) for i, v, *_ in data if i == q for c, w, *_ in data if c != q)
        expected += [(q, i + 1, c, s) for i, (s, c) in enumerate(d[:4])]
    assert [t[:3] for t in got] == [t[:3] for t in expected] and all(abs(a[3] - b[3]) <= 1e-14 * b[3] for a, b in zip(got, expected))


def test_neighbours_over_many_tiles(spark, monkeypatch):
    r = np.random.default_rng(2)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(r.normal(size=(200, 5)))], "vec_id long, embedding array<double>")
    whole = rows(neighbours.nearest(table.where("vec_id % 4 = 0"), table))
    monkeypatch.setattr(neighbours, "CANDIDATES", 30)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    assert rows(neighbours.nearest(table.where("vec_id % 4 = 0"), table)) == whole


def test_neighbours_among_equal_vectors():
    """All pairs of a tile survive; what is gathered of them stays small."""
    import tracemalloc

    r = np.random.default_rng(6)
    c = np.concatenate([np.ones((20_000, 32)), r.normal(size=(30, 32))])
    ids = r.permutation(len(c))
    tracemalloc.start()
    got = neighbours.tile(np.arange(200) + 10**6, np.ones((200, 32)), ids, c, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = sorted(ids[:20_000].tolist())[:10]
    assert got == [(q + 10**6, i, 0.0) for q in range(200) for i in first] and most < 600 << 20


def test_counts_equal_the_tokenizer(docs, none):
    path = tokenizer_file("piece_bpe_32k.model")
    texts = {d: t for d, t, *_ in made_docs()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    assert got == dict(zip(texts, token_counts.reference_counts([t or "" for t in texts.values()], path)))
    assert rows(token_counts.count_tokens(none, path)) == []


def test_counts_with_ties_and_gaps():
    from tokenizers import Tokenizer, models, normalizers

    r = random.Random(8)
    for fallback in (False, True):
        pieces = [("<unk>", 0.0), *([(f"<0x{b:02X}>", -5.0) for b in range(256)] if fallback else [])]
        pieces += [(p, float(-r.randint(0, 4))) for p in ("▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "bb", "abab", "▁▁")]
        whole = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
        whole.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        count = token_counts.Counter(pieces)
        for _ in range(400):
            text = "".join(r.choices("aab béz", k=r.randint(1, 25)))
            assert count(text)[0] == len(whole.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_with_fractional_scores(fallback):
    """Tenths make sums that tie but for rounding, so that what stands before a stretch can decide it."""
    from tokenizers import Tokenizer, models, normalizers

    r = random.Random(9)
    for kind in range(6):
        draw = (lambda: -r.randint(1, 30) / 10) if kind % 2 else (lambda: -r.uniform(0, 4))
        pieces = [("<unk>", 0.0), *([(f"<0x{b:02X}>", -5.0) for b in range(256)] if fallback else [])]
        pieces += [(p, draw()) for p in ("▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "bb", "abab", "▁▁", "aa", "baa")]
        whole = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
        whole.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        count = token_counts.Counter(pieces)
        for k in range(300):
            text = "".join(r.choices("aab b\u00e9z" if k % 3 else "aab ", k=r.choice((1, 9, 30, 400))))
            assert count(text)[0] == len(whole.encode(text, add_special_tokens=False).ids), text


def test_counts_of_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 1.5), (1, "one two", "x", 1.5), (None, "  ", "y", 0.0), (2, None, "z", 0.0)], "doc_id long, text string, n_tokens string, viterbi_score double")
    path = tokenizer_file("piece_bpe_32k.model")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(docs, path, keep=docs.columns).collect()))
    assert got == sorted(zip((1, 1, 0, 2), token_counts.reference_counts(["one two", "one two", "  ", ""], path)))


def test_audit_finds_what_was_damaged(spark):
    good = [(i, f"f{i % 3}", i * 1000, 10 + i, f"h{i}") for i in range(400)]
    bad = [(p, f, o, n, h + "x" if p in (7, 8) else h) for p, f, o, n, h in good if p != 50] + [(900, "f1", 1, 5, "new"), (901, "f9", 0, 1, "file")]
    kind = "page_id long, file string, offset long, length long, leaf string"
    a, b = spark.createDataFrame(good, kind), spark.createDataFrame(bad, kind)
    got = {(r["page_id"], r["status"]) for r in fixity.audit(a, b, span=2000, fanout=4).collect()}
    assert got == {(7, "changed"), (8, "changed"), (50, "missing"), (900, "extra"), (901, "extra")}
    assert fixity.audit(a, a).count() == 0
    assert {r["status"] for r in fixity.audit(a, b.limit(0)).collect()} == {"missing"}
    assert fixity.audit(a.limit(0), b.limit(0)).count() == 0


def test_audit_of_odd_pages(spark):
    pages = spark.createDataFrame([(5, "u", "<p>"), (5, "u", "<p>"), (31, None, None), (77, "u", ""), (None, "u", "x")], "page_id long, url string, html string")
    got = {(r["page_id"], r["status"]) for r in fixity.audit_pages(pages).collect()}
    assert got == {(5, "changed"), (31, "missing"), (77, "extra")}


@pytest.mark.parametrize("texts_in_cell", [2_000, 7])
def test_alike_texts_are_linked(spark, monkeypatch, texts_in_cell):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "CELL_TEXTS", texts_in_cell)
    r = random.Random(12)
    texts = []
    for n, edits in ((100, 2), (300, 3), (300, 9), (600, 3), (40, 1), (100, 6)) * 5:
        words = [f"w{r.randrange(5_000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for k in r.sample(range(n), edits):
                other[k] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(other))
    hub = [f"h{k}" for k in range(200)]
    texts += [" ".join([*hub[:k], f"y{k}", *hub[k + 1 :]]) for k in range(0, 200, 8)] + [None, "", "one", "one"]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    group, alike = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or not (grams[i] or grams[j]) or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                alike += 1
                group = [group[j] if g == group[i] else g for g in group]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(5)
    kept = {d[0] for d in rows(dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, ""))}
    first = {g: min(i for i in range(len(texts)) if group[i] == g) for g in group}
    assert alike > 300 and kept == set(first.values())
