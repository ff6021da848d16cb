"""Tries against all prefixes counted, with odd rows, shards of every size and long conversations."""

import random

import pytest

from trackweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, Key string"


def made(seed=3):
    r = random.Random(seed)
    rows = []
    for conv in range(-12, 70):
        for turn in range(r.randint(1, 12)):
            rows.append((conv * r.choice([1, 1, 1, 3]), turn, r.choice(["user", "bot", None]), r.choice(["a", "b", "é", "", None]), 1, "x"))
    for conv in (200, 203, 204, 1000):  # long ones that share their beginnings
        rows += [(conv, t, "user", str(t % 7) if t < 150 + conv % 5 * 9 else f"{conv} {t}", 1, "x") for t in range(150 + conv % 5 * 30)]
    rows += [(c, t, "user", f"same {t}", 1, "x") for c in range(300, 340) for t in range(64)]  # a piece that is just full
    rows += [(400, None, "user", "n", 1, "x"), (400, None, None, "m", 1, "x"), (400, 0, "user", "z", 1, "x"), (401, 1, "user", "x" * 100_000, 1, "x"), (None, 1, "user", "no id", 1, "x")]
    rows += [(402, 5, "user", "tie", 1, "x")] * 3 + [(402, 5, "user", "other", 1, "x")]
    rows += [(c, t, "user", f"hot {t}", 1, "x") for c in range(500, 560) for t in range(5)]
    r.shuffle(rows)
    return rows


def rows(df):
    assert df.columns == prefix_trie.RESULT
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [200_000, 300, 1])
def test_as_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    table = spark.createDataFrame(made(), SCHEMA).repartition(5)
    assert rows(prefix_trie.rebuilt_trie(table)) == sorted(prefix_trie.brute_force([x[:4] for x in made()]), key=str)


def test_empty_table_and_one_turn(spark):
    assert rows(prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows(prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x")], SCHEMA))) == []
    one = [(1, 0, "a", "b", 1, "x")]
    assert rows(prefix_trie.rebuilt_trie(spark.createDataFrame(one, SCHEMA))) == sorted(prefix_trie.brute_force([x[:4] for x in one]), key=str)


def test_tree_is_balanced_and_whole():
    r = random.Random(1)
    sequences = sorted({tuple(r.choices(range(50), k=r.randint(0, 6))) for _ in range(3_000)})
    tree = prefix_trie.TernaryTree()
    ends = {tree.insert([0, *sequences[k]]): sequences[k] for k in prefix_trie.medians(len(sequences))}
    order, up, depth = tree.traversed()
    assert len(ends) == len(sequences) and len(order) == len({s[:d] for s in sequences for d in range(len(s) + 1)})
    for node, s in ends.items():
        path = []
        while node:
            path.append(tree.symbol[node])
            node = up[node]
        assert tuple(reversed(path)) == (0, *s)
    chain, node = 0, tree.equal[tree.equal[0]]
    while node:  # the symbols after the root's: 50, so some six deep when balanced
        chain, node = chain + 1, tree.high[node]
    assert chain <= 12
