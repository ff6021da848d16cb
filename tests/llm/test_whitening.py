"""Whitening against the eigenvectors of the covariance matrix, with odd rows."""

import numpy as np
import pytest

from trackweave.llm import whitening
from trackweave.llm.queries import read

SCHEMA = "vec_id long, embedding array<float>, x string, Whitened int"


def compared(got, expected):
    """Rows by id and component; whitened up to one sign for each component."""
    rows = sorted((tuple(r)[:6] for r in got), key=str)
    assert [r[:4] for r in rows] == [r[:4] for r in sorted(expected, key=str)]
    for k in {r[1] for r in rows}:
        a, b = (np.array([r[4] for r in sorted(x, key=str) if r[1] == k]) for x in (rows, expected))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        a, b = ({r[5] for r in x if r[1] == k} for x in (rows, expected))
        assert len(a) == 1 and abs(a.pop() / b.pop() - 1) < 1e-9


def test_as_by_brute_force(spark):
    r = np.random.default_rng(5)
    data = [(i, (r.standard_normal(9) * np.arange(1, 10)).tolist(), "x", 1) for i in range(300)]
    data += data[:40] + [(900 + i, data[0][1], "x", 1) for i in range(500)]
    odd = [(2_000, None, "x", 1), (2_001, [], "x", 1), (2_002, [float("nan")] * 9, "x", 1), (2_003, [float("inf")] + [0.0] * 8, "x", 1), (2_004, [None] + [1.0] * 8, "x", 1), (2_005, [1.0, 2.0], "x", 1)]
    got = whitening.whiten(spark.createDataFrame(data + odd, SCHEMA).repartition(5)).collect()
    single = [(i, np.float32(v).tolist()) for i, v, *_ in data]
    compared(got, whitening.brute_force(single))
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-10


def test_query(spark):
    from trackweave.llm.queries import op12_lanczos_whitening

    sf = "/root/testdata/sf0.01"
    got = op12_lanczos_whitening(spark, sf).collect()
    compared(got, whitening.brute_force([(r[0], r[1]) for r in read(spark, sf, "embeddings").select("vec_id", "embedding").collect()]))


def test_without_variance_or_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1), (None, [1.0, 2.0], "x", 1)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "x", 1) for i in range(5)], SCHEMA)).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_large_numbers_and_null_ids(spark):
    got = whitening.whiten(spark.createDataFrame([(None, [1e12, 1.0], "x", 1), (1, [-1e12, 5.0], "x", 1), (2, [3.0, 3e38], "x", 1), (3, [3.0, 7.0], "x", 1)], SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {None, 1, 2, 3} and all(np.isfinite(r["whitened"]) for r in got) and any(r["deviation"] is None for r in got)


@pytest.mark.parametrize("values", [[9.0, 9.0, 9.0, 9.0, 9.0, 9.0], [5.0, 5.0, 4.0, 1e-3, 1e-3, 0.0], [100.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0], [3.0]])
def test_repeated_singular_values_are_found(values):
    r = np.random.default_rng(2)
    d = len(values)
    left, right = np.linalg.qr(r.standard_normal((50, d)))[0], np.linalg.qr(r.standard_normal((d, d)))[0]
    x = left * values @ right.T
    s, v = whitening.bidiagonalised(lambda w, lefts: ((u := x @ w) @ x, (x @ lefts).T @ u, u @ u), d, sum(np.square(values)))
    expected = [a for a in sorted(values, reverse=True)[:4] if a]
    assert np.allclose(s, expected, rtol=1e-10) and np.allclose(v.T @ v, np.eye(len(s)), atol=1e-12) and np.allclose(np.linalg.norm(x @ v, axis=0), s, rtol=1e-9)
