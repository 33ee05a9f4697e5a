from fractions import Fraction

import numpy as np
import pyarrow as pa

from scriptorium.llm import whitening as wh

SF = "/root/testdata/sf0.01"


def test_eigen_is_exact_for_small_values_too():
    r = np.random.default_rng(1)
    a = r.standard_normal((40, 12)) * 10.0 ** -(np.arange(12) / 2)
    v = a.T @ a
    values, vectors = wh.eigen(v)
    want = np.linalg.svd(a, compute_uv=False) ** 2  # relative to themselves, unlike eigvalsh
    assert np.allclose(values, want, rtol=1e-9)
    assert np.allclose(vectors @ vectors.T, np.eye(12), atol=1e-12)
    for e, u in zip(values[:6], vectors):
        assert np.abs(v @ u - e * u).max() < 1e-14 * values[0]


def test_rank():
    r = np.random.default_rng(2)
    a = r.standard_normal((50, 3)) @ r.standard_normal((3, 7))
    values, vectors = wh.eigen(a.T @ a)
    assert len(values) == 3 and vectors.shape == (3, 7)
    assert wh.eigen(np.zeros((4, 4)))[0].size == 0
    assert np.allclose(wh.eigen(np.diag([1.0, 5.0, 3.0]))[0], [5, 3, 1])


def brute(vectors):
    x = np.array(sorted({tuple(np.floor(256 * np.array(v, np.float64)).astype(int).tolist()) for v in vectors}))
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, sums, values[::-1], vectors.T[::-1], np.trace(y.T @ y / n)


def test_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, sums, values, vectors, trace = brute([r.embedding for r in rows])
    got = {}
    for r in wh.op12_embedding_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == {r.vec_id for r in rows}
    sign = None
    for r in rows:
        own = sorted(got[r.vec_id], key=lambda g: g.component)
        x = [int(np.floor(256 * np.float64(c))) for c in r.embedding]
        assert [g.component for g in own] == [1, 2, 3, 4] and {g.n for g in own} == {n}
        assert {g.deviation for g in own} == {sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))}
        want = (np.array(x) - sums / n) @ vectors[:4].T / np.sqrt(values[:4])
        have = np.array([g.whitened for g in own])
        sign = np.sign(want * have) if sign is None else sign
        assert np.allclose(sign * have, want, atol=1e-9)
        assert np.allclose([g.explained for g in own], values[:4] / trace, rtol=1e-9)
        assert all(g.identity_error < 1e-9 for g in own)


def test_odd_vectors(spark):
    two = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(0, 0), (1, 0), (0, 3), (1, 3), (1, 3), (2, 7)])]
    rows = two + [(None, [2.0, 7.0]), (20, None), (21, []), (22, [1.0, None]), (23, [float("nan"), 1.0]), (24, [float("inf"), 1.0]), (25, [1e30, 1.0])]
    rows += [(30, [1.0, 2.0, 3.0]), (31, [1.0, 2.0, 3.0]), (40, [1.0] * 5), (41, [2.0] * 5)]  # one vector; rank 1
    df = spark.createDataFrame([(*r, 9) for r in rows], "i long, v array<double>, component int").repartition(5)
    got = sorted(((r.id, r.component, r.n) for r in wh.whiten(df, "i", "v").collect()), key=str)
    assert got == sorted([(i, c, 5) for i, _ in two for c in (1, 2)] + [(None, c, 5) for c in (1, 2)] + [(i, 1, 2) for i in (40, 41)], key=str)
    assert wh.whiten(df.limit(0), "i", "v").count() == 0
    five = [r.whitened for r in wh.whiten(df, "i", "v").where("id >= 40").collect()]
    assert np.allclose(sorted(five), [-1, 1])


def test_sums_are_exact_for_large_entries(spark):
    rows = [(i, [float(2**39 + 7 * i), float(-(2**38) + i * i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(3)
    got = {r.id: r for r in wh.whiten(df, "i", "v").collect()}
    x = [[Fraction(int(256 * c)) for c in v] for _, v in rows]
    v = [[sum((a[i] - sum(b[i] for b in x) / 9) * (a[j] - sum(b[j] for b in x) / 9) for a in x) / 9 for j in (0, 1)] for i in (0, 1)]
    e = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in v]))
    assert np.isclose(max(r.explained for r in got.values()), e[1] / e.sum()) or np.isclose(got[0].explained, e[0] / e.sum())
    want = [sum((9 * a[j] - sum(b[j] for b in x)) ** 2 for j in (0, 1)) for a in x]
    assert [got[i].deviation for i in range(9)] == [int(w) for w in want]


def test_deviation_beyond_a_long():
    model = wh.Model(2**31, np.array([0], object), np.eye(1), np.ones(1), 1.0)
    assert wh.deviations(np.array([[1], [2**3]]), model) == [2**62, None]
    assert [len(r) for r, _ in wh.whole_entries(pa.array([[1.0], None, [1.0, 2.0]]))] == [1, 1]
