"""Whitening against numpy's eigenvectors, inertia against eigenvalues."""

import numpy as np
import pytest

from vigil.llm import whitening as wh

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["plain", "no diagonal", "whole numbers", "low rank"])
def test_inertia_counts_signs(kind):
    rng = np.random.default_rng(3)
    for n in range(1, 14):
        a = rng.standard_normal((n, n))
        a = a + a.T
        if kind == "no diagonal":
            np.fill_diagonal(a, 0)
        if kind == "whole numbers":
            a = np.round(2 * a) + np.eye(n) / 3
        if kind == "low rank":
            b = rng.integers(-3, 4, (n, max(1, n // 2)))
            a = (b @ b.T - 0.5 * np.eye(n)).astype(float)
        e = np.linalg.eigvalsh(a)
        if np.abs(e).min() > 1e-9:
            assert wh.inertia(a) == ((e < 0).sum(), 0, (e > 0).sum())
    assert wh.inertia(np.zeros((3, 3))) == (0, 3, 0)


def eigen(x):
    v = np.cov(np.array(x, float).T, bias=True)
    e, q = np.linalg.eigh(np.atleast_2d(v))
    return e[::-1], q[:, ::-1], v


def test_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    x = np.array([np.floor(64 * np.array(r.embedding, float)) + 1_000_000 for r in rows])
    e, q, v = eigen(x)
    want = (x - x.mean(0)) @ q[:, :32] / np.sqrt(e[:32])
    found = wh.op12_embedding_whitening(spark, DIR).toPandas()
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    assert got.shape == want.shape
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    assert (found.n == len(rows)).all() and found.identity_error.max() < 1e-10
    share = found.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(share / (e[:32] / e.sum()) - 1).max() < 1e-9
    n, sums = len(rows), [int(s) for s in x.sum(0)]
    far = {r.vec_id: sum((n * int(c) - s) ** 2 for c, s in zip(own, sums)) for r, own in zip(rows, x)}
    assert dict(zip(found.vec_id, found.deviation)) == far


@pytest.mark.parametrize("values", [[5.0] * 9 + [1.0] * 4, [2.0**-i for i in range(30)], [1e6, 1.0, 1.0 + 1e-9, 1e-3], [7.0]])
def test_clusters_are_counted_and_none_is_missed(spark, values):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    matrix = spark.sparkContext.broadcast(v)
    top = float(np.abs(v).sum(1).max()) * 1.001
    found = wh.intervals(spark, matrix, top, top * 1e-14, 32)
    assert sum(x.count for x in found) == len(values)
    e, u = wh.feast(spark, v, found)
    assert np.abs(np.sort(e) - np.sort(values)).max() <= 1e-12 * max(values)
    assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ u - u * e).max() <= 1e-11 * max(values)


def test_rows_edges_and_extra_columns(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(c) for c in rng.standard_normal(5)] + [3.0], i, 1.0) for i in range(40)]
    bad = [(50, None, 1, 1.0), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1.0), (52, [float("nan")] * 6, 1, 1.0), (53, [float("inf")] * 6, 1, 1.0), (54, [], 1, 1.0), (55, [1.0, 2.0], 1, 1.0),
           (56, [1e300] * 6, 1, 1.0)]
    repeat = [good[3], good[3], (None, good[4][1], None, None)]
    df = spark.createDataFrame(good + bad + repeat, "vec_id long, embedding array<double>, n long, whitened double").repartition(4)
    kept = [r[1] for r in good + repeat]
    x = np.array([np.floor(64 * np.array(r)) + 1_000_000 for r in kept])
    e, q, _ = eigen(x)
    got = wh.whiten(df, components=32).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5]  # the sixth dimension is constant
    assert len(got) == 5 * len(kept) and (got.n == len(kept)).all() and got.identity_error.max() < 1e-10
    want = np.abs((x - x.mean(0)) @ q[:, :1] / np.sqrt(e[0])).ravel()
    assert np.allclose(np.sort(np.abs(got[got.component == 1].whitened)), np.sort(want), atol=1e-9)
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 55 or vec_id = 50")):
        assert wh.whiten(none).count() == 0


def test_deviation_is_exact_or_null():
    n, x = 10, np.array([[2**40, 1], [2**31, -(2**31)], [3, 4]])
    sums = [5, 7]
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert wh.deviations(x, n, sums) == [w if w < 2**63 else None for w in want]
    assert np.allclose(wh.centred(x, n, sums), x - np.array(sums) / n)
