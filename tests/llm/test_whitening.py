"""Whitening against dense linear algebra."""

import numpy as np
import pytest

from leafmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors, k=16):
    """n, sums, x and whitened coordinates by the covariance matrix itself."""
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / len(fit))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return len(fit), fit.sum(0), x, (x - fit.mean(0)) @ axes / np.sqrt(values), values, np.trace(c.T @ c / len(fit))


def same(rows, vectors, k=16):
    n, sums, x, white, values, trace = dense(vectors, k)
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-7
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-9
    assert [r["deviation"] for r in rows[::k]] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]
    assert np.allclose([r["explained"] for r in rows[:k]], values / trace, rtol=1e-9)


def test_supplied_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whitening.whiten(rows, whitening.train(rows)).collect()
    same(got, [r["embedding"] for r in rows.orderBy("vec_id").collect()])


@pytest.mark.parametrize("dim, decay, most", [(20, 1.0, 512), (100, 1.0, 512), (100, 0.8, 48), (70, 1.0, 64)])
def test_flat_and_steep_spectra(spark, monkeypatch, dim, decay, most):
    """Narrow blocks, restarts and spaces as wide as the vectors give the same axes."""
    monkeypatch.setattr(whitening, "MOST_COLUMNS", most)
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, dim)) * 3 * decay ** np.arange(dim)).astype(np.float32)
    vectors[350:] = vectors[:50]  # repeated vectors count once
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    model = whitening.train(df, components=5)
    same(whitening.whiten(df, model).collect(), vectors, 5)
    assert model.residual <= whitening.TOLERANCE * model.variances[0]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-inf, 1.0]), (7, [1.0]), (8, [1.0, 2.0]), (8, [3.0, -1.0]), (None, [1.0, 2.0]), (9, [0.5, 7.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", component int, x string")
    got = whitening.whiten(df, whitening.train(df)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (8, 1), (8, 1), (8, 2), (8, 2), (9, 1), (9, 2)]
    assert {r["n"] for r in got} == {3}
    for few in (df.limit(0), df.where("embedding is null"), df.where("vec_id = 7")):  # no variance at all
        found = whitening.whiten(few, whitening.train(few))
        assert found.count() == 0 and found.columns == whitening.whiten(df, whitening.train(df)).columns


def test_a_line_has_one_component(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], SCHEMA)
    got = whitening.whiten(df, whitening.train(df)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


def test_large_numbers_stay_exact():
    x = np.array([[2**40, 5], [-(2**40), 7]])
    n, sums = 3 * 10**7, [12345678901234567, 3]
    assert whitening.away(x, n, sums).tolist() == [[n * int(a) - s for a, s in zip(row, sums)] for row in x]
