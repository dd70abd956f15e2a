"""Whitening: exact covariance, components and whitened values against a slow reading in fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from oppflow.llm.queries import QUERIES
from oppflow.llm.whitening import covariance, whiten


def slow(vectors, scale=1024, shift=100_000):
    """Centred values in units of a power of two, exact deviations, and the covariance of the former."""
    x = [[math.floor(Fraction(c) * scale) + shift for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[a] for r in x) for a in range(dim)]
    z = [[n * r[a] - s[a] for a in range(dim)] for r in x]
    cov = [[Fraction(sum(r[a] * r[b] for r in z), n**3) for b in range(dim)] for a in range(dim)]
    unit = max(max(map(abs, r)) for r in cov)
    root = Fraction(2) ** ((int(unit).bit_length() + 1) // 2)  # values divided by it have covariances of about 1
    z = [[float(Fraction(v, n) / root) for v in r] for r in z]
    exact = [sum((n * r[a] - s[a]) ** 2 for a in range(dim)) for r in x]
    return np.array(z), exact, np.array([[float(v / root**2) for v in r] for r in cov])


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string")


@pytest.mark.parametrize("size", [1.0, 1e-3, 3e5, 1e30, 1e300])
def test_equals_fractions(spark, size):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(40, 5)) * [5, 4, 3, 2, 1] + [0, 7, -3, 0, 100]) * size
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(data)]
    got = whiten(vectors_of(spark, rows, "double"), components=3).collect()
    z, deviations, cov = slow([r[1] for r in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = np.zeros((40, 3))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 40 and r.deviation_exact == str(deviations[r.vec_id])
        assert r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 2**63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert 0 <= r.identity_error < 1e-6
    assert len(got) == 120
    np.testing.assert_allclose(white.T @ white / 40, np.eye(3), atol=1e-9)
    # Projecting the exact values gives the same up to the sign of a component.
    exact = z @ vectors[:, :3] / np.sqrt(values[:3])
    np.testing.assert_allclose(white * np.sign((white * exact).sum(axis=0)), exact, atol=1e-8)


def test_polarisation_gives_every_covariance():
    rng = np.random.default_rng(1)
    y = rng.integers(-50, 50, size=(30, 6)).astype(object)
    squares = [(y[:, a] ** 2).sum() for a in range(6)]
    squares += [((y[:, a] + y[:, b]) ** 2).sum() for a in range(6) for b in range(a + 1, 6)]
    got, unit = covariance(30, [int(v) for v in y.sum(axis=0)], dict(enumerate(map(int, squares))))
    np.testing.assert_allclose(got * unit**2, np.cov(y.astype(float).T, bias=True), rtol=1e-13, atol=1e-12)


def test_rows_that_take_no_part(spark):
    rows = [
        (1, [1.0, 2.0], "a"), (2, [2.0, 1.0], None), (2, [2.0, 1.0], None), (None, [0.0, 5.0], "c"), (4, None, "d"),
        (5, [1.0, None], "e"), (6, [float("nan"), 1.0], "f"), (7, [float("inf"), 1.0], "g"), (8, [], "h"), (9, [1.0], "i"),
    ]
    got = whiten(vectors_of(spark, rows), keep=["vec_id", "n"]).toDF(
        "vec_id", "extra", "component", "n", "deviation", "digits", "whitened", "explained", "error"
    ).collect()
    assert sorted((r.vec_id or 0, r.component, r.extra) for r in got) == [
        (0, 1, "c"), (0, 2, "c"), (1, 1, "a"), (1, 2, "a"), (2, 1, None), (2, 1, None), (2, 2, None), (2, 2, None),
    ]
    assert {r.n for r in got} == {4}


def test_without_variance(spark):
    same = whiten(vectors_of(spark, [(1, [3.0, 4.0], "a"), (2, [3.0, 4.0], "a")])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(None, None, None, 0)] * 4
    flat = whiten(vectors_of(spark, [(1, [3.0, 4.0], "a"), (2, [5.0, 4.0], "a")])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in flat) == [
        (1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)
    ]
    assert {r.identity_error for r in flat} == {0.0}


def test_empty_table(spark):
    got = whiten(vectors_of(spark, []))
    assert got.columns[:4] == ["vec_id", "component", "n", "deviation"] and got.count() == 0


def test_query_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [r for r in table if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    z, deviations, cov = slow([r.embedding for r in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    exact = z @ vectors / np.sqrt(values)
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, sf_dir).collect()}
    assert len(got) == 8 * len(rows)
    white = np.array([[got[r.vec_id, k].whitened for k in range(1, 9)] for r in rows])
    np.testing.assert_allclose(white * np.sign((white * exact).sum(axis=0)), exact, atol=1e-7)
    assert [got[r.vec_id, 1].deviation for r in rows] == deviations
    np.testing.assert_allclose([got[rows[0].vec_id, k].explained for k in range(1, 9)], values / np.trace(cov), rtol=1e-9)


def test_the_same_for_every_partitioning(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one, other = (sorted(map(tuple, whiten(df.repartition(k)).collect())) for k in (1, 7))
    assert one == other
