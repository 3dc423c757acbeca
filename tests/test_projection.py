"""Matrix-free principal components against a dense decomposition."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from parley.operators import projection as P


def dense(points, k):
    centred = points - points.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(points))
    return values[::-1][:k], vectors[:, ::-1][:, :k], centred


def table(spark, points, sparse, parts=3):
    size = points.shape[1]
    rows = [(i, Vectors.sparse(size, {int(j): float(p[j]) for j in np.flatnonzero(p)}) if sparse else Vectors.dense(p))
            for i, p in enumerate(points)]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(parts)


def check(spark, points, k, sparse):
    df = table(spark, points, sparse)
    found = P.principal_components(df, k)
    values, vectors, centred = dense(points, k)
    assert np.allclose(found.variances, values, rtol=1e-7, atol=1e-12)
    assert np.allclose(found.mean, points.mean(0))
    assert np.allclose(np.abs((found.directions * vectors).sum(0)), 1, atol=1e-6)
    got = {r["id"]: [r[f"pc{i + 1}"] for i in range(k)] for r in P.projected(df, found).collect()}
    assert np.allclose([got[i] for i in range(len(points))], centred @ found.directions, atol=1e-9)


def test_sparse_rows_with_a_slowly_falling_spectrum(spark):
    rng = np.random.default_rng(1)
    points = np.where(rng.random((200, 300)) < 0.05, rng.random((200, 300)), 0) * (1 / np.arange(1, 301) ** 0.3)
    check(spark, points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9), 2, True)


@pytest.mark.parametrize("sparse", [True, False])
def test_dense_and_sparse_vectors_agree(spark, sparse):
    check(spark, np.random.default_rng(2).standard_normal((60, 12)) * np.linspace(3, 1, 12) + 5, 3, sparse)


def test_starts_anew_from_the_best_directions(spark, monkeypatch):
    monkeypatch.setattr(P, "KEPT", 12)
    monkeypatch.setattr(P, "BLOCK", 2)
    check(spark, np.random.default_rng(3).standard_normal((80, 60)) * np.linspace(3, 1, 60), 2, True)


def test_fewer_directions_than_asked_rows_without_entries_and_without_vector(spark):
    rows = [(0, Vectors.sparse(3, [], [])), (1, Vectors.sparse(3, [1], [2.0])), (2, None), (3, Vectors.dense([0.0, 4.0, 0.0]))]
    df = spark.createDataFrame(rows, ["id", "features"])
    found = P.principal_components(df, 2)
    assert np.allclose(found.variances, [8 / 3, 0]) and np.allclose(found.directions[:, 0], [0, 1, 0])
    got = {r["id"]: r["pc1"] for r in P.projected(df, found).collect()}
    assert got[2] is None and np.allclose([got[0], got[1], got[3]], [-2, 0, 2])


def test_equal_rows_have_no_variance(spark):
    found = P.principal_components(table(spark, np.ones((5, 4)), False), 2)
    assert np.allclose(found.variances, 0, atol=1e-15)


def test_no_vectors_is_an_error(spark):
    df = spark.createDataFrame([(0, Vectors.dense([1.0]))], ["id", "features"]).limit(0)
    with pytest.raises(ValueError, match="no vectors"):
        P.principal_components(df, 2)
