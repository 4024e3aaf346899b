import numpy as np
import pytest

from lodestrata.operators import projection

SCHEMA = "vec_id long, embedding array<float>"


def test_picture_equals_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 3)) * [5, 3, 1.5]) @ rng.normal(size=(3, 6)) + rng.normal(size=(300, 6)) * 0.1 + 7
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], SCHEMA).repartition(5)
    n, mean, covariance = projection.moments(df)
    assert n == 300 and np.allclose(mean, x.mean(0), atol=1e-5) and np.allclose(covariance, np.cov(x.T.astype(float), bias=True), atol=1e-4)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    rows, explained = projection.picture(df)
    assert explained == pytest.approx(values[::-1][:3] / values.sum(), abs=2e-4)
    got = {r.vec_id: (r.x, r.y, r.z) for r in rows.collect()}
    assert len(got) == 300
    for k, name in enumerate("xyz"):
        v = vectors[:, ::-1][:, k]
        along = (x - x.mean(0)) @ (v * np.sign(v[np.abs(v).argmax()]))
        plain = (along - along.min()) / (along.max() - along.min()) * 2 - 1
        assert np.allclose([got[i][k] for i in range(300)], plain, atol=2e-3), name


def test_few_and_flat_vectors(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (3, None)], SCHEMA)
    rows, explained = projection.picture(two)
    assert rows.collect() == [] and explained == []
    assert projection.picture(two.limit(0))[0].collect() == []
    flat = spark.createDataFrame([(i, [1.0 * i, 0.0, 4.0]) for i in range(4)], SCHEMA)
    rows, explained = projection.picture(flat)
    assert explained == [1.0, 0.0, 0.0] and [(r.x, r.y, r.z) for r in rows.orderBy("vec_id").collect()] == [(-1.0, 0, 0), (-0.3333, 0, 0), (0.3333, 0, 0), (1.0, 0, 0)]
