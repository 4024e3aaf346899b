import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search, vectorcells


def table(spark, seed, n, spread=0.1):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, spread) for x in heads[rng.randrange(12)]], i % 3) for i in range(n)]
    rows += [(n + i, r[1], 0) for i, r in enumerate(rows[:20])] + [(n + 50, None, 1)]  # ties and a null
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


@pytest.mark.parametrize(("seed", "k"), [(1, 1), (2, 10), (3, 40)])
def test_same_answer_as_a_scan(spark, tmp_path, seed, k):
    vectors, rows = table(spark, seed, 400)
    path = f"file://{tmp_path}/cells"
    vectorcells.build(vectors, path)
    known = vectors.where("embedding is not null")
    for query in (rows[5][1], [0.0] * 6, [9.0] * 6):
        for where in (None, F.col("label") == 2, F.col("label") == 9):
            near, read = vectorcells.knn(spark, path, query, k, where)
            assert near.columns == [*vectors.columns, "distance"]
            assert [(r.vec_id, r.distance) for r in near.collect()] == [(r.vec_id, r.distance) for r in search.knn(known, query, k, where).collect()]


def test_few_cells_are_read(spark, tmp_path):
    vectors, rows = table(spark, 4, 2000, 0.02)
    path = f"file://{tmp_path}/cells"
    cells = vectorcells.build(vectors, path)
    assert cells > 30
    _, read = vectorcells.knn(spark, path, rows[7][1], 5)
    assert read < cells / 2


def test_empty_and_small_tables(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorcells.build(none, f"file://{tmp_path}/none") == 0
    near, read = vectorcells.knn(spark, f"file://{tmp_path}/none", [0.0], 3)
    assert near.collect() == [] and read == 0
    two = spark.createDataFrame([(2, [1.0], 0), (1, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert vectorcells.build(two, f"file://{tmp_path}/two") == 1
    assert [r.vec_id for r in vectorcells.knn(spark, f"file://{tmp_path}/two", [0.0], 3)[0].collect()] == [1, 2]
