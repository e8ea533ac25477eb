import math
import random

import duckdb
import numpy as np
import pytest
from flowgauge.llm import top_k
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL


def brute(rows, asked, k):
    out = []
    for q in asked:
        scored = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)
        out += [(q, at + 1, i, -s) for at, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread,n", [(2, 300), (40, 300), (1000, 90), (10**6, 50), (3, 7)])
def test_same_as_brute_force(spark, monkeypatch, spread, n):
    monkeypatch.setattr(top_k, "BLOCK_VECTORS", 64)
    rng = random.Random(n)
    rows = {i: [rng.randint(-spread, spread) for _ in range(6)] for i in range(n)}
    rows[5] = [0] * 6
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, vector array<long>")
    found = top_k.top_k(vectors, vectors.where(F.col("vec_id") % 5 == 0), 20)
    assert sorted(map(tuple, found.collect())) == brute(rows, range(0, n, 5), 20)


def test_stops_early():
    rng = np.random.default_rng(0)
    vectors = (rng.pareto(1.0, (4000, 3)) * 10).astype(int).astype(np.float64)
    lists = top_k.SortedLists(np.arange(4000), vectors)
    scored = []
    inner = lists.vectors

    class Watched(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    lists.vectors = inner.view(Watched)
    scores, ids = lists.search(np.array([5.0, 3.0, 1.0]), -1, 5)
    want = top_k._best(inner @ np.array([5.0, 3.0, 1.0]), np.arange(4000), 5)
    assert scores.tolist() == want[0].tolist() and ids.tolist() == want[1].tolist()
    assert sum(scored) < 2000


def test_edge_cases(spark):
    rows = [
        (0, [0.5, -0.25]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (20, [0.5, -0.25]), (6, [0.5, -0.25]),
        (6, [0.5, -0.25]), (None, [1.0, 1.0]), (7, []), (8, [-0.001, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("own"))
    vectors = top_k.whole_vectors(table)
    assert {r.vec_id for r in vectors.collect()} == {0, 20, 6, 7, 8}
    found = sorted(map(tuple, top_k.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()))
    assert [(q, i, s) for q, _, i, s in found if q == 0] == [(0, 6, 1280), (0, 6, 1280), (0, 20, 1280), (0, 7, 0), (0, 8, -32)]
    assert top_k.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_same_as_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    relation = connection.sql(top_k.SQL)
    assert sorted(map(tuple, top_k.query(spark, SMALL).select(relation.columns).collect())) == sorted(relation.fetchall())
