import math
import random

import duckdb
import numpy as np
import pytest
from flowgauge.llm import hard_negatives as H
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL


def brute(rows, anchors, n_positives=5, n_negatives=10):
    """``rows`` are (id, label, vector); anchors are ids of one row each."""
    out = []
    for anchor in anchors:
        label, vector = next((label, v) for i, label, v in rows if i == anchor)
        score = lambda v: sum(a * b for a, b in zip(vector, v))
        near = sorted((-score(v), i) for i, other, v in rows if other == label and i != anchor)[:n_positives]
        for positive, positive_id in near:
            fit = sorted((-score(v), i) for i, other, v in rows if other != label and -30 * positive <= 100 * score(v) <= -90 * positive)
            out += [(anchor, positive_id, at + 1, i, -positive, -s) for at, (s, i) in enumerate(fit[:n_negatives])]
    return sorted(out)


def found(spark, rows, anchors, *k):
    vectors = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>").withColumns({"block": F.lit("own"), "row": F.lit("own")})
    return sorted(map(tuple, H.hard_negatives(spark, vectors, vectors.where(anchors), *k).collect()))


@pytest.mark.parametrize("spread,n,width", [(2, 200, 6), (50, 200, 20), (10**6, 150, 9), (3, 6, 3)])
def test_same_as_brute_force(spark, monkeypatch, spread, n, width):
    monkeypatch.setattr(H, "BLOCK_VECTORS", 37)
    monkeypatch.setattr(H, "GROUP_ANCHORS", 5)
    rng = random.Random(n + width)
    rows = [(at, rng.randint(0, 2), [rng.randint(-spread, spread) for _ in range(width)]) for at in range(n)]
    rows[0] = (0, 1, [0] * width)
    assert found(spark, rows, "vec_id % 7 = 0") == brute(rows, range(0, n, 7))
    assert found(spark, rows, "vec_id % 7 = 0", 2, 3) == brute(rows, range(0, n, 7), 2, 3)


def test_repeated_rows_and_short_vectors(spark):
    rows = [(1, 0, [4, 4]), (1, 0, [4, 4]), (2, 0, [10, 10]), (2, 0, [10, 10]), (3, 1, [5, 5]), (3, 1, [5, 5]), (4, 1, [6]), (5, 1, []), (6, 0, [])]
    assert found(spark, rows, "vec_id IN (1, 5)") == brute(rows, [1, 5])
    assert found(spark, rows, "false") == []
    assert found(spark, rows[:1], "true") == []


def test_rows_that_take_no_part(spark):
    rows = [(0, [0.5, -0.25], 1), (7, [1.0, 1.0], 9), (1, None, 1), (2, [1.0, None], 1), (3, [math.nan, 1.0], 1), (4, [math.inf, 1.0], 1), (5, [0.1], None), (None, [1.0], 1), (6, [-0.001], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vector", F.lit("own"))
    assert sorted(map(tuple, H.labelled_vectors(table).collect())) == [(0, 2, [128, -64]), (6, 3, [-1]), (7, 0, [256, 256])]


def test_bitmap_shrinks_before_the_last_dimension():
    rng = np.random.default_rng(1)
    columns = (rng.normal(size=(64, 3000)) * (256 * 0.7 ** np.arange(64))[:, None]).astype(np.int64)
    block = H.VerticalBlock(np.arange(3000), np.arange(3000) % 2, columns)
    anchor, sizes = columns[:, 10].copy(), []
    live, scores = block.scan(anchor, block.labels == 0, lambda low, high: (sizes.append(len(low)), high >= np.sort(low)[-5])[1])
    every = anchor @ columns
    assert set(np.argsort(-np.where(block.labels == 0, every, -(10**9)))[:5]) <= set(live) and (scores == every[live]).all()
    assert sizes[-1] < 200


def test_same_as_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    relation = connection.sql(H.SQL)
    want = sorted(relation.fetchall())
    assert want and sorted(map(tuple, H.query(spark, SMALL).select(relation.columns).collect())) == want
