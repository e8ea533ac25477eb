"""Exact inner-product search by the threshold algorithm over sorted lists per dimension.

Queries and candidates are cut in blocks, and every pair of blocks is one group: it sorts its candidates once per dimension
and serves its queries from these lists. A query walks all lists at once from the end that its sign favours, scores every
candidate it meets, and stops when the sum over the lists' present values, which bounds all candidates not met so far, is
below the k-th best score. When fewer candidates are left than the next step would touch, they are scored directly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
STEP_SHARE = 100  # the first step takes one hundredth of every list, each further one twice as much


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id, in order."""
    if len(scores) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class SortedLists:
    """Candidates with their ids, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)

    def search(self, query: np.ndarray, own_id: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best candidates but those with the query's id."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == own_id
        scores, ids = np.zeros(0, self.vectors.dtype), np.zeros(0, np.int64)
        left, depth, step = n - int(met.sum()), 0, max(1, n // STEP_SHARE)
        while left:
            if left <= step * (len(up) + len(down)) or not len(up) + len(down):
                rest = ~met
                found = (self.vectors @ query)[rest] if left * 4 > n else self.vectors[rest] @ query
                return _best(np.concatenate([scores, found]), np.concatenate([ids, self.ids[rest]]), k)
            end = min(n, depth + step)
            touched = np.zeros(n, bool)
            touched[self.order[n - end : n - depth, up]] = True
            touched[self.order[depth:end, down]] = True
            new = np.flatnonzero(touched & ~met)
            met[new] = True
            left -= len(new)
            scores, ids = _best(
                np.concatenate([scores, self.vectors[new] @ query]), np.concatenate([ids, self.ids[new]]), k
            )
            bound = self.vectors[self.order[n - end, up], up] @ query[up] + self.vectors[self.order[end - 1, down], down] @ query[down]
            if len(scores) == k and scores[-1] > bound:  # an equal score might still win by its id
                break
            depth, step = end, step * 2
        return scores, ids


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    rows = [np.asarray(row) for row in table["vector"].to_pylist()]
    matrix = np.zeros((len(rows), width), np.int64)
    for at, row in enumerate(rows):
        matrix[at, : len(row)] = row
    return matrix


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search_block(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    if not queries.num_rows or not candidates.num_rows:
        return _FOUND.empty_table()
    width = max(len(row) for table in (queries, candidates) for row in table["vector"].to_pylist())
    asked, offered = _matrix(queries, width), _matrix(candidates, width)
    # Whole numbers stay exact in the narrowest type that holds every partial sum.
    largest = int(np.abs(asked).max(initial=0)) * int(np.abs(offered).max(initial=0)) * width
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    lists = SortedLists(np.asarray(candidates["vec_id"]), offered.astype(kind))
    parts = []
    for query_id, query in zip(queries["vec_id"].to_pylist(), asked.astype(kind)):
        scores, ids = lists.search(query, query_id)
        parts.append((np.full(len(ids), query_id, np.int64), ids, scores.astype(np.int64)))
    return pa.table([np.concatenate(column) for column in zip(*parts)], schema=_FOUND)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector`` with every component as floor(64 x). Rows with a null id or vector, or with a null or non-finite
    component, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of ``vectors``, ties to the smaller id.

    Both tables have ``vec_id, vector`` (whole numbers); a shorter vector counts as filled up with zeros. Rows with the
    query's own id are no candidates; repeated candidates count each, repeated queries once. Empty tables give no rows.
    """
    queries = queries.groupBy("vec_id").agg(F.first("vector").alias("vector"))
    n_blocks = -(-max(1, vectors.count()) // BLOCK_VECTORS)
    n_groups = -(-max(1, queries.count()) // BLOCK_QUERIES)
    asked = queries.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int").alias("asked"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "vector",
    )
    offered = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("asked"),
        F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), "vec_id", "vector",
    )
    found = (
        asked.groupBy("asked", "block")
        .cogroup(offered.groupBy("asked", "block"))
        .applyInArrow(_search_block, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20."""
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))
