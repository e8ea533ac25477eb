"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.session import scratch_path

MAX_ROUNDS = 60


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("u", "m")).distinct()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)`` that is not itself the smallest of its component.

    Edges are undirected; loops and repeats do no harm. Each round is written to the shared scratch folder, so that a
    lost executor costs one round at most. Only two numbers per round reach the driver.
    """
    current = _stored(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        current = _stored(spark, _small_star(_large_star(current)), "edges")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
