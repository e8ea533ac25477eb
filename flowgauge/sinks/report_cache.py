"""Reports kept on shared storage until their parameters or sources change."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.names import digest_key
from flowgauge.sinks.folders import exists


def source_version(spark: SparkSession, path: str) -> str:
    """Changes when a file below ``path`` is added, removed, renamed or rewritten; no file is opened.

    Sums of two hashes of every file's path, length and time: files may come in any order, and a file that is replaced
    by an older one of equal length counts as another.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    entry = ("path", "length", "modificationTime")
    hashes = [F.sum(F.xxhash64(F.lit(seed), *entry).cast("decimal(20,0)")) for seed in (1, 2)]
    row = files.agg(F.count(F.lit(1)).alias("files"), *(part.alias(f"hash{at}") for at, part in enumerate(hashes))).first()
    return f"{row['files']}:{row['hash0']}:{row['hash1']}"


def cache_key(spark: SparkSession, parameters: Mapping[str, object]) -> str:
    """Key of a report; every parameter that shapes it, its project included, belongs in."""
    text = "\n".join(f"{name}={parameters[name]!r}" for name in sorted(parameters))
    return spark.range(1).select(digest_key(F.lit(text))).first()[0].replace("+", "-")


def cached(
    spark: SparkSession, root: str, parameters: Mapping[str, object], build: Callable[[], DataFrame]
) -> DataFrame:
    """Read the report if it is there, else build, write and read it."""
    path = f"{root.rstrip('/')}/key={cache_key(spark, parameters)}"
    # Spark leaves this mark when a write was committed.
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
