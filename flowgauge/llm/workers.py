"""Let Python workers import this package when it is run from a source folder."""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows and bytes that go to a Python worker at once. Texts are long, so Spark's default of 10,000 rows is too much.
BATCH_ROWS, BATCH_BYTES = 500, "2m"


def import_on_workers(spark: SparkSession) -> None:
    """Adds the source folder to the workers' path; on a cluster the package is installed or sent with ``--py-files``.

    Also bounds the batches that workers get.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def with_workers(query):
    """The same query, with the package importable on workers."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        import_on_workers(spark)
        return query(spark, *rest)

    return run
