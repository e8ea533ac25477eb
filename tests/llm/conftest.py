import random

import pytest
from pyspark.sql import functions as F

from flowgauge.llm.workers import import_on_workers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers(spark):
    import_on_workers(spark)


@pytest.fixture
def documents(spark):
    """A table of documents from (id, text) pairs, with further columns whose names operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if not extra:
            return df
        for name in ("kept", "n_words", "severity", "spans", "rep", "component", "bucket", "slot", "ids", "_text", "_row"):
            df = df.withColumn(name, F.lit("own"))
        return df

    return make


@pytest.fixture
def prose():
    """Made-up prose of so many words from a seed."""

    def make(seed, n):
        rng = random.Random(seed)
        words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(n)]
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)

    return make
