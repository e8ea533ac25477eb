"""Best-fit decreasing packing of documents into windows of fixed length.

Overlong documents are first cut into full windows. What is left of each document is shorter than a window, so best-fit
decreasing depends on nothing but how many remainders there are of each length: a table of at most 1,024 numbers. The plan
is made from that table alone, many windows at a time, with a segment tree over remaining capacity that finds the tightest
open window. Each document then finds its place in the plan by its number among the remainders of its length, which is
counted in buckets, so that no task sees all documents of a length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.llm.bpe import read_vocabulary
from flowgauge.llm.components import _stored

WINDOW = 1024
END_ID = 0
#: Documents of a bucket when documents are numbered, and the fewest buckets.
BUCKET_DOCUMENTS, MIN_BUCKETS = 100_000, 64
#: The fast encoder walks back over a run of white space and gives up on long ones; such texts go to the named library.
_LONG_SPACE = re.compile(r"\s{4096}")


class CapacityTree:
    """A segment tree over remaining capacities; finds the smallest one of at least a given size that has open windows."""

    def __init__(self, largest: int):
        self.size = 1 << largest.bit_length()
        self.held = [0] * (2 * self.size)

    def set(self, capacity: int, present: bool) -> None:
        at = capacity + self.size
        self.held[at] = int(present)
        while at > 1:
            at //= 2
            self.held[at] = self.held[2 * at] | self.held[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.held[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.held[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.held[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length up to ``window``.

    Rows ``length, first, count, sequence, per_window, offset``: pieces ``first .. first + count`` of that length, in order,
    go ``per_window`` to a window, from window ``sequence`` on, and start at ``offset`` there.
    """
    rows, open_windows, tree, n_windows = [], {}, CapacityTree(window), 0
    for length in sorted(counts, reverse=True):
        placed, total = 0, counts[length]
        while placed < total:
            left = total - placed
            capacity = tree.tightest(length)
            if capacity is None:
                # New windows: each takes as many pieces as fit, as it stays the tightest while it is open.
                per_window = min(left, window // length)
                n, first_window, offset = left // per_window, n_windows, 0
                n_windows += n
                capacity = window
            else:
                first_window, held = open_windows[capacity].pop()
                offset, per_window = window - capacity, min(left, capacity // length)
                n = min(held, left // per_window)
                if held > n:
                    open_windows[capacity].append((first_window + n, held - n))
                if not open_windows[capacity]:
                    tree.set(capacity, False)
            rows.append((length, placed, n * per_window, first_window, per_window, offset))
            placed += n * per_window
            rest = capacity - per_window * length
            if rest:
                open_windows.setdefault(rest, []).append((first_window, n))
                tree.set(rest, True)
    return rows


def _encoder(source: bytes):
    """Token ids of a text: by the fast encoder of the same vocabulary, or by the tokenizers library where that cannot."""
    import tiktoken
    from tokenizers import Tokenizer

    from flowgauge.llm.bpe import PATTERN, Vocabulary

    vocabulary = Vocabulary(source)
    special = set(vocabulary.special.values())
    ranks = {data: at for at, data in vocabulary.bytes_of.items() if at not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens=vocabulary.special)
    named = Tokenizer.from_str(source.decode())
    named.no_truncation()
    named.no_padding()

    def encode(text: str) -> np.ndarray:
        if _LONG_SPACE.search(text):
            return np.array(named.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def _measure(source: bytes, window: int):
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_encoder(source))
        for batch in batches:
            sizes, sums = [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(made[0](text or ""), END_ID).astype("<u4")
                sizes.append(len(ids))
                sums.append([zlib.crc32(ids[at : at + window].tobytes()) for at in range(0, len(ids), window)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "sums"],
            )

    return run


def measured_tokens(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """``doc_id, doc_tokens, sums``: tokens with the closing id, and the checksum of every piece of ``window`` ids."""
    return docs.select("doc_id", "text").mapInArrow(
        _measure(read_vocabulary(path), window), "doc_id long, doc_tokens long, sums array<long>"
    )


def _numbered(df: DataFrame, weight: Column, name: str, *key: str) -> DataFrame:
    """Adds to each row the sum of ``weight`` over the rows before it with the same key.

    Sums run within buckets of the key, and the few bucket totals are summed up separately.
    """
    ordered = Window.partitionBy(*key, "bucket").orderBy("doc_id", "doc_tokens", "sums").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*key, "bucket").agg(F.sum(weight).alias("_total"))
    starts = totals.select(*key, "bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = df.withColumn("_inside", F.coalesce(F.sum(weight).over(ordered), F.lit(0)))
    return inside.join(starts, [*key, "bucket"]).withColumn(name, F.col("_inside") + F.col("_start")).drop("_inside", "_start")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is its closing id alone; very long texts, of white space too, are cut into full windows; repeated rows
    are packed each; an empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash. Sequences are numbered from 0: full windows first.
    """
    measured = _stored(spark, measured_tokens(docs, path, window), "measured")
    n_buckets = max(MIN_BUCKETS, measured.count() // BUCKET_DOCUMENTS)
    measured = measured.withColumns(
        {
            "bucket": F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(n_buckets)).cast("int"),
            "full": F.floor(F.col("doc_tokens") / window).cast("long"),
            "rest": (F.col("doc_tokens") % window).cast("int"),
        }
    )
    n_full = measured.agg(F.sum("full")).first()[0] or 0
    counts = {r["rest"]: r["count"] for r in measured.where("rest > 0").groupBy("rest").count().collect()}  # under 1,024 rows
    rows = [(length, first, n, n_full + at, per, offset) for length, first, n, at, per, offset in plan(counts, window)]
    places = spark.createDataFrame(rows, "rest int, first long, n long, first_sequence long, per_window int, first_offset int")
    whole = _numbered(measured.where("full > 0").withColumn("one", F.lit(1)), F.col("full"), "before", "one")
    whole = whole.select("doc_id", "doc_tokens", "sums", "before", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("at", "_"))
    whole = whole.select(
        "doc_id", (F.col("at") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        F.get("sums", F.col("at")).alias("ids_crc32"), "doc_tokens", (F.col("before") + F.col("at")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = _numbered(measured.where("rest > 0"), F.lit(1), "number", "rest").join(F.broadcast(places), "rest")
    rest = rest.where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
    within = F.col("number") - F.col("first")
    rest = rest.select(
        "doc_id", (F.col("full") * window).alias("start"), F.col("rest").cast("long").alias("length"),
        F.get("sums", F.col("full").cast("int")).alias("ids_crc32"), "doc_tokens",
        (F.col("first_sequence") + F.floor(within / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (within % F.col("per_window")) * F.col("rest")).cast("long").alias("offset"),
    )
    return whole.unionAll(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
