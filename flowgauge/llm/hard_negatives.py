"""Hard negatives by a vertical scan with branch and bound over decomposed vectors.

Vectors are stored by blocks and, within a block, by dimension, with the least and greatest value of each. An anchor reads
the dimensions of a block in the order of its own magnitudes, largest first. After a few dimensions, the part read so far and
what the rest can add at least and at most give an interval for the score of every candidate; candidates whose interval
decides against them leave the bitmap, and only the others are read on, up to their exact scores.

Two passes use this scan: the positives of every anchor (the best rows of its label), and then, for the window of scores that
each positive defines, the best rows of other labels inside it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.llm.components import _stored

POSITIVES, NEGATIVES = 5, 10
SCALE = 256
LEAST_SHARE, MOST_SHARE = 30, 90  # of the positive's score, in hundredths
BLOCK_VECTORS, BLOCK_CELLS, GROUP_ANCHORS = 4096, 1 << 21, 512
STEP = 8  # dimensions between two looks at the bounds


class VerticalBlock:
    """Vectors by dimension: ``columns[d]`` holds component d of all vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low, self.high = columns.min(axis=1, initial=0), columns.max(axis=1, initial=0)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Indices and exact scores of the candidates in the bitmap that ``keep(lower, upper)`` never excludes."""
        anchor = anchor[: len(self.columns)]
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        # Whole numbers are exact in doubles up to 2^53; products run faster there.
        largest = int(np.abs(anchor).max(initial=0)) * max(int(self.high.max(initial=0)), -int(self.low.min(initial=0))) * max(1, len(order))
        kind = np.float64 if largest < 1 << 53 else np.int64
        factors = anchor[order].astype(kind)
        ends = factors * self.low[order].astype(kind), factors * self.high[order].astype(kind)
        rest_least, rest_most = (np.concatenate([np.cumsum(pick(*ends)[::-1])[::-1], [0]]) for pick in (np.minimum, np.maximum))
        live = np.flatnonzero(bitmap)
        partial = np.zeros(len(live), kind)
        for start in range(0, len(order), STEP):
            dimensions = order[start : start + STEP]
            columns = self.columns[dimensions] if len(live) == len(self.ids) else self.columns[np.ix_(dimensions, live)]
            partial += factors[start : start + STEP] @ columns.astype(kind)
            end = min(len(order), start + STEP)
            kept = keep(partial + rest_least[end], partial + rest_most[end])
            if not kept.all():
                live, partial = live[kept], partial[kept]
            if not len(live):
                break
        return live, partial.astype(np.int64)

    def best(self, live: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k highest scores, ties to the smaller id, in order."""
        return np.lexsort((self.ids[live], -scores))[:k]

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of a label, without rows of the anchor's id."""

        def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            if len(lower) <= k:
                return np.ones(len(lower), bool)
            return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

        live, scores = self.scan(anchor, (self.labels == label) & (self.ids != anchor_id), keep)
        chosen = self.best(live, scores, k)
        return self.ids[live[chosen]], scores[chosen]

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int = NEGATIVES) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, ids and scores of the k best rows of other labels inside it."""

        def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(lower), bool)
            for least, most in windows:
                possible = (upper >= least) & (lower <= most)
                sure = lower[(lower >= least) & (upper <= most)]
                if len(sure) > k:
                    possible &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
                kept |= possible
            return kept

        live, scores = self.scan(anchor, self.labels != label, keep)
        found = []
        for least, most in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            chosen = inside[self.best(live[inside], scores[inside], k)]
            found.append((self.ids[live[chosen]], scores[chosen]))
        return found


def window_of(positive_score: int) -> tuple[int, int]:
    """The least and greatest whole score s with 30 * positive <= 100 * s <= 90 * positive; empty below 0."""
    return -(-LEAST_SHARE * positive_score // 100), MOST_SHARE * positive_score // 100


_BLOCK = "block int, ids binary, labels binary, columns binary"


def _decomposed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The vectors of a block as one row, by dimension; shorter vectors are filled up with zeros."""
    vectors = table["vector"].to_pylist()
    columns = np.zeros((max(map(len, vectors)), len(vectors)), np.int64)
    for at, vector in enumerate(vectors):
        columns[: len(vector), at] = vector
    cells = [np.asarray(table["vec_id"]).astype(np.int64), np.asarray(table["label"]).astype(np.int64), columns]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["block", "ids", "labels", "columns"])


def _read_block(table: pa.Table) -> VerticalBlock:
    ids, labels, cells = (np.frombuffer(table[name][0].as_py(), np.int64) for name in ("ids", "labels", "columns"))
    return VerticalBlock(ids, labels, cells.reshape(-1, len(ids)))


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _together(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    if not parts:
        return schema.empty_table()
    return pa.table([pa.array(np.concatenate(column), field.type) for column, field in zip(zip(*parts), schema)], schema=schema)


def _find_positives(k: int):
    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = []
        block = _read_block(blocks) if blocks.num_rows else None
        for anchor_id, label, vector in zip(*(anchors[name].to_pylist() for name in ("anchor_id", "label", "vector"))) if block else ():
            ids, scores = block.positives(anchor_id, label, np.array(vector, np.int64), k)
            parts.append((np.full(len(ids), anchor_id), ids, scores))
        return _together(parts, _POSITIVE)

    return run


def _find_negatives(k: int):
    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = []
        block = _read_block(blocks) if blocks.num_rows else None
        names = ("anchor_id", "label", "vector", "positives")
        for anchor_id, label, vector, positives in zip(*(anchors[name].to_pylist() for name in names)) if block else ():
            windows = {at["place"]: window_of(at["positive_score"]) for at in positives}
            windows = {place: window for place, window in windows.items() if window[0] <= window[1]}
            found = block.negatives(label, np.array(vector, np.int64), list(windows.values()), k)
            parts += [(np.full(len(ids), anchor_id), np.full(len(ids), place), ids, scores) for place, (ids, scores) in zip(windows, found)]
        return _together(parts, _NEGATIVE)

    return run


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` with every component as floor(256 x), and the next label for ids divisible by 7.

    Rows with a null id, label or vector, or with a null or non-finite component, are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return given.select("vec_id", label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"))


def hard_negatives(spark: SparkSession, vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``vec_id, label, vector``.

    Scores are 64-bit inner products; higher ones come first, ties by smaller id. The positives of an anchor are its best rows
    of the same label and another id. For each, the best rows of other labels with a score of 30 to 90 hundredths of the
    positive's; a negative positive score has none. Shorter vectors count as filled up with zeros. Repeated rows count each
    as positives and negatives; of anchors with the same id the one with the smallest label, then vector, is used. Other
    columns are not read; empty tables give no rows.
    """
    vectors = vectors.select("vec_id", "label", "vector")
    size = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    per_block = max(1, min(BLOCK_VECTORS, BLOCK_CELLS // max(1, size[1] or 1)))
    n_blocks = -(-max(1, size[0]) // per_block)
    # Repeated ids are dealt apart by a number of the row.
    row = F.xxhash64("vec_id", "row")
    dealt = vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(row, F.lit(n_blocks)).cast("int"))
    blocks = _stored(spark, dealt.select("block", "vec_id", "label", "vector").groupBy("block").applyInArrow(_decomposed, _BLOCK), "blocks")
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("held"))
    anchors = _stored(spark, one.select(F.col("vec_id").alias("anchor_id"), "held.label", "held.vector"), "anchors")
    n_groups = -(-max(1, anchors.count()) // GROUP_ANCHORS)

    def scanned(asked: DataFrame, found, schema: str) -> DataFrame:
        group = F.pmod(F.xxhash64("anchor_id"), F.lit(n_groups)).cast("int").alias("anchor_group")
        asked = asked.select(group, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), *asked.columns)
        offered = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("anchor_group"), *blocks.columns)
        return offered.groupBy("anchor_group", "block").cogroup(asked.groupBy("anchor_group", "block")).applyInArrow(found, schema)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = scanned(anchors, _find_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = _stored(spark, near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    held = near.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "positive_score")).alias("positives"))
    found = scanned(anchors.join(held, "anchor_id"), _find_negatives(negatives), "anchor_id long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .join(near, ["anchor_id", "place"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id,
        list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i]))::BIGINT AS score
    FROM v a JOIN v ON a.vec_id <> v.vec_id OR a.label <> v.label WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND {LEAST_SHARE} * p.score <= 100 * s.score AND 100 * s.score <= {MOST_SHARE} * p.score
    WHERE p.place <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the positives of every row whose id is divisible by 100."""
    vectors = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives(spark, vectors, vectors.where(F.col("vec_id") % 100 == 0))
