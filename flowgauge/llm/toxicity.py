"""Cumulative-link ordinal regression: severity grades of a text from sparse word features.

One weight vector is shared by all ordered thresholds: P(grade <= k) = logistic(threshold_k - w.x). Features are whole words
and their first four, five and six bytes, so that forms of a word that were never seen still count through its stem; a
feature weighs by its share of the document's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.components import _stored
from flowgauge.llm.words import _BYTE_LOWER, _powers, Words, mixed, word_chunks

#: Labelled rows of each class that the model is fitted on, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 2500
GRADES = 4
STEMS = (4, 5, 6)
#: A feature is used if so many sampled documents have it and its smoothed log odds are at least this far from zero.
MIN_DOCS, MIN_LOG_ODDS = 5, 1.0
FLAGGED_LOG_ODDS = 3.0
SHARE = 50.0
PENALTY, STEPS, RATE = 1e-4, 400, 0.05
REJECT_FROM = 0.5  # probability of any grade above 0
_TABLE_BITS = 20

_MARKS = np.zeros(256, bool)
_MARKS[[at for at in range(33, 128) if not chr(at).isalnum()]] = True


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes with a row per word, the text of each word, and the words of each text."""
    starts, ends = words.starts.copy(), words.ends.copy()
    open_ = np.arange(len(starts))
    while len(open_):  # marks around a word do not belong to it
        open_ = open_[(starts[open_] < ends[open_]) & _MARKS[words.data[np.minimum(starts[open_], len(words.data) - 1)]]]
        starts[open_] += 1
    open_ = np.arange(len(starts))
    while len(open_):
        open_ = open_[(starts[open_] < ends[open_]) & _MARKS[words.data[ends[open_] - 1]]]
        ends[open_] -= 1
    rows = words.rows()
    if not len(starts):
        return np.zeros((0, 1 + len(STEMS)), np.uint64), rows, np.diff(words.first)
    powers, inverse = _powers(1 << max(20, int(len(words.data)).bit_length()))
    total = np.empty(len(words.data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_LOWER[words.data] * powers[: len(words.data)], out=total[1:])
    columns = [total[ends] - total[starts]]
    columns += [np.where(ends - starts > stem, total[np.minimum(starts + stem, ends)] - total[starts], 0) for stem in STEMS]
    kinds = np.arange(1, 2 + len(STEMS), dtype=np.uint64)
    hashes = mixed(np.stack(columns, axis=1) * inverse[starts][:, None] + kinds * np.uint64(0x9E3779B97F4A7C15))
    # A word no longer than the stem has no such feature, a word of marks alone has none at all.
    absent = np.stack([starts >= ends, *(ends - starts <= stem for stem in STEMS)], axis=1)
    hashes[absent] = 0
    return hashes, rows, np.diff(words.first)


@dataclass
class Model:
    """Weights by feature hash and the ordered thresholds between grades."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of each grade, a row per text."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def _scores(model: Model):
    tables: dict[str, np.ndarray] = {}

    def weight_of(hashes: np.ndarray) -> np.ndarray:
        if not tables:
            slots = (model.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            size = 1 << _TABLE_BITS
            tables.update(known=np.zeros(size, np.uint64), weight=np.zeros(size), extra=np.zeros(0, np.int64))
            order = np.argsort(np.abs(model.weights), kind="stable")  # features that share a slot: the strongest is looked up there
            tables["known"][slots[order]] = model.hashes[order]
            tables["weight"][slots[order]] = model.weights[order]
            tables["extra"] = np.flatnonzero(tables["known"][slots] != model.hashes)
        slots = (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        found = np.where(tables["known"][slots] == hashes, tables["weight"][slots], 0.0)
        for at in tables["extra"]:
            found[hashes == model.hashes[at]] = model.weights[at]
        found[hashes == 0] = 0.0
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(batch.schema.get_field_index("text"))):
                hashes, rows, counts = _features(words)
                total = np.bincount(rows, weight_of(hashes).sum(axis=1), minlength=words.n_rows)
                grades = model.probabilities(SHARE * total / np.maximum(counts, 1))
                part = batch.slice(words.first_row, words.n_rows)
                severity = np.where(counts > 0, grades @ np.arange(GRADES), 0.0)
                toxic = (counts > 0) & (1 - grades[:, 0] >= REJECT_FROM)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(severity), pa.array(toxic)], names=[*part.schema.names, "severity", "toxic"]
                )

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_chunks(batch.column(1)):
            hashes, _, counts = _features(words)
            cells, numbers = [], []
            for start, end in zip(words.first[:-1], words.first[1:]):
                found, times = np.unique(hashes[start:end], return_counts=True)
                cells.append(found.tobytes())
                numbers.append(times.astype(np.int32).tobytes())
            toxic = batch.column(0).slice(words.first_row, words.n_rows)
            yield pa.RecordBatch.from_arrays(
                [toxic, pa.array(counts, pa.int64()), pa.array(cells, pa.binary()), pa.array(numbers, pa.binary())],
                names=["toxic", "n_words", "hashes", "times"],
            )


_BUCKET_BITS = 6
_HELD = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("clean", pa.binary()), ("toxic", pa.binary())])
_FREQUENCY = pa.schema([("hash", pa.int64()), ("clean", pa.int64()), ("toxic", pa.int64())])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled documents of each class that have a feature, counted per batch, a row per bucket of hashes."""
    for batch in batches:
        cells = batch.column(1).to_pylist()
        toxic = np.repeat(np.asarray(batch.column(0)), [len(cell) // 8 for cell in cells])
        known, at = np.unique(np.frombuffer(b"".join(cells), np.uint64), return_inverse=True)
        counts = [np.bincount(at[toxic == kind], minlength=len(known)).astype(np.int64) for kind in (0, 1)]
        ends = np.searchsorted(known >> np.uint64(64 - _BUCKET_BITS), np.arange((1 << _BUCKET_BITS) + 1, dtype=np.uint64))
        rows = [
            (bucket, *(part[a:b].tobytes() for part in (known, *counts)))
            for bucket, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
        ]
        columns = list(zip(*rows)) if rows else [()] * len(_HELD)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _HELD)], schema=_HELD)


def _frequent(table: pa.Table) -> pa.Table:
    """Features of a bucket that ``MIN_DOCS`` documents have, with their documents of each class."""
    known, at = np.unique(_numbers(table["hashes"], np.uint64), return_inverse=True)
    clean, toxic = (np.zeros(len(known), np.int64) for _ in range(2))
    np.add.at(clean, at, _numbers(table["clean"], np.int64))
    np.add.at(toxic, at, _numbers(table["toxic"], np.int64))
    kept = (clean + toxic >= MIN_DOCS) & (known != 0)
    return pa.table([known[kept].view(np.int64), clean[kept], toxic[kept]], schema=_FREQUENCY)


def _of_known(known: np.ndarray):
    """Sampled documents with their features among the known ones, as places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers = [], []
            for hashes, times in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                hashes = np.frombuffer(hashes, np.uint64)
                place = np.searchsorted(known, hashes)
                found = known[np.minimum(place, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
                places.append(place[found].astype(np.int32).tobytes())
                numbers.append(np.frombuffer(times, np.int32)[found].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())],
                names=["toxic", "n_words", "places", "times"],
            )

    return run


def _numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All numbers that the binary cells of a column hold, in order."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(row, column, value, grade, n_features, steps=STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model for sparse rows, by penalized maximum likelihood (Adam)."""
    n = len(grade)
    share = np.array([np.mean(grade <= k) for k in range(GRADES - 1)]).clip(0.02, 0.98)
    start = np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 1e-3)
    parameters = np.concatenate([np.zeros(n_features), start[:1], np.log(gaps)])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        weights, low, gaps = parameters[:n_features], parameters[n_features], np.exp(parameters[n_features + 1 :])
        edges = np.concatenate([[-np.inf], low + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, weights[column] * value, minlength=n)
        upper, lower = _logistic(edges[grade + 1] - score), _logistic(edges[grade] - score)
        chance = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_edge = (np.bincount(grade, up, minlength=GRADES)[:-1] - np.bincount(grade, down, minlength=GRADES)[1:]) / n
        slope = np.bincount(column, value * ((down - up) / n)[row], minlength=n_features)
        later = np.cumsum(by_edge[::-1])[::-1]
        gradient = -np.concatenate([slope - 2 * PENALTY * weights, later[:1], later[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters = parameters - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    low, gaps = parameters[n_features], np.exp(parameters[n_features + 1 :])
    return parameters[:n_features], low + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on at most ``SAMPLE_PER_CLASS`` labelled documents of each class; the bound does not follow the input.

    Labels say only toxic or not. Grade 0 is clean; toxic documents get grades 1 to 3 by thirds of their share of words
    that are far more frequent in toxic documents of the sample.
    """
    by_class = [
        labels.where(F.col("toxic") == at).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        for at in (0, 1)
    ]
    chosen = by_class[0].unionAll(by_class[1])
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sampled = pairs.mapInArrow(_sampled, "toxic int, n_words long, hashes binary, times binary").where("n_words > 0")
    sampled = _stored(docs.sparkSession, sampled, "toxicity-sample")
    size = dict(sampled.groupBy("toxic").count().collect())
    if len(size) < 2:
        return Model()
    # Features are counted and chosen before any document comes to the driver; most are in a few documents only.
    counted = (
        sampled.select("toxic", "hashes")
        .mapInArrow(_held, "bucket int, hashes binary, clean binary, toxic binary")
        .groupBy("bucket")
        .applyInArrow(_frequent, "hash long, clean long, toxic long")
        .toArrow()
    )
    known = np.asarray(counted["hash"]).view(np.uint64)
    order = np.argsort(known)
    known, inside = known[order], [np.asarray(counted[name])[order] for name in ("clean", "toxic")]
    odds = np.log((inside[1] + 0.5) / (size[1] + 1)) - np.log((inside[0] + 0.5) / (size[0] + 1))
    used = np.abs(odds) >= MIN_LOG_ODDS
    known, odds = known[used], odds[used]
    chosen = sampled.mapInArrow(_of_known(known), "toxic int, n_words long, places binary, times binary").toArrow()
    toxic, n_words = np.asarray(chosen["toxic"]), np.asarray(chosen["n_words"]).astype(np.float64)
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.asarray(pc.binary_length(chosen["places"])) // 4)
    column, times = _numbers(chosen["places"], np.int32), _numbers(chosen["times"], np.int32)
    flagged = odds >= FLAGGED_LOG_ODDS
    heat = np.bincount(row, flagged[column] * times, minlength=len(toxic)) / n_words
    cuts = np.quantile(heat[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, heat, "left"), 0)
    weights, thresholds = fit_ordinal(row, column, SHARE * times / n_words[row], grade, len(known))
    return Model(known, weights, thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with ``severity`` (expected grade, 0 to 3) and ``toxic``.

    Null, empty and blank texts have severity 0. Columns of the input with these names are replaced. Repeated rows get equal
    results; a model without features (no labels, or of one class) finds nothing. Very long texts are scored whole; an empty
    table gives an empty table.
    """
    carried = docs.drop("severity", "toxic")
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema)
    return carried.mapInArrow(_scores(model), f"{columns}severity double, toxic boolean")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` scored by a model fitted on the labels of the folder."""
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxic_documents(spark, docs, sf_dir).select("doc_id", F.round("severity", 6).alias("severity"), "toxic")
