"""Ranked lexical search by NRA: impact-sorted lists read in order only, with score intervals per document.

Steps, each a Spark job:

1. The items' terms are counted and numbered. Documents are cut into terms in Arrow batches; a bitmap of fixed size over the
   checksums of asked terms drops most others there, and a join by the term itself decides.
2. Corpus counts give the weight of each term and, with the length of a document, the impact of every posting.
3. Documents are dealt into blocks by a number of their own, so a term that every document holds is spread over all blocks.
   A block sorts its lists by impact and answers every item: a round reads each list further, adds to the lower ends of the
   score intervals, and takes the next unread impact of each list as what an unseen posting can add at most. Documents whose
   upper end cannot reach the k-th lower one leave. Reading goes on until no other document can enter, ties included, and
   the scores of the k are final. No posting is looked up out of order.
4. The best of the blocks are merged.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.llm.components import _stored

K = 20
#: Bytes of UTF-8: digits, letters once A-Z are lower case, and everything beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bits of the bitmap (at most this power of two), postings of a block, items of a group, cells of a table of seen postings.
BITMAP_BITS, BLOCK_POSTINGS, GROUP_ITEMS, CELLS = 20, 1 << 19, 1024, 1 << 25
FIRST_READ, READ_GROWTH = 128, 4


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term, as UTF-8."""
    return Counter(_TERM.findall((text or "").encode().lower()))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, term.decode(), n) for item, text in zip(*(c.to_pylist() for c in batch.columns)) for term, n in term_counts(text).items()]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        kinds = (pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["item_id", "term", "repeats"])


_COUNTED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])


def _document_terms(bitmap: bytes, bits: int):
    """Postings of terms that may be asked for; a row without a term gives a batch's number of documents (tf) and terms (n)."""
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32 = zlib.crc32
        for batch in batches:
            rows, ids, lengths, terms, counts = [], [], [], [], []
            n_documents = n_terms = 0
            for row, doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                found = term_counts(text)
                if not found:
                    continue
                n = found.total()
                n_documents, n_terms = n_documents + 1, n_terms + n
                kept = [term for term in found if bitmap[(at := crc32(term) & mask) >> 3] >> (at & 7) & 1]
                terms += kept
                counts += [found[term] for term in kept]
                rows += [row] * len(kept)
                ids += [doc_id] * len(kept)
                lengths += [n] * len(kept)
            columns = rows + [None], ids + [None], lengths + [n_terms], [t.decode() for t in terms] + [None], counts + [n_documents]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)

    return run


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best of documents ``0 .. n``, scores above 0, ties to the smaller number.

    A list has document numbers, their impacts in descending order, and how often the impacts count.
    """
    heads = np.array([values[0] * times for _, values, times in lists], np.int64)
    lower, seen = np.zeros(n, np.int64), np.zeros((len(lists), n), bool)
    read, depth = [0] * len(lists), FIRST_READ
    live, wanted = np.arange(n), np.arange(len(lists))
    while True:
        for at in wanted:
            docs, values, times = lists[at]
            part = slice(read[at], depth)
            lower[docs[part]] += values[part] * times
            seen[at, docs[part]] = True
            read[at] = min(depth, len(docs))
            heads[at] = values[depth] * times if depth < len(docs) else 0
        scores = lower[live]
        upper = scores + heads @ ~seen[:, live]
        best = np.flatnonzero(scores > 0)
        if len(best) > k:
            best = best[scores[best] >= np.partition(scores[best], len(best) - k)[len(best) - k]]
        best = best[np.lexsort((live[best], -scores[best]))[:k]]
        least, last = (scores[best[-1]], live[best[-1]]) if len(best) == k else (0, -1)
        able = (upper > least) | ((upper == least) & (live <= last))
        others = able.copy()
        others[best] = False
        if not others.any() and (upper[best] == scores[best]).all():
            return live[best], scores[best]
        live = live[able]
        wanted = np.flatnonzero((heads > 0) & ~seen[:, live].all(axis=1))
        depth *= READ_GROWTH


class ImpactLists:
    """The postings of a block; for each term its documents by falling impact. Documents are numbered by ascending id."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, ids: np.ndarray, impacts: np.ndarray):
        every, first, at = np.unique(rows, return_index=True, return_inverse=True)
        by_id = np.lexsort((every, ids[first]))
        self.ids = ids[first][by_id]
        number = np.empty(len(every), np.int64)
        number[by_id] = np.arange(len(every))
        order = np.lexsort((number[at], -impacts, terms))
        terms, self.docs, self.impacts = terms[order], number[at][order], impacts[order]
        cuts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1], [True]))) if len(terms) else np.zeros(1, int)
        self.spans = {int(terms[a]): slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])}

    def search(self, terms: list[int], repeats: list[int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents for terms that count ``repeats`` times each."""
        asked = [(self.spans[term], times) for term, times in zip(terms, repeats) if term in self.spans]
        ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = max(1, min(len(self.ids), CELLS // max(1, len(asked))))  # an item of very many terms sees fewer documents at once
        for low in range(0, len(self.ids) if asked else 0, width):
            lists = [(self.docs[span], self.impacts[span], times) for span, times in asked]
            if width < len(self.ids):
                inside = [(docs >= low) & (docs < low + width) for docs, _, _ in lists]
                lists = [(docs[kept] - low, values[kept], times) for kept, (docs, values, times) in zip(inside, lists) if kept.any()]
            if lists:
                docs, found = nra(lists, min(width, len(self.ids) - low), k)
                ids.append(self.ids[docs + low])
                scores.append(found)
        every, total = np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((every, -total))[:k]
        return every[order], total[order]


_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_block(k: int):
    def run(postings: pa.Table, items: pa.Table) -> pa.Table:
        if not postings.num_rows or not items.num_rows:
            return _FOUND.empty_table()
        lists = ImpactLists(*(np.asarray(postings[name]) for name in ("term_no", "row", "doc_id", "impact")))
        parts = []
        for item, terms, repeats in zip(*(items[name].to_pylist() for name in ("item_id", "terms", "repeats"))):
            ids, scores = lists.search(terms, repeats, k)
            parts.append((np.full(len(ids), item, np.int64), ids, scores))
        return pa.table([np.concatenate(column) for column in zip(*parts)], schema=_FOUND)

    return run


def _bitmap(terms: DataFrame, n_terms: int) -> tuple[bytes, int]:
    """A bit for the checksum of every asked term; at most 2^20 numbers reach the driver, however many terms there are."""
    bits = min(BITMAP_BITS, max(10, (16 * n_terms).bit_length()))
    table = np.zeros(1 << bits, bool)
    places = terms.select(F.crc32("term").bitwiseAND((1 << bits) - 1).cast("int").alias("at")).distinct().toArrow()
    table[np.asarray(places["at"])] = True
    return np.packbits(table, bitorder="little").tobytes(), bits


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item with a score above 0, ties to the smaller id.

    Every row of ``docs`` (``doc_id, text``) is a document of its own, repeated rows and rows of equal id too; rows with a null
    id count in the corpus statistics but are not returned. Rows of ``items`` (``item_id, text``) with the same id are one
    item of all their different texts; rows with a null id are left out. Null and empty texts, and texts without a term, have
    none; very long texts are used whole. Other columns are not read; empty tables give no rows.
    """
    texts = items.where("item_id IS NOT NULL").select("item_id", "text").distinct()
    counted = texts.mapInArrow(_item_terms, "item_id long, term string, repeats long")
    asked = _stored(spark, counted.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")), "asked")
    terms = asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_no"))
    terms = _stored(spark, terms, "terms")
    bitmap, bits = _bitmap(terms, terms.count())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = rows.mapInArrow(_document_terms(bitmap, bits), "row long, doc_id long, n long, term string, tf long")
    found = found.join(terms, "term", "left").where("term IS NULL OR term_no IS NOT NULL").select("row", "doc_id", "n", "term_no", "tf")
    found = _stored(spark, found, "postings")
    totals = found.where("term_no IS NULL").agg(F.sum("tf"), F.sum("n")).first()
    n_documents, n_terms = totals[0] or 0, totals[1] or 0
    postings = found.where("term_no IS NOT NULL")
    n_blocks = -(-max(1, postings.count()) // BLOCK_POSTINGS)
    n_groups = -(-max(1, asked.select("item_id").distinct().count()) // GROUP_ITEMS)
    group = F.pmod(F.xxhash64("item_id"), F.lit(n_groups)).cast("int").alias("item_group")
    asked = asked.join(terms, "term").select("item_id", "term_no", "repeats", group)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_documents + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = postings.groupBy("term_no").agg(F.count(F.lit(1)).alias("df")).select("term_no", weight.alias("w"))
    groups = asked.groupBy("term_no").agg(F.collect_set("item_group").alias("item_groups"))
    weights = _stored(spark, weights.join(groups, "term_no"), "weights")
    length = f"(75 + (25 * n * {n_documents}L) div {max(1, n_terms)}L)"
    impacts = (
        postings.where("doc_id IS NOT NULL")
        .join(weights, "term_no")
        .withColumn("impact", F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 12 * {length}))"))
        .where("impact > 0")
        .select(
            F.explode("item_groups").alias("item_group"), F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"),
            "term_no", "row", "doc_id", "impact",
        )
    )
    items = asked.groupBy("item_group", "item_id").agg(F.collect_list(F.struct("term_no", "repeats")).alias("held"))
    items = items.select(
        "item_group", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "item_id",
        F.col("held.term_no").alias("terms"), F.col("held.repeats").alias("repeats"),
    )
    best = (
        impacts.groupBy("item_group", "block")
        .cogroup(items.groupBy("item_group", "block"))
        .applyInArrow(_search_block(k), "item_id long, doc_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CUT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PATTERN}')"
SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_CUT} AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, r, len(terms)::BIGINT AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
p AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
q AS (SELECT item_id, unnest({_CUT}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
x AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= {K}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked_search(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
