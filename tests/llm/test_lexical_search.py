import math
import random
import re

import duckdb
import numpy as np
import pytest
from flowgauge.llm import lexical_search
from flowgauge.llm.lexical_search import ImpactLists, nra, ranked_search
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Scores every document for every item straight from the definition."""
    cut = [(doc_id, terms(text)) for doc_id, text in docs]
    cut = [(doc_id, found) for doc_id, found in cut if found]
    n, length = len(cut), sum(len(found) for _, found in cut)
    rows = []
    for item in sorted({item for item, _ in items if item is not None}):
        asked = [term for text in sorted({text or "" for at, text in items if at == item}) for term in terms(text)]
        scored = []
        for doc_id, found in cut:
            m = 75 + (25 * len(found) * n) // length
            score = 0
            for term in asked:
                if tf := found.count(term):
                    df = sum(term in other for _, other in cut)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        rows += [(item, at + 1, doc_id, -score) for at, (score, doc_id) in enumerate(sorted(scored)[:k])]
    return rows


def corpus(seed, n_docs, n_words, vocabulary):
    rng = random.Random(seed)
    words = [f"w{at}" for at in range(vocabulary)]
    weights = [1 / (1 + at) for at in range(vocabulary)]
    return [(at, " ".join(rng.choices(words, weights, k=rng.randint(1, n_words)))) for at in range(n_docs)]


def test_same_as_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 100)
    monkeypatch.setattr(lexical_search, "GROUP_ITEMS", 3)
    docs = corpus(1, 120, 30, 60)
    items = [(at + 500, text) for at, (_, text) in enumerate(corpus(2, 9, 12, 70))]
    found = ranked_search(spark, documents(docs), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, found.collect())) == brute(docs, items, 7)


def test_edge_cases(spark, documents):
    long_text = "alpha " * 300_000 + "omega"
    docs = [
        (1, "Alpha beta"), (2, "alpha BETA"), (2, "alpha BETA"), (3, None), (4, ""), (5, " .,-\x7f\x00 "), (None, "alpha alpha"), (7, long_text),
        (-8, "ÄPFEL äpfel 12 Alpha-beta"), (9, "x" * 1_000_000), (2, "beta"),
    ]
    items = [(1, "alpha, alpha BETA"), (1, "alpha, alpha BETA"), (2, None), (3, ""), (None, "alpha"), (4, "nothing here"), (5, "ÄPFEL äpfel"), (6, "x" * 1_000_000), (7, "omega"), (1, "beta")]
    items_table = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit("own"), "doc_id": F.lit(0)})
    for k in (2, 20):
        found = ranked_search(spark, documents(docs).withColumn("term", F.lit("own")), items_table, k)
        assert sorted(map(tuple, found.collect())) == brute(docs, items, k)
    nothing = documents([]).where("false")
    assert ranked_search(spark, nothing, items_table).count() == 0
    assert ranked_search(spark, documents(docs), items_table.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_nra_keeps_order_and_ties(seed, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_READ", 1 + seed % 4)
    monkeypatch.setattr(lexical_search, "READ_GROWTH", 2)
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(int(rng.integers(1, 6))):
        docs = rng.choice(n, int(rng.integers(1, n + 1)), replace=False)
        values = rng.integers(1, 4, len(docs))  # few values: many ties
        order = np.lexsort((docs, -values))
        times = int(rng.integers(1, 3))
        lists.append((docs[order], values[order], times))
        total[docs] += values * times
    docs, scores = nra(lists, n, k)
    want = [at for at in sorted(range(n), key=lambda at: (-total[at], at)) if total[at] > 0][:k]
    assert docs.tolist() == want and scores.tolist() == total[want].tolist()


def test_nra_leaves_list_ends_unread():
    """With uneven impacts the tails of the lists are not read."""
    rng = np.random.default_rng(3)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(len(range(*at.indices(len(self)))))
            return np.asarray(self)[at]

    lists = []
    for _ in range(3):
        values = np.sort((rng.pareto(0.8, 20_000) * 100).astype(np.int64) + 1)[::-1]
        docs = np.arange(20_000)
        lists.append((docs, values.view(Watched), 1))
    docs, scores = nra(lists, 20_000, 5)
    assert docs.tolist() == [0, 1, 2, 3, 4] and sum(read) < 10_000


def test_items_of_many_terms_see_documents_in_parts(monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(50), 4)
    terms_of = np.concatenate([rng.choice(10, 4, replace=False) for _ in range(50)])
    impacts = rng.integers(1, 9, 200)
    ids, scores = ImpactLists(terms_of, rows, rows * 3, impacts).search(list(range(12)), [1] * 12, 6)
    total = np.bincount(rows, impacts)
    want = sorted(range(50), key=lambda at: (-total[at], at))[:6]
    assert ids.tolist() == [3 * at for at in want] and scores.tolist() == total[want].tolist()


def test_same_as_sql(spark):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    relation = connection.sql(lexical_search.SQL)
    assert sorted(map(tuple, lexical_search.query(spark, SMALL).select(relation.columns).collect())) == sorted(relation.fetchall())
