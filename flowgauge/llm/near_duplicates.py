"""Exact n-gram Jaccard join by prefix trees, at any size of the groups of near copies.

Steps, each a Spark job over packed rows:

1. Every text becomes the set of hashes of its five-word shingles. Texts with equal sets are one *set* from here on.
2. A set is of interest only if enough of its smallest hashes occur in another set as well (prefix filter with several
   required hits, which is exact). Most of the corpus ends here.
3. The remaining sets are put in one global order, rare shingles last, from counts over all remaining sets. Shingles of one
   set only are just counted.
4. Sets that share a shingle among their rarest form candidate components; only such sets can be similar.
5. Each component, or each pair of blocks of a large one, is stored as a prefix tree. A depth-first walk carries the
   overlap with all probing sets at once, so sets with a common start share that work, and leaves a subtree when no probe
   can reach the required overlap with what remains.
6. The links found make the final components.

Shingles are compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.components import _stored, connected_components
from flowgauge.llm.words import Words, mixed, word_chunks

N = 5
#: Similarity as a fraction: links have overlap * NEED_BELOW >= NEED_ABOVE * (size + size), i.e. a Jaccard index of 3/4.
NEED_ABOVE, NEED_BELOW = 3, 7
#: Postings per counting task and sets per block; they bound memory and change no result.
POSTINGS, BLOCK_SETS, BUNDLE_ROWS, CELLS, SEGMENT_BYTES = 100_000, 128, 128, 1 << 23, 1 << 18
_PLACES = mixed(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)


def least_overlap(size):
    """Shingles that a partner of a set of this size must share: three quarters, rounded up."""
    return -(-3 * size // 4)


def _shingle_sets(words: Words) -> list[np.ndarray]:
    """For each text, its distinct shingle hashes in ascending order."""
    hashes = words.hashes(lower=True)
    counts = np.diff(words.first)
    if len(hashes) >= N:
        span = len(hashes) - N + 1
        rolled = np.zeros(span, np.uint64)
        for at in range(N):
            rolled += hashes[at : at + span] * _PLACES[at]
        rolled = mixed(rolled)
    sets = []
    for start, count in zip(words.first, counts):
        if count >= N:
            found = np.sort(rolled[start : start + count - N + 1])
            sets.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif count:
            short = (hashes[start : start + count] * _PLACES[:count]).sum(dtype=np.uint64)
            sets.append(mixed(np.array([short + np.uint64(count)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _hits(size):
    """Required hits that a set of this size counts on in its own prefix."""
    return np.maximum(1, size // 8)


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, prefix binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_chunks(batch.column(1)):
            sizes, ones, twos, prefixes = [], [], [], []
            for found in _shingle_sets(words):
                size = len(found)
                key = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(size)
                ones.append((key & (2**64 - 1)) - 2**63)
                twos.append((key >> 64) - 2**63)
                prefixes.append(found[: size - least_overlap(size) + int(_hits(size))].tobytes() if size else b"")
            ids = batch.column(0).slice(words.first_row, words.n_rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(prefixes, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "prefix"],
            )


def _numbers(column, kind) -> np.ndarray:
    """All numbers that the binary cells of a column hold, in order."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _grouped(keys: np.ndarray):
    """The order that sorts keys, and the bounds of equal runs."""
    order = np.argsort(keys, kind="stable")
    kept = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1], [True]))) if len(keys) else np.zeros(1, int)


def _by_bucket(tokens: np.ndarray, bits: int, *others: np.ndarray) -> Iterator[tuple]:
    """Rows ``bucket, tokens, others...`` with the tokens of each bucket packed."""
    order, cuts = _grouped((tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32))
    packed = [part[order] for part in (tokens, *others)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield int(packed[0][start] >> np.uint64(64 - bits)), *(part[start:end].tobytes() for part in packed)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_POSTING = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("reps", pa.binary()), ("counted", pa.binary())])
_HIT = pa.schema([("rep", pa.int64()), ("hits", pa.int64())])
_LOCAL = 1 << 30  # buckets from here on hold counts, not tokens


def _post(bits: int):
    """Postings of prefixes. A token of several sets in a batch is counted here and posted once, marked as counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = np.repeat(np.asarray(batch.column(0)), [len(cell) // 8 for cell in batch.column(1).to_pylist()])
            tokens = _numbers(batch.column(1), np.uint64)
            if not len(tokens):
                continue
            order, cuts = _grouped(tokens)
            tokens, reps = tokens[order], reps[order]
            shared = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            hit_reps, hits = np.unique(reps[shared], return_counts=True)
            rows = list(_by_bucket(tokens[cuts[:-1]], bits, reps[cuts[:-1]], shared[cuts[:-1]]))
            if len(hits):
                rows.append((_LOCAL + int(hit_reps[0] % (1 << bits)), hits.astype(np.int64).tobytes(), hit_reps.tobytes(), b""))
            yield _record(rows, _POSTING)

    return run


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Hits per set within a bucket: its tokens that another set has as well."""
    reps = _numbers(table["reps"], np.int64)
    if key[0].as_py() >= _LOCAL:
        return pa.table({"rep": reps, "hits": _numbers(table["tokens"], np.int64)}, schema=_HIT)
    tokens = _numbers(table["tokens"], np.uint64)
    counted = _numbers(table["counted"], bool)
    order, cuts = _grouped(tokens)
    sizes = np.diff(cuts)
    reps, counted = reps[order], counted[order]
    many = np.repeat((sizes > 1) | np.logical_or.reduceat(counted, cuts[:-1]), sizes) & ~counted
    found, hits = np.unique(reps[many], return_counts=True)
    return pa.table({"rep": found, "hits": hits.astype(np.int64)}, schema=_HIT)


_SEGMENT = pa.schema([("segment", pa.int64()), ("reps", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of many texts packed in one row, which is named by its first set."""
    for batch in batches:
        for words in word_chunks(batch.column(1), SEGMENT_BYTES):
            sets = _shingle_sets(words)
            reps = np.asarray(batch.column(0).slice(words.first_row, words.n_rows)).astype(np.int64)
            sizes = np.array([len(found) for found in sets], np.int64)
            row = (int(reps[0]), reps.tobytes(), sizes.tobytes(), np.concatenate(sets).tobytes())
            yield _record([row], _SEGMENT)


_COUNT = pa.schema([("bucket", pa.int32()), ("segment", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
_FREQUENCY = pa.schema([("segment", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segment, cell in zip(batch.column("segment").to_pylist(), batch.column("tokens").to_pylist()):
                tokens, counts = np.unique(np.frombuffer(cell, np.uint64), return_counts=True)
                rows += [(at, segment, a, b) for at, a, b in _by_bucket(tokens, bits, counts.astype(np.int64))]
            yield _record(rows, _COUNT)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """For each segment, the tokens of this bucket that two sets or more have, with their number of sets."""
    cells = table["tokens"].to_pylist()
    tokens, counts = _numbers(table["tokens"], np.uint64), _numbers(table["counts"], np.int64)
    segments = np.repeat(np.asarray(table["segment"]), [len(cell) // 8 for cell in cells])
    order, cuts = _grouped(tokens)
    totals = np.empty(len(tokens), np.int64)
    totals[order] = np.repeat(np.add.reduceat(counts[order], cuts[:-1]), np.diff(cuts))
    shared = totals > 1
    tokens, totals, segments = tokens[shared], totals[shared], segments[shared]
    order, cuts = _grouped(segments)
    rows = [
        (int(segments[order[start]]), tokens[order[start:end]].tobytes(), totals[order[start:end]].tobytes())
        for start, end in zip(cuts[:-1], cuts[1:])
    ]
    return pa.Table.from_batches([_record(rows, _FREQUENCY)])


_ORDERED = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("n_prefix", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])


def _order(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sets of a segment in global order (frequent first, then by hash), without tokens of one set; ``n_prefix`` of them,
    at the end, are enough to meet any partner. Sets that can have no partner are left out."""
    known, totals = _numbers(right["tokens"], np.uint64), _numbers(right["counts"], np.int64)
    by_hash = np.argsort(known)
    known, totals = known[by_hash], totals[by_hash]
    rows = []
    for reps, sizes, tokens in zip(left["reps"].to_pylist(), left["sizes"].to_pylist(), left["tokens"].to_pylist()):
        sizes, tokens = np.frombuffer(sizes, np.int64), np.frombuffer(tokens, np.uint64)
        at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
        found = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
        ends = np.cumsum(sizes)
        for rep, size, end in zip(np.frombuffer(reps, np.int64), sizes, ends):
            part = slice(end - size, end)
            mine, count = tokens[part][found[part]], totals[at[part][found[part]]] if len(known) else totals
            n_prefix = int(size - least_overlap(size) + 1 - (size - len(mine)))
            if n_prefix > 0:
                order = np.lexsort((mine, -count))
                rows.append((int(rep), int(size), n_prefix, mine[order].tobytes(), count[order].tobytes()))
    return pa.Table.from_batches([_record(rows, _ORDERED)])


_STAR = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("reps", pa.binary())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(bits: int):
    """For each token among the rarest of a set: links within the batch, and its smallest set for the others to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("n_prefix"))
            parts = [np.frombuffer(cell, np.uint64)[-n:] for cell, n in zip(batch.column("tokens").to_pylist(), lengths)]
            if not parts:
                continue
            tokens, reps = np.concatenate(parts), np.repeat(np.asarray(batch.column("rep")), lengths)
            order, cuts = _grouped(tokens)
            tokens, reps = tokens[order], reps[order]
            least = np.minimum.reduceat(reps, cuts[:-1])
            pairs = np.unique(np.stack([reps, np.repeat(least, np.diff(cuts))]), axis=1)
            rows = list(_by_bucket(tokens[cuts[:-1]], bits, least))
            pairs = pairs[:, pairs[0] != pairs[1]].astype(np.int64)
            if pairs.shape[1]:
                at = _LOCAL + int(pairs[0, 0] % (1 << bits))
                rows.append((at, np.ascontiguousarray(pairs[0]).tobytes(), np.ascontiguousarray(pairs[1]).tobytes()))
            yield _record(rows, _STAR)

    return run


def _join_stars(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    reps = _numbers(table["reps"], np.int64)
    if key[0].as_py() >= _LOCAL:
        return pa.table({"a": _numbers(table["tokens"], np.int64), "b": reps}, schema=_EDGE)
    order, cuts = _grouped(_numbers(table["tokens"], np.uint64))
    least = np.repeat(np.minimum.reduceat(reps[order], cuts[:-1]), np.diff(cuts))
    pairs = np.unique(np.stack([reps[order], least]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pa.table({"a": pairs[0], "b": pairs[1]}, schema=_EDGE)


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, probes: np.ndarray, stored: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (stored, probe) of indices into ``sets`` with a Jaccard index of 3/4 or more.

    ``sets`` hold token ranks in ascending order; ``sizes`` also count tokens that no other set has.
    """
    links: list[tuple[int, int]] = []
    stored = np.array(sorted(stored, key=lambda at: sets[at].tolist()), np.int64)
    lengths = np.array([len(sets[at]) for at in stored], np.int64)
    common = np.zeros(len(stored), np.int64)  # length of the start shared with the set before
    for at in range(1, len(stored)):
        n = min(lengths[at - 1], lengths[at])
        differ = np.flatnonzero(sets[stored[at - 1]][:n] != sets[stored[at]][:n])
        common[at] = differ[0] if len(differ) else n
    stored_sizes = sizes[stored]
    start = 0
    while start < len(probes):
        # As many probes at once as the table of their tokens allows.
        end, total = start, 0
        while end < len(probes) and (end == start or (total + len(sets[probes[end]])) * (end + 1 - start) <= CELLS):
            total += len(sets[probes[end]])
            end += 1
        chosen = probes[start:end]
        start = end
        rank, column = np.concatenate([sets[at] for at in chosen]), np.repeat(np.arange(len(chosen)), [len(sets[at]) for at in chosen])
        known, row = np.unique(rank, return_inverse=True)
        has = np.zeros((len(known) + 1, len(chosen)), np.uint8)  # the last row is for tokens that no probe has
        has[row, column] = 1
        places = []
        for at in stored:
            place = np.minimum(np.searchsorted(known, sets[at]), len(known) - 1)
            places.append(np.where(known[place] == sets[at], place, len(known)))
        probe_sizes = sizes[chosen]
        probe_lengths = np.array([len(sets[at]) for at in chosen], np.int64)
        # A node: the stored sets lo..hi share their first `depth` tokens; `live` probes have `overlap` of them.
        stack = [(0, len(stored), 0, np.arange(len(chosen)), np.zeros(len(chosen), np.int64))] if len(stored) else []
        while stack:
            lo, hi, depth, live, overlap = stack.pop()
            shared = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(lengths[lo])
            if shared > depth:
                overlap = overlap + has[places[lo][depth:shared]][:, live].sum(axis=0, dtype=np.int64)
            least = stored_sizes[lo:hi].min()
            reach = np.minimum(overlap + int(lengths[lo:hi].max()) - shared, probe_lengths[live])
            alive = NEED_BELOW * reach >= NEED_ABOVE * (least + probe_sizes[live])
            if not alive.any():
                continue
            live, overlap = live[alive], overlap[alive]
            at = lo
            while at < hi and lengths[at] == shared:  # sets that end at this node
                linked = NEED_BELOW * overlap >= NEED_ABOVE * (stored_sizes[at] + probe_sizes[live])
                links += [(int(stored[at]), int(chosen[p])) for p in live[linked]]
                at += 1
            if at < hi:
                cuts = [at, *(at + 1 + np.flatnonzero(common[at + 1 : hi] == shared)), hi]
                stack += [(a, b, shared, live, overlap) for a, b in zip(cuts[:-1], cuts[1:])]
    return links


def _forest(pairs) -> list[tuple[int, int]]:
    """Pairs that suffice to connect what all pairs connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _join_cells(table: pa.Table) -> pa.Table:
    """Links within the cells of a bundle; a cell is a component or a pair of blocks of one."""
    edges: list[tuple[int, int]] = []
    keys = np.stack([np.asarray(table[name]) for name in ("component", "low", "high")], axis=1)
    reps, sizes, blocks = np.asarray(table["rep"]), np.asarray(table["n"]), np.asarray(table["block"])
    tokens, counts = table["tokens"].to_pylist(), table["counts"].to_pylist()
    _, cell_of = np.unique(keys, axis=0, return_inverse=True)
    order, cuts = _grouped(cell_of.reshape(-1))
    for start, end in zip(cuts[:-1], cuts[1:]):
        rows = order[start:end]
        if len(rows) < 2:
            continue
        own = [np.frombuffer(tokens[at], np.uint64) for at in rows]
        # Ranks in the global order, the same for all sets of the cell.
        every = np.concatenate(own)
        total = np.concatenate([np.frombuffer(counts[at], np.int64) for at in rows])
        known, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -total[first]))] = np.arange(len(known))
        ranked = np.split(rank[inverse], np.cumsum([len(part) for part in own])[:-1])
        low, high = keys[rows[0], 1:]
        side = np.flatnonzero(blocks[rows] == low), np.flatnonzero(blocks[rows] == high)
        found = trie_links(ranked, sizes[rows], probes=side[0], stored=side[1])
        edges += _forest((int(reps[rows[a]]), int(reps[rows[b]])) for a, b in found if a != b)
    columns = zip(*edges) if edges else ([], [])
    return pa.table([pa.array(list(column), pa.int64()) for column in columns], schema=_EDGE)


def _bits(total: int) -> int:
    """Buckets, as a power of two, for so many postings."""
    return min(30, max(6, int(total // POSTINGS).bit_length()))


def jaccard_links(spark: SparkSession, sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct sets that suffice to connect what all links connect."""
    sets = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")
    )
    total = sketch.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    bits = _bits(total // 8)
    hits = (
        sets.select("rep", "prefix")
        .mapInArrow(_post(bits), "bucket int, tokens binary, reps binary, counted binary")
        .groupBy("bucket")
        .applyInArrow(_meet, "rep long, hits long")
        .groupBy("rep")
        .agg(F.sum("hits").alias("hits"))
    )
    sizes = sketch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 3 / 4) / 8))
    wanted = _stored(spark, hits.join(sizes, hits["rep"] == sizes["doc_id"]).where(F.col("hits") >= needed).select("rep"), "wanted")
    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).groupBy("rep").agg(F.first("text").alias("text"))
    packed = _stored(spark, texts.select("rep", "text").mapInArrow(_segments, "segment long, reps binary, sizes binary, tokens binary"), "sets")
    bits = _bits((packed.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 8)
    counted = (
        packed.select("segment", "tokens")
        .mapInArrow(_count(bits), "bucket int, segment long, tokens binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(_frequencies, "segment long, tokens binary, counts binary")
    )
    ordered = _stored(
        spark,
        packed.groupBy("segment")
        .cogroup(counted.groupBy("segment"))
        .applyInArrow(_order, "rep long, n long, n_prefix int, tokens binary, counts binary"),
        "ordered",
    )
    stars = (
        ordered.select("rep", "n_prefix", "tokens")
        .mapInArrow(_stars(bits), "bucket int, tokens binary, reps binary")
        .groupBy("bucket")
        .applyInArrow(_join_stars, "a long, b long")
    )
    near = connected_components(spark, stars)
    members = near.unionAll(near.select(F.col("component").alias("node"), "component").distinct())
    blocks = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("n_blocks"))
    placed = _stored(
        spark,
        members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")),
        "blocks",
    )
    n_rows = placed.agg(F.sum("n_blocks")).first()[0] or 0
    cells = (
        ordered.join(placed, ordered["rep"] == placed["node"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("bundle", F.pmod(F.xxhash64("component", "low", "high"), F.lit(1 + n_rows // BUNDLE_ROWS)))
    )
    return (
        cells.select("bundle", "component", "low", "high", "block", "rep", "n", "tokens", "counts")
        .groupBy("bundle")
        .applyInArrow(_join_cells, "a long, b long")
    )


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Null and empty texts, and texts of white space, have no shingles and form components of their own; texts of fewer than
    five words are one shingle; very long texts are compared whole. Rows with a null id take no part and get a null component; repeated rows are one document.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    sketch = _stored(spark, docs.mapInArrow(_sketch, SKETCH), "sketch")
    found = connected_components(spark, jaccard_links(spark, sketch, docs))
    sets = sketch.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    sets = sets.join(found, sets["rep"] == found["node"], "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component")
    )
    linked = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        sketch.select("doc_id", "n_shingles", "k1", "k2")
        .join(sets, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
