"""Token ids in files of fixed-width numbers.

Every id takes the bits that the largest id of the vocabulary needs. Ids are packed 64 at a time into ``width`` words of 64
bits, so a block of 1,024 ids starts at a byte of its own and any block can be unpacked with a few numpy operations.

A *segment* is the binary unit: a head, the documents that lie in it, the byte offset of every block, and the packed ids, all
little-endian:

    magic "FWID", version u8, width u8, ids per block u16, ids u64, documents u64
    doc_id i64 for each document, 1 byte for each that is 1 if the id is null, start u64 of each document and the end
    offset u64 of each block within the packed ids, and the end
    packed ids

A *folder* holds ``segments``, a Parquet table ``shard, segment, first, n_ids, data`` written by Spark, so that a lost
executor leaves no half file, and ``manifest``, ``shard, start, n_ids``. Documents follow each other in ascending doc_id order
through segments and shards; ``start`` counts the ids of all shards before. A document lies in one segment whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1024
#: Ids of a segment, but for a longer document; bytes of text of a shard; shards of a folder.
SEGMENT_IDS, SHARD_BYTES, MAX_SHARDS = 1 << 18, 1 << 24, 20_000
#: Pieces of text that a worker keeps, the longest of them, and how many new ones are encoded at once.
CACHED_PIECES, CACHED_LENGTH, AT_ONCE = 800_000, 64, 1000
_HEAD = struct.Struct("<4sBBHQQ")
_MAGIC, _VERSION = b"FWID", 1
_PER_GROUP = 64
_WHOLE_BYTES = {8: "<u1", 16: "<u2", 32: "<u4"}  # widths that numpy has itself


def bits_for(n_ids: int) -> int:
    """The fewest bits that hold every id of a vocabulary of this size."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, without padding but for the last byte."""
    if width in _WHOLE_BYTES:
        return ids.astype(_WHOLE_BYTES[width]).tobytes()
    groups = np.zeros((-(-len(ids) // _PER_GROUP), _PER_GROUP), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), width + 1), np.uint64)
    for at in range(_PER_GROUP):
        word, shift = divmod(at * width, 64)
        words[:, word] |= groups[:, at] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, at] >> np.uint64(64 - shift)
    return words[:, :width].astype("<u8").tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    if width in _WHOLE_BYTES:
        return np.frombuffer(data, _WHOLE_BYTES[width], n).astype(np.uint32)
    n_groups = -(-n // _PER_GROUP)
    padded = np.zeros(n_groups * width * 8, np.uint8)
    raw = np.frombuffer(data, np.uint8)[: len(padded)]
    padded[: len(raw)] = raw
    words = np.zeros((n_groups, width + 1), np.uint64)
    words[:, :width] = padded.view("<u8").reshape(n_groups, width)
    ids = np.empty((n_groups, _PER_GROUP), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for at in range(_PER_GROUP):
        word, shift = divmod(at * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[:, word + 1] << np.uint64(64 - shift)
        ids[:, at] = value & mask
    return ids.reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    """The bytes of a segment."""
    packed = pack(ids, width)
    blocks = np.minimum(np.arange(-(-len(ids) // BLOCK_IDS) + 1, dtype=np.uint64) * np.uint64(BLOCK_IDS * width // 8), np.uint64(len(packed)))
    return b"".join(
        (
            _HEAD.pack(_MAGIC, _VERSION, width, BLOCK_IDS, len(ids), len(doc_ids)),
            np.array([at or 0 for at in doc_ids], "<i8").tobytes(),
            bytes(at is None for at in doc_ids),
            np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(),
            blocks.astype("<u8").tobytes(),
            packed,
        )
    )


class Segment:
    """Reads a segment; ids are unpacked only where they are asked for."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.block_ids, self.n_ids, n = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a segment of token ids of this version")
        at = _HEAD.size
        known = np.frombuffer(data, "<i8", n, at)
        empty = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if gone else int(known_id) for known_id, gone in zip(known, empty)]
        at += 9 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.blocks = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.packed = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start .. stop`` of the segment, from the blocks that hold them."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"ids {start} to {stop} of {self.n_ids}")
        if start == stop:
            return np.zeros(0, np.uint32)
        low, high = start // self.block_ids, -(-stop // self.block_ids)
        held = min(self.n_ids, high * self.block_ids) - low * self.block_ids
        found = unpack(self.packed[self.blocks[low] : self.blocks[high]], held, self.width)
        return found[start - low * self.block_ids : stop - low * self.block_ids]

    def document(self, at: int) -> np.ndarray:
        return self.ids(int(self.starts[at]), int(self.starts[at + 1]))


class _Known(dict):
    """The ids of pieces met before, as bytes; another piece gets an empty place in ``new``, to be filled later."""

    def __init__(self):
        self.new: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytearray:
        place = self.new.get(piece)
        if place is None:
            place = self.new[piece] = bytearray()
        return place


class WordEncoder:
    """Ids by the tokenizers library, each different piece of text once.

    The vocabulary's pattern never matches across white space, and its normal form does not join characters across it, so a
    text's ids are those of its words by ASCII white space, one after the other. Words of ASCII and Western European letters
    alone are cut further, by the pattern itself. With a vocabulary of another pattern, whole texts are encoded.

    Pieces cut by the pattern are in this vocabulary's normal form already, so ``plain`` leaves that step out. If the vocabulary marks the end of
    words, and any byte can be there, the marks tell where the ids of each piece end: no piece has both letters and signs, so
    none holds a mark itself.
    """

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = (Tokenizer.from_str(source.decode()) for _ in range(2))
        for tokenizer in (self.tokenizer, self.plain):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        read = json.loads(source)
        if (read["normalizer"] or {}).get("normalizers") == _NORMAL:
            self.plain.normalizer = normalizers.Sequence([])
        self.by_words = _PATTERN in [part.get("pattern", {}).get("Regex") for part in read["pre_tokenizer"].get("pretokenizers", [])]
        vocabulary, mark = self.tokenizer.get_vocab(), read["model"].get("end_of_word_suffix")
        self.ends = None
        if mark == "</w>" and all(letter + mark in vocabulary for letter in pre_tokenizers.ByteLevel.alphabet()):
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[at for token, at in vocabulary.items() if token.endswith(mark)]] = True
        self.known = _Known()

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(token in text for token in self.special)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose ids follow each other as the text's ids."""
        if not self.by_words:
            return [text]
        if self._plain(text):
            return _PIECES.findall(text.lower())
        found = []
        for word in _WORDS.findall(text):
            if self._plain(word):
                found += _PIECES.findall(word.lower())
            else:
                found.append(word)
        return found

    def _learn(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """New pieces with their ids. Those that the pattern takes whole are encoded many at a time, apart by spaces."""
        whole = [*filter(_WHOLE.fullmatch, new)] if self.by_words else []
        others = set(new).difference(whole)
        for start in range(0, len(whole), AT_ONCE):
            pieces = whole[start : start + AT_ONCE]
            text = " ".join(pieces)
            if self.ends is not None:
                ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                last = self.ends[ids]
            else:
                one = self.plain.encode(text, add_special_tokens=False)
                ids, word = np.array(one.ids, "<u4"), np.array(one.word_ids)
                last = np.append(word[1:] != word[:-1], True)
            cuts = np.concatenate(([0], np.flatnonzero(last) + 1))
            if len(cuts) != len(pieces) + 1 or cuts[-1] != len(ids):
                raise ValueError("the tokenizer does not cut words by the expected pattern")
            data, cuts = ids.tobytes(), (cuts * 4).tolist()
            yield from ((piece, data[a:b]) for piece, a, b in zip(pieces, cuts, cuts[1:]))
        for piece, one in zip(others, self.tokenizer.encode_batch([*others], add_special_tokens=False)):
            yield piece, np.array(one.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """The ids of every text (null: none) with the closing id."""
        known, new, end = self.known, {}, np.array([end_id], "<u4").tobytes()
        known.new = new
        found = [[*map(known.__getitem__, self.pieces(text or "")), end] for text in texts]
        for piece, ids in self._learn([*new]):
            new[piece][:] = ids
            if len(known) < CACHED_PIECES and len(piece) <= CACHED_LENGTH:
                known[piece] = ids
        return [np.frombuffer(b"".join(parts), "<u4") for parts in found]


_WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: The pattern of word_bpe_49k.json, and what it says for lower-case text of the characters of _PLAIN alone.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PLAIN = re.compile("[\\t\\n\\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: What may be a piece by _PIECES; texts with anything else are given to the library as they are.
_WHOLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+")


@lru_cache(maxsize=1)
def _encoder(source: bytes) -> WordEncoder:
    """A worker keeps it, with the pieces known, from task to task."""
    return WordEncoder(source)


_SEGMENT = "shard int, segment int, first long, n_ids long, data binary"


def _segments(source: bytes, end_id: int, segment_ids: int):
    """The documents of a sorted partition as segments, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source)
        held: list[tuple[int | None, np.ndarray]] = []
        shard = n_held = segment = first = 0

        def written() -> pa.RecordBatch:
            ids = np.concatenate([part for _, part in held])
            data = write_segment([at for at, _ in held], [len(part) for _, part in held], ids, encoder.width)
            row = (shard, segment, first, len(ids), data)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["shard", "segment", "first", "n_ids", "data"])

        for batch in batches:
            shards, ids, texts = (column.to_pylist() for column in batch.columns)
            for shard, doc_id, found in zip(shards, ids, encoder.encode(texts, end_id)):
                if held and n_held + len(found) > segment_ids:
                    yield written()
                    segment, first, held, n_held = segment + 1, first + n_held, [], 0
                held.append((doc_id, found))
                n_held += len(found)
        if held:
            yield written()

    return run


def read_vocabulary(path: str | None = None) -> bytes:
    """The bytes of a vocabulary file, by default the public one that the module names."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return file.read()


def write_ids(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents to a new folder in ascending doc_id order, each with a closing id.

    A null or empty text is its closing id alone; very long texts are used whole. Repeated rows are written each; rows of one
    id follow each other by a hash of the text; null ids come first. Only ``doc_id`` and ``text`` are read, so other columns
    cannot clash; an empty table gives a folder without segments.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    n_shards = min(MAX_SHARDS, 1 + total // SHARD_BYTES)
    keys = ["doc_id", "hash", "row"]  # the row keeps many copies of one id apart
    dealt = rows.repartitionByRange(n_shards, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    dealt.mapInArrow(_segments(read_vocabulary(path), end_id, SEGMENT_IDS), _SEGMENT).write.parquet(f"{folder}/segments")
    shards = spark.read.parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, at most MAX_SHARDS
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")
    shards.select("shard", start, "n_ids").write.parquet(f"{folder}/manifest")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, first, data in zip(*(column.to_pylist() for column in batch.columns)):
            held = Segment(data)
            every = held.ids(0, held.n_ids).astype("<u4")
            starts = held.starts
            sums = [zlib.crc32(every[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            columns = (np.full(len(sums), shard, np.int32), held.doc_ids, starts[:-1] + first, np.diff(starts), sums)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a folder, from its files alone."""
    segments = spark.read.parquet(f"{folder}/segments").select("shard", "first", "data")
    found = segments.mapInArrow(_documents, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", F.col("start").alias("_start"))
    return found.join(manifest, "shard").select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``start, ids``: ids ``start .. stop`` of a folder, a row per segment that holds some; only their blocks are unpacked."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data in zip(*(column.to_pylist() for column in batch.columns)):
                low, high = max(start, first), min(stop, first + n)
                ids = Segment(data).ids(low - first, high - first)
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])

    manifest = spark.read.parquet(f"{folder}/manifest").where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    segments = spark.read.parquet(f"{folder}/segments").join(manifest.select("shard", "start"), "shard")
    first = F.col("start") + F.col("first")
    held = segments.select(first.alias("first"), "n_ids", "data").where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))
    return held.mapInArrow(cut, "start long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the files of all documents' ids."""
    folder = scratch_path(spark, "token-files")
    write_ids(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_documents(spark, folder)
