"""Records of large JSON array files, each file read by many tasks.

Spark cuts a file into blocks, and a block into rows at every opening brace. What a block does to a reader that walks
through it depends on two things only: whether the block starts within a string, and at which depth. So a first pass sums
up each block for both cases (quotes, change of depth, opening braces by depth); a walk over these few rows, file by file,
gives every block its true start. A second pass walks through each block from there and gives the records that lie in it as
they are; a third one gives only what is left at the two ends of a block, and these pieces, two a block, are the only text
that is shuffled. No task holds more than a batch of rows or one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowgauge.session import import_on_workers

FILE = "_file"
_BRACE = "{"
#: What a byte is to the walk.
_QUOTE, _ESCAPE, _OPEN, _CLOSE, _RECORD = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
for _sign, _kind in (('"', _QUOTE), ("\\", _ESCAPE), ("[", _OPEN), ("]", _CLOSE), ("}", _CLOSE), (_BRACE, _RECORD)):
    _KIND[ord(_sign)] = _kind

_SUMMARY = f"{FILE} string, _key long, _block long, quotes long, change0 long, change1 long, starts0 map<int,long>, starts1 map<int,long>, root string"
_PIECE = "_key long, _owner long, _block long, _part long, text binary, closes long"

_START = f"{FILE} string, _key long, _block long, _in boolean, _from int, _level int, _owner long"
_WHOLE = f"{_PIECE}, {FILE} string, _level int"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """Each block of one file in a batch, with the bounds of its rows."""
    keys = np.asarray(batch.column("_key"))
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
    return ((int(keys[low]), low, high) for low, high in zip(cuts[:-1], cuts[1:]) if high > low)


def _text(batch: pa.RecordBatch, low: int, high: int, lead: bool) -> np.ndarray:
    """Bytes of some rows, each after its opening brace; ``lead`` rows start a file, without one."""
    values = batch.column("value").slice(low, high - low).cast(pa.large_binary())
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    text = np.empty(len(body) + len(values), np.uint8)
    braces = bounds[:-1] - bounds[0] + np.arange(len(values))
    kept = np.ones(len(text), bool)
    kept[braces] = False
    text[kept], text[braces] = body, ord(_BRACE)
    return text[1:] if lead else text


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of brackets, and the number of quotes before each, with their total at the end."""
    kinds = _KIND[text]
    at = np.flatnonzero(kinds)
    found = kinds[at]
    escapes = at[found == _ESCAPE]
    quotes = at[found == _QUOTE]
    if len(escapes):
        # A quote counts unless an odd number of backslashes stands before it.
        starts = np.concatenate(([True], np.diff(escapes) > 1))
        first = escapes[np.maximum.accumulate(np.where(starts, np.arange(len(escapes)), 0))]
        odd = escapes[(escapes - first) % 2 == 0]
        quotes = quotes[~np.isin(quotes, odd + 1, assume_unique=True)]
    brackets = found >= _OPEN
    places, found = at[brackets], found[brackets]
    return places, found, np.append(np.searchsorted(quotes, places), len(quotes))


def _steps(found: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.where(inside, 0, np.where(found == _CLOSE, -1, 1))


def _summed_up(schema: pa.Schema):
    """One row per block: what it does in both cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}

        def row() -> pa.RecordBatch:
            columns = [[total["file"]], [total["key"]], [total["block"]], [total["quotes"]], *([c] for c in total["change"])]
            columns += [[list(starts.items())] for starts in total["starts"]] + [[total["root"]], *([c] for c in total["folders"])]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, low, high in _runs(batch):
                new = not total or total["key"] != key
                if new:
                    if total:
                        yield row()
                    file, block = batch.column(FILE)[low].as_py(), batch.column("_block")[low].as_py()
                    folders = [batch.column(name)[low].as_py() for name in schema.names[9:]]
                    total = {
                        "file": file, "key": key, "block": block, "quotes": 0, "change": [0, 0], "starts": ({}, {}), "root": None, "folders": folders,
                    }
                text = _text(batch, low, high, new and total["block"] == 0)
                places, found, quotes = _marks(text)
                for case in (0, 1):
                    inside = (total["quotes"] + quotes[:-1] + case) % 2 == 1
                    steps = _steps(found, inside)
                    before = total["change"][case] + np.cumsum(steps) - steps
                    depths, counts = np.unique(before[(found == _RECORD) & ~inside], return_counts=True)
                    for depth, count in zip(depths.tolist(), counts.tolist()):
                        total["starts"][case][depth] = total["starts"][case].get(depth, 0) + count
                    total["change"][case] += int(steps.sum())
                total["quotes"] += int(quotes[-1])
                if total["block"] == 0 and total["root"] is None:
                    sign = text.tobytes().removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
                    total["root"] = sign.decode("latin-1") or None
        if total:
            yield row()

    return run


def _cut(schema: pa.Schema, whole: bool):
    """Pieces of text between the starts of records: those within a block if ``whole``, else those at its ends.

    ``_owner`` is the block in which the record of a piece has begun, -1 for what comes before the first record;
    ``closes`` counts the brackets that end a record or what is around it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}

        def record(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def piece() -> tuple:
            return at["key"], at["owner"], at["block"], at["part"], b"".join(at["open"]), at["closes"]

        for batch in batches:
            for key, low, high in _runs(batch):
                new = not at or at["key"] != key
                if new:
                    if at and not whole:
                        yield record([piece()])
                    first = {name: batch.column(name)[low].as_py() for name in ("_block", "_in", "_from", "_level", "_owner")}
                    at = {
                        "key": key, "block": first["_block"], "quotes": int(first["_in"]), "depth": first["_from"],
                        "level": first["_level"], "owner": first["_owner"], "part": 0, "open": [], "closes": 0,
                    }
                text = _text(batch, low, high, new and at["block"] == 0)
                places, found, quotes = _marks(text)
                inside = (at["quotes"] + quotes[:-1]) % 2 == 1
                steps = _steps(found, inside)
                after = at["depth"] + np.cumsum(steps)
                starts = places[(found == _RECORD) & ~inside & (after == at["level"] + 1)]
                ends = places[(found == _CLOSE) & ~inside & (after <= at["level"])]
                at["quotes"] += int(quotes[-1])
                at["depth"] = int(after[-1]) if len(after) else at["depth"]
                cuts = np.concatenate(([0], starts, [len(text)]))
                closes = np.diff(np.searchsorted(ends, cuts)).tolist()
                cuts = cuts.tolist()
                data = text.tobytes()
                rows = []
                last = len(cuts) - 2
                for number in range(last + 1):
                    if number:
                        # A record starts here, so the piece before it is done.
                        if (at["part"] > 0) == whole:
                            rows.append(piece())
                        at["owner"], at["part"], at["open"], at["closes"] = at["block"], at["part"] + 1, [], 0
                    elif whole and not at["part"]:
                        continue
                    if whole or not at["part"] or number == last:
                        at["open"].append(data[cuts[number] : cuts[number + 1]])
                        at["closes"] += closes[number]
                if rows:
                    yield record(rows)
        if at and not whole:
            yield record([piece()])

    return run


def _joined(schema: pa.Schema):
    """Pieces of one record, put together."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_block", "ascending"), ("_part", "ascending")])
        parts = {"text": [b"".join(table["text"].to_pylist())], "closes": [sum(table["closes"].to_pylist())]}
        return pa.table([pa.array(parts.get(f.name) or table[f.name].slice(0, 1).to_pylist(), f.type) for f in schema], schema=schema)

    return run


def _started(schema: pa.Schema, roots: tuple[str, ...]):
    """For each block of a file: whether it starts in a string, at which depth, and in which block the record there has begun."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.sort_by("_block").to_pylist()
        root = next((block["root"] for block in blocks if block["root"]), None)
        level = 0 if root == _BRACE else 1  # records of an array lie one level deep; an object alone is a record itself
        inside, depth, owner = 0, 0, -1
        rows = []
        for block in blocks:
            rows.append(block | {"_in": bool(inside), "_from": depth, "_level": level, "_owner": owner})
            if dict(block[f"starts{inside}"]).get(level - depth):
                owner = block["_block"]
            depth += block[f"change{inside}"]
            inside = (inside + block["quotes"]) % 2
        if inside or depth or root not in (None, *roots):
            raise ValueError(f"no array of JSON objects, or brackets or quotes do not match: {blocks[0][FILE]}")
        return pa.Table.from_pylist([{name: row[name] for name in schema.names} for row in rows], schema=schema)

    return run


def read_json_arrays(spark: SparkSession, path: str, schema: str, any_root: bool = False) -> DataFrame:
    """Objects of all JSON arrays below ``path``, with the path of their file in ``_file`` and the columns of its folders.

    Each file holds one array of objects, in any layout of lines, or with ``any_root`` one object. A malformed object, a value that
    is no object and a file that is cut off fail the job. Empty files and empty arrays give no rows.
    """
    import_on_workers(spark)
    text = spark.read.option("lineSep", _BRACE).text(path)
    folders = [f"`{f.name}`" for f in text.schema if f.name != "value"]
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in text.schema if f.name != "value")
    # Rows carry a hash of their file and block, as paths are longer than most rows.
    place = F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block")
    rows = text.select(F.col("value").cast("binary").alias("value"), F.xxhash64(*place).alias("_key"), *place, *folders)
    starts = (
        rows.mapInArrow(_summed_up(_arrow(_SUMMARY + carried)), _SUMMARY + carried)
        .groupBy(FILE)
        .applyInArrow(_started(_arrow(_START + carried), ("[", _BRACE) if any_root else ("[",)), _START + carried)
    )
    # One row per block of 128 MB; the summaries are made once, as both joins read the same shuffle.
    walk = starts.select("_key", "_block", "_in", "_from", "_level", "_owner")
    placed = rows.select("value", "_key").join(F.broadcast(walk), "_key")
    shape = _arrow(_PIECE)
    inner, ends = (placed.mapInArrow(_cut(shape, whole), _PIECE) for whole in (True, False))
    of_file = F.broadcast(starts.select("_key", FILE, "_level", *folders))
    ends = ends.join(of_file, "_key").groupBy(FILE, "_owner").applyInArrow(_joined(_arrow(_WHOLE + carried)), _WHOLE + carried)
    inner = inner.join(of_file, "_key")
    records = inner.unionByName(ends).withColumn("text", F.col("text").cast("string"))
    # What stands between the records: the start of the array or a comma; after the last one its end.
    lead, alone = F.col("_owner") < 0, F.col("_level") == 0
    before = F.when(F.col("closes") == 0, r"^\x{FEFF}?\s*(\[\s*)?$").otherwise(r"^\x{FEFF}?\s*\[\s*\]\s*$")
    space = F.lit(" \t\r\n")
    bare = F.rtrim("text", space)
    after = F.when(F.col("closes") == 1, ",").otherwise("]")
    whole = F.when(alone, bare).otherwise(F.rtrim(F.expr("substring(b_, 1, length(b_) - 1)"), space))
    records = records.withColumn("b_", bare)
    right = F.when(lead, F.regexp_like("text", before)).otherwise(
        (alone | F.col("b_").endswith(after)) & whole.endswith("}") & (F.col("closes") <= F.when(alone, 1).otherwise(2))
    )
    broken = F.raise_error(F.concat(F.lit("not an array of JSON objects: "), F.col(FILE)))
    checked = records.select(FILE, *folders, lead.alias("_lead"), F.when(right, whole).otherwise(broken).alias("text"))
    row = F.from_json("text", schema, {"mode": "FAILFAST"})
    # One column first, so that the check above is made for the start of a file too.
    kept = checked.withColumn("row", F.when(~F.col("_lead"), row)).where("NOT _lead OR length(text) < 0")
    return kept.select("row.*", FILE, *folders)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))
