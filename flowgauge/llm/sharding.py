"""Fixed virtual slots: records hash into thousands of slots, and a small versioned table says which shard owns a slot.

Only slot totals (a bounded number of rows) take part in balancing. Rebalancing edits the table: a shard keeps its largest
slots up to its fair share, and just the slots beyond that move to the shards with least bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.session import scratch_path
from flowgauge.sinks.folders import exists

SLOTS = 4096
SHARDS = 16


def slot_of(*key: str, n_slots: int = SLOTS) -> Column:
    """Virtual slot of a record; depends on nothing but the key columns (null is a value of its own)."""
    digest = F.md5(F.to_json(F.struct(*key)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def first_map(spark: SparkSession, n_slots: int = SLOTS, n_shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt in equal runs. Columns ``version, virtual_slot, shard``."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(
        F.lit(0).alias("version"), slot.alias("virtual_slot"), F.floor(slot * n_shards / n_slots).cast("int").alias("shard")
    )


def slot_totals(records: DataFrame, size: str) -> DataFrame:
    """Bytes and rows of each virtual slot; partial sums come before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def rebalance(slot_map: DataFrame, totals: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The next version of a map. Slots without records keep their shard, so few rows change.

    Within a shard, slots are kept from the largest on while their bytes fit the fair share; the others go, largest
    first, each to the shard that has least bytes by then (ties to the smaller shard). With more shards than before the
    new ones start empty and receive such slots.
    """
    loaded = slot_map.join(F.broadcast(totals), "virtual_slot", "left").withColumn(
        "bytes", F.coalesce("bytes", F.lit(0).cast("long"))
    )
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    fair = loaded.agg(F.ceil(F.sum("bytes") / n_shards).alias("fair"))
    ranked = loaded.withColumn("running", F.sum("bytes").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(F.broadcast(fair)).withColumn("stays", F.col("running") <= F.col("fair"))
    start = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda shard: F.aggregate(
            F.filter("kept", lambda part: part["shard"] == shard),
            F.lit(0).cast("long"),
            lambda total, part: total + part["bytes"],
        ),
    )
    # One row: at most as many elements as there are slots.
    gathered = ranked.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("order"), "virtual_slot")))).alias(
            "moving"
        ),
    ).select("moving", start.alias("loads"))

    def place(state: Column, part: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, at: F.when(at == least, load - part["order"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["owners"], F.array(least)).alias("owners"))

    owners = F.aggregate(
        "moving", F.struct("loads", F.array().cast("array<int>").alias("owners")), place, lambda state: state["owners"]
    )
    moved = gathered.select(F.arrays_zip("moving", owners.alias("owners")).alias("pairs")).select(F.explode("pairs").alias("pair"))
    moved = moved.select(F.col("pair.moving.virtual_slot").alias("virtual_slot"), F.col("pair.owners").alias("new_shard"))
    return ranked.join(F.broadcast(moved), "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("new_shard", "shard").alias("shard")
    )


def grow(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard ``n_shards`` added: an even part of every shard's slots moves there, nothing else moves."""
    order = Window.partitionBy("shard").orderBy(F.md5(F.col("virtual_slot").cast("string")), "virtual_slot")
    place, held = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy("shard"))
    taken = place <= F.floor(held / (n_shards + 1))
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.when(taken, n_shards).otherwise(F.col("shard")).alias("shard")
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, by default the newest."""
    stored = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    if version is not None:
        return stored.where(F.col("version") == version)
    return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version")


def assign(records: DataFrame, slot_map: DataFrame, totals: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the gapless place of the record within its shard.

    Places are counted within virtual slots, and each slot starts where the slots before it end, so no task sees a
    whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(F.broadcast(totals), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    return (
        records.withColumn("_within", within)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_start", "_within")
    )


def shard_documents(spark: SparkSession, docs: DataFrame, map_path: str | None = None) -> DataFrame:
    """All documents with ``size, text_crc32, virtual_slot, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards have nearly equal bytes, as far as single slots allow. A null text counts as an empty one
    (size 1, checksum 0); empty tables give no rows; rows with equal ids share a virtual slot, and equal rows may change
    places among themselves. Columns other than ``doc_id`` and ``text`` are not carried, so their names cannot clash.
    ``map_path`` (by default a new folder in the shared scratch folder) gets the first version of the map if it holds none,
    and a rebalanced version of the newest one there.
    """
    body = F.coalesce("text", F.lit(""))
    records = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        slot_of("doc_id").alias("virtual_slot"),
    )
    path = map_path or scratch_path(spark, "slot-map")
    totals_path = scratch_path(spark, "slot-totals")
    slot_totals(records, "size").write.parquet(totals_path)
    totals = spark.read.parquet(totals_path)
    if map_path is None or not exists(spark, path):
        save_map(first_map(spark), path)
    save_map(rebalance(load_map(spark, path), totals), path)
    placed = assign(records, load_map(spark, path), totals, ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there."""
    return shard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
