"""Dense ranks over groups of any size, in one way for every size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from flowgauge.operators.joins import same_keys, with_prefix

# Values are numbered in levels of so many bits, lowest first: a window holds at most 2**16 values, 2**20 blocks of them, or
# all blocks of those that a group has (16,384 of them if its values are below 2**50).
LEVEL_BITS = (16, 20, 28)


def dense_ranks(df: DataFrame, groups: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """Add dense ranks within ``groups``, 1 for the lowest value; null is lower than any number.

    ``ranks`` maps the name of a rank to the whole number it goes by (others are
    rejected); a negated number ranks from the highest. Every row stays, equal rows
    too. A rank depends on the distinct values only, so the values of all ranks are
    numbered together, level by level in windows of bounded size, and joined back.
    """
    for rank, value in ranks.items():
        kind = df.select(value.alias("value")).schema[0].dataType
        if not isinstance(kind, IntegralType) and not (isinstance(kind, DecimalType) and kind.scale == 0):
            raise ValueError(f"rank {rank!r} needs whole numbers, not {kind.simpleString()}")
    measured = [F.struct(F.lit(at).alias("_rank"), value.cast("long").alias("_value")) for at, value in enumerate(ranks.values())]
    key = (*groups, "_rank")
    values = df.select(*groups, F.inline(F.array(*measured)).alias("_rank", "_value")).distinct()
    # All places of a value in one array: every rank joins the same table, which Spark computes once.
    found = [F.max(F.when(F.col("_rank") == at, F.col("_place"))) for at in range(len(ranks))]
    places = _places(values, key).groupBy(*groups, "_value").agg(F.array(*found).alias("_places"))
    places = with_prefix(places, (*groups, "_value"))
    named = df.columns
    for at, (rank, value) in enumerate(ranks.items()):
        joined = df.withColumn("_value", value.cast("long")).join(places, same_keys((*groups, "_value")))
        named = [*named, rank]
        df = joined.withColumn(rank, F.get("_places", F.lit(at))).select(*[F.col(f"`{name}`") for name in named])
    return df


def _places(values: DataFrame, key: Sequence[str]) -> DataFrame:
    """``_place`` of each distinct value: its number among those of equal higher bits, and the sizes of all blocks before.

    A block is named by the higher bits of its values; sizes of blocks are summed up
    within blocks of the next level, and so on, each time in a window of bounded size.
    """

    top = len(LEVEL_BITS) - 1

    def numbered(rows: DataFrame, name: str, size: Column, level: int) -> DataFrame:
        """Adds the block of ``name``, the sum of ``size`` before a row there, and the block's total on its first row."""
        rows = rows.withColumn("_block", F.lit(0).cast("long") if level == top else F.shiftright(name, LEVEL_BITS[level]))
        block = Window.partitionBy(*key, "_block")
        return rows.withColumns(
            {
                "_before": F.coalesce(F.sum(size).over(block.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_total": F.sum(size).over(block),
                "_first": F.row_number().over(block.orderBy(name)) == 1,
            }
        )

    levels = [numbered(values, "_value", F.lit(1), 0)]
    for level in range(1, top + 1):
        blocks = levels[-1].where("_first").select(*key, F.col("_block").alias("_value"), F.col("_total").alias("_size"))
        levels.append(numbered(blocks, "_value", F.col("_size"), level))
    before = levels[-1].select(*key, "_value", "_before")  # the highest bits, all in one block
    for level in reversed(levels[:-1]):
        outer = with_prefix(before.withColumnsRenamed({"_value": "_block", "_before": "_outer"}), (*key, "_block"))
        joined = level.join(outer, same_keys((*key, "_block")))
        before = joined.select(*key, "_value", (F.col("_before") + F.col("_outer")).alias("_before"))
    return before.select(*key, "_value", (F.col("_before") + 1).cast("int").alias("_place"))
