"""Metric tables on shared storage, replaced point by point.

Each measurement is a folder of Parquet files. A point is known by its time and
tags; loads are only ever appended, under a load number, and reading keeps the
newest load of each point. So a job that is repeated or overlaps an earlier one
does no harm, and nothing is overwritten while read.

A load is written to a folder of its own, by month, and then committed by a
*manifest*: a small numbered file with the month folders of all loads so far.
The highest number is the state of the table, so a load is seen whole or not at
all, and readers of an earlier number are not disturbed. The manifest also tells
which months a single load has written, with each point once: these are read as
they are. The newest load is searched for only in months that several loads
touch. It has a line per load and month, never per file or point.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.functions.time import as_time
from flowgauge.sinks.folders import create_small, exists, names_below, read_small

LOAD = "load_id"
MONTH = "month"
PART = "part"  # names the folder of a load
MANIFEST = "_manifest"
COMMIT_ATTEMPTS = 100
#: A month is written by at most so many tasks, each with all points of its share of the tags.
SLICES = 16
_SLICE = "_slice"


def _month(time: Column) -> Column:
    return F.date_format(time.cast("date"), "yyyy-MM")


@dataclass(frozen=True)
class Entry:
    """A month of a load. ``unique_by`` are the tags by which, with the time, each of its points is there once."""

    month: str
    folder: str
    load_id: int | None = None
    unique_by: tuple[str, ...] | None = None

    def is_unique(self, tags: Sequence[str]) -> bool:
        return self.unique_by is not None and set(self.unique_by) <= set(tags)


def _newest(stored: DataFrame, tags: Sequence[str], by_load_alone: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """The newest load of each point; equal points of one load are told apart by their fields.

    ``by_load_alone`` says that no load has a point twice, so that fields nobody asks for need not be read. ``within`` are
    functions of the time and the tags by which the rows are dealt already.
    """
    keys = ("time", *tags)
    values = [] if by_load_alone else [name for name in stored.columns if name not in (*keys, *within, MONTH, LOAD)]
    order = [F.col(f"`{name}`").desc() for name in (LOAD, *values) if name in stored.columns] or [F.lit(0)]
    newest = Window.partitionBy(*[F.col(f"`{name}`") for name in (*within, *keys)]).orderBy(*order)
    return stored.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def _newest_by_month(stored: DataFrame, tags: Sequence[str]) -> DataFrame:
    """The same, dealt and sorted by month for writing: one shuffle does for both."""
    share = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in ("time", *tags)]), F.lit(SLICES)).cast("int")
    dealt = stored.withColumn(_SLICE, share).repartition(MONTH, _SLICE)
    return _newest(dealt, tags, within=(MONTH, _SLICE)).drop(_SLICE)


@dataclass(frozen=True)
class MetricStore:
    spark: SparkSession
    root: str

    def path(self, measurement: str) -> str:
        return f"{self.root}/{measurement}"

    def append(self, points: DataFrame, measurement: str, load_id: int, tags: Sequence[str] | None = None) -> None:
        """Write one load and commit it. ``load_id`` must grow from load to load; a point without a time fails the write.

        With ``tags``, repeated points of the load are reduced to one while writing, and months that
        no other load touches are then read without a search.
        """
        untimed = F.raise_error(F.lit(f"a point of {measurement} has no time"))
        month = F.when(F.col("time").isNull(), untimed).otherwise(_month(F.col("time")))
        stamped = points.withColumn(MONTH, month)
        # Rebalancing makes few files per month, and splits a month that is too big.
        dealt = stamped.hint("rebalance", F.col(MONTH)) if tags is None else _newest_by_month(stamped, tags)
        self._write(dealt.withColumn(LOAD, F.lit(load_id).cast("long")), measurement, load_id, tags)

    def _write(self, stamped: DataFrame, measurement: str, load_id: int | None, unique_by: Sequence[str] | None) -> None:
        part = f"{PART}={uuid.uuid4().hex}"
        folder = f"{self.path(measurement)}/{part}"
        stamped.write.mode("errorifexists").partitionBy(MONTH).parquet(folder)
        months = self._months(folder)
        self._commit(measurement, [Entry(at, part, load_id, None if unique_by is None else tuple(unique_by)) for at in months])

    def _months(self, folder: str) -> list[str]:
        found = (re.fullmatch(rf"{MONTH}=(\d+-\d\d)", name) for name in names_below(self.spark, folder))
        return sorted(match[1] for match in found if match)

    def versions(self, measurement: str) -> list[int]:
        """Numbers of the committed manifests, oldest first."""
        folder = f"{self.path(measurement)}/{MANIFEST}"
        if not exists(self.spark, folder):
            return []
        found = (re.fullmatch(r"(\d{12})\.json", name) for name in names_below(self.spark, folder))
        return sorted(int(match[1]) for match in found if match)

    def entries(self, measurement: str, version: int | None = None) -> list[Entry]:
        """What a manifest lists, by default the newest. Month folders from before there were manifests count as listed."""
        versions = self.versions(measurement)
        if version is None and not versions:
            path = self.path(measurement)
            return [Entry(month, "") for month in self._months(path)] if exists(self.spark, path) else []
        content = read_small(self.spark, self._manifest(measurement, versions[-1] if version is None else version))
        lines = (json.loads(line) for line in content.splitlines())
        return [Entry(**line | {"unique_by": None if line["unique_by"] is None else tuple(line["unique_by"])}) for line in lines]

    def _manifest(self, measurement: str, version: int) -> str:
        return f"{self.path(measurement)}/{MANIFEST}/{version:012d}.json"

    def _commit(self, measurement: str, new: list[Entry]) -> None:
        """Makes new entries part of the table; of two writers at a time, the later one adds to what the earlier one has written."""
        for _ in range(COMMIT_ATTEMPTS):
            listed = self.entries(measurement) + new
            version = max(self.versions(measurement), default=0) + 1
            content = "".join(json.dumps(asdict(entry)) + "\n" for entry in listed)
            if create_small(self.spark, self._manifest(measurement, version), content):
                return
        raise RuntimeError(f"{measurement}: other writers committed first {COMMIT_ATTEMPTS} times")

    def _files(self, measurement: str, entries: Sequence[Entry], merge_schema: bool) -> DataFrame:
        path = self.path(measurement)
        folders = ["/".join(name for name in (path, entry.folder, f"{MONTH}={entry.month}") if name) for entry in entries]
        # Every part is read below its own folder, so that old and new layouts give the same columns.
        by_layout: dict[str, list[str]] = defaultdict(list)
        for entry, folder in zip(entries, folders):
            by_layout[PART if entry.folder else ""].append(folder)
        reader = self.spark.read.option("mergeSchema", merge_schema).option("basePath", path)
        parts = [reader.parquet(*some).withColumn(MONTH, F.col(MONTH).cast("string")).drop(PART) for some in by_layout.values()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=merge_schema), parts)

    def read(
        self,
        measurement: str,
        tags: Sequence[str],
        since=None,
        until=None,
        merge_schema: bool = False,
        loaded_once: bool = False,
        version: int | None = None,
    ) -> DataFrame:
        """Newest load of every point, optionally of a range of time or as of an earlier manifest.

        The range selects whole month folders before any file is opened. Months of a single load
        are read without a shuffle, the others are searched for the newest load; the manifest
        tells which. ``loaded_once`` demands that no month needs a search, and is an error otherwise.
        """
        by_month: dict[str, list[Entry]] = defaultdict(list)
        for entry in self.entries(measurement, version):
            by_month[entry.month].append(entry)
        if not by_month:
            raise FileNotFoundError(f"nothing is stored of {measurement}")
        plain = [some[0] for some in by_month.values() if len(some) == 1 and some[0].is_unique(tags)]
        shared = [entry for some in by_month.values() if len(some) > 1 or not some[0].is_unique(tags) for entry in some]
        if loaded_once and shared:
            raise ValueError(f"{measurement} has months of several loads: {sorted({entry.month for entry in shared})[:3]}")

        def cut(stored: DataFrame) -> DataFrame:
            if since is not None:
                stored = stored.where((F.col("time") >= as_time(since)) & (F.col(MONTH) >= _month(as_time(since))))
            if until is not None:
                stored = stored.where((F.col("time") <= as_time(until)) & (F.col(MONTH) <= _month(as_time(until))))
            return stored

        parts = [cut(self._files(measurement, plain, merge_schema))] if plain else []
        if shared:
            once = all(entry.is_unique(tags) for entry in shared) and all(
                len({entry.load_id for entry in some}) == len(some) for some in by_month.values()
            )
            once = once and all(entry.load_id is not None for entry in shared)
            parts.append(_newest(cut(self._files(measurement, shared, merge_schema)), tags, once))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=merge_schema), parts).drop(LOAD, MONTH)

    def last_month(self, measurement: str) -> DataFrame | None:
        """All stored points of the last month that has any; None if nothing is stored.

        Enough to find the last stored time, whatever the size of the table.
        """
        entries = self.entries(measurement)
        last = max((entry.month for entry in entries), default=None)
        return None if last is None else self._files(measurement, [entry for entry in entries if entry.month == last], False)

    def compact(self, measurement: str, tags: Sequence[str], target: MetricStore) -> None:
        """Write the newest points to another store, one load per point, same load numbers; nothing may be stored there yet."""
        if target.entries(measurement):
            raise FileExistsError(f"{measurement} is already stored in {target.root}")
        stored = self._files(measurement, self.entries(measurement), True)
        target._write(_newest_by_month(stored, tags), measurement, None, tags)
