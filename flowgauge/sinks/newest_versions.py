"""Newest versions of records in buckets by id, on shared storage.

Each load is reduced to the newest version per id before it is written, and its rows go to the bucket of their id. So an
id has a row per load at most, however many versions it has, and the newest one of all loads is found bucket by bucket:
the rows of an id already lie in one task, and reading shuffles nothing.

The buckets are the files of a Spark table whose folder is named by ``root``. Any session can open them again; the number
of buckets is part of the folder's name. Files of a load appear when its job is committed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.merge_request_reports import IS_NEWEST, latest_versions
from flowgauge.sinks.folders import exists, names_below

KEY = "id"


@dataclass(frozen=True)
class NewestVersions:
    """``buckets`` is the number of tasks that read the table; it is fixed by the first load."""

    spark: SparkSession
    root: str
    buckets: int = 256
    newest: Sequence[str] = ()

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.buckets}-buckets"

    @property
    def table(self) -> str:
        return f"versions_{hashlib.md5(self.path.encode()).hexdigest()}"

    def _opened(self) -> bool:
        """Make the table known to this session; False if nothing is stored yet."""
        if not exists(self.spark, self.root):
            return False
        found = [int(match[1]) for name in names_below(self.spark, self.root) if (match := re.fullmatch(r"(\d+)-buckets", name))]
        if found and found != [self.buckets]:
            raise ValueError(f"{self.root} has {found} buckets, not {self.buckets}")
        if not found or not exists(self.spark, f"{self.path}/_SUCCESS"):
            return False
        if not self.spark.catalog.tableExists(self.table):
            fields = self.spark.read.parquet(self.path).schema.fields
            columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)
            self.spark.sql(
                f"CREATE TABLE {self.table} ({columns}) USING parquet "
                f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        self.spark.catalog.refreshTable(self.table)
        return True

    def append(self, versions: DataFrame) -> None:
        """Add a load of versions; older ones than those stored, and repeated ones, change no result."""
        self._opened()
        reduced = latest_versions(versions, self.newest).repartition(self.buckets, KEY)
        writer = reduced.write.mode("append").format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY)
        writer.option("path", self.path).saveAsTable(self.table)

    def read(self) -> DataFrame:
        """The newest version of every id over all loads, ready for the reports on merge requests."""
        if not self._opened():
            raise FileNotFoundError(f"nothing is stored in {self.root}")
        return latest_versions(self.spark.table(self.table), self.newest).withColumn(IS_NEWEST, F.lit(True))
