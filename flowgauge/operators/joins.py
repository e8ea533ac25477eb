"""Equality of keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_keys(keys: Sequence[str], prefix: str = "_of_") -> Column:
    """Null-safe equality of ``keys`` with the columns of a table under prefixed names."""
    return reduce(lambda all_of, one: all_of & one, [F.col(name).eqNullSafe(F.col(f"{prefix}{name}")) for name in keys])


def with_prefix(df: DataFrame, keys: Sequence[str], prefix: str = "_of_") -> DataFrame:
    return df.withColumnsRenamed({name: f"{prefix}{name}" for name in keys})
