"""Expressions on project paths, committers and cache keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgauge.functions.time import as_column


def parent_namespace(name: Column | str, full_name: Column | str) -> Column:
    """Full project path without its last part `` / name``."""
    name, full_name = as_column(name), as_column(full_name)
    return F.substring(full_name, F.lit(1), F.length(full_name) - F.length(F.trim(name)) - 3)


def root_namespace(path: Column | str) -> Column:
    """First part of a ``/``-separated path, trimmed."""
    # Cuts at the first slash without splitting the rest of the path.
    return F.trim(F.substring_index(as_column(path), "/", 1))


def mapped(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """``mapping[value]`` where there is such a key, else ``value`` unchanged.

    For config-sized mappings; a mapping that is itself a table should be joined.
    """
    value = as_column(value)
    if not mapping:
        return value
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def mapped_email(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Case-insensitive e-mail lookup; unknown addresses come back in lower case."""
    return mapped(F.lower(as_column(value)), mapping)


def contains_none_of(value: Column | str, parts: Sequence[str]) -> Column:
    value = as_column(value)
    keep = F.lit(True)
    for part in parts:
        keep = keep & ~value.contains(part)
    return keep


def experience_factor(periods: Column | str, learning_time: float) -> Column:
    """Linear ramp from ``1/learning_time`` to 1."""
    return F.least(as_column(periods) / F.lit(float(learning_time)), F.lit(1.0))


def digest_key(text: Column | str) -> Column:
    """Base64 of the MD5 digest without the characters ``/`` and ``=``."""
    return F.translate(F.base64(F.unhex(F.md5(as_column(text)))), "/=", "")
