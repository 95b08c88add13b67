"""Lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.checks import uuid_like


def point(rows: DataFrame, tenant: str, key: str, column: str = "id") -> DataFrame:
    """The tenant's row of a key, at most one; none for another tenant's key and for what has no id's shape, for which nothing is read."""
    if not uuid_like(key):
        return rows.limit(0)
    return rows.where((F.col("tenant_id") == tenant) & (F.col(column) == key.lower())).limit(1)


def first_seen(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` of the wanted keys with ``position``, that of a key's first mention; keys that aren't there have no row.

    ``wanted`` has ``(position, key)``; mentions are reduced before the join.
    """
    first = wanted.where(F.col("key").isNotNull()).groupBy(F.lower("key").alias(key)).agg(F.min("position").alias("position"))
    return rows.join(first, key)
