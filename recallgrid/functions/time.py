"""Time columns as integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def epoch_micros(spark: SparkSession, col: Column) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` read as UTC, whatever the session's time zone; null stays null."""
    if (spark.conf.get("spark.sql.session.timeZone") or "").upper() in ("UTC", "ETC/UTC", "Z", "GMT", "+00:00"):
        return F.unix_micros(col.cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
