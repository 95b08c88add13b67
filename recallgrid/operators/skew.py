"""Joins that stay even when one key holds much of the left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task may have.
HOT_ROWS = 200_000


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in ``count`` the key's rows on the left.

    A key of more than ``hot_rows`` rows is spread over count / hot_rows partitions by a hash of the column ``spread_by``,
    and its one right row is repeated for each. The list of such keys is broadcast: it can't have more than
    (rows of left / hot_rows) entries, which is 10 MB for 10^11 rows.
    """
    keys = list(keys)
    parts = F.greatest(F.lit(1), F.ceil(F.col(count) / hot_rows)).cast("int")
    hot = right.where(F.col(count) > hot_rows).select(*keys, parts.alias("_parts"))
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int"))).drop("_parts")
    repeated = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(repeated, [*keys, "_part"]).drop("_part")
