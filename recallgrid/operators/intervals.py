"""Continuous periods and gaps of overlapping half-open intervals (problem 1).

Sweep line: every interval is a +1 at its start and a -1 at its end, the running sum of these is the number of active
intervals; a period starts where it leaves zero and ends where it returns to zero.

A claim may hold any share of all rows. So the running sum is made in two levels: boundaries are summed per claim and
moment (before the shuffle as well), then per claim and hour, and the hours' running sums are the offsets from which each
hour goes on. Boundaries and edges are used twice, so each is written once to the shared folder. A task has at most one claim's hour (3.6 million distinct milliseconds) or one claim's list of hours.

Defined results: null start or end is unbounded; an interval that ends at or before its start, or has a null key part, is
ignored; repeated rows change nothing; touching intervals are one period; an empty input has an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.claim_keys import normal_key_col
from recallgrid.functions.time import epoch_micros
from recallgrid.session import cut_lineage

LOW, HIGH, HOUR = -(2**63), 2**63 - 1, 3_600_000_000


def periods_and_gaps(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows ``(*keys, span_kind, from_us, until_us)`` from bigint columns ``start`` and ``end``; -1 is an unbounded side.

    The method needs keys that aren't null; rows with a null in one are dropped.
    """
    keys = list(keys)
    bounds = intervals.select(*keys, F.coalesce(F.col(start), F.lit(LOW)).alias("_a"), F.coalesce(F.col(end), F.lit(HIGH)).alias("_b"))
    bounds = bounds.where("_a < _b").dropna(subset=keys)
    turns = bounds.select(*keys, F.inline(F.array(F.struct(F.col("_a").alias("_t"), F.lit(1).cast("bigint").alias("_d")), F.struct(F.col("_b").alias("_t"), F.lit(-1).cast("bigint").alias("_d")))))
    hour = F.expr(f"_t div {HOUR}")
    turns = cut_lineage(turns.withColumn("_h", hour).groupBy(*keys, "_h", "_t").agg(F.sum("_d").alias("_d")).where("_d <> 0"))

    before = W.partitionBy(*keys).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    hours = turns.groupBy(*keys, "_h").agg(F.sum("_d").alias("_s"))
    hours = hours.select(*keys, "_h", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))

    inside = W.partitionBy(*keys, "_h").orderBy("_t")
    active = F.col("_base") + F.sum("_d").over(inside.rowsBetween(W.unboundedPreceding, 0))
    edges = turns.join(hours, [*keys, "_h"]).select(*keys, "_h", "_t", "_d", active.alias("_n"))
    edges = cut_lineage(edges.where((F.col("_n") == 0) | (F.col("_n") == F.col("_d"))))  # back to zero, or away from zero

    after = W.partitionBy(*keys).orderBy("_h")
    firsts = edges.groupBy(*keys, "_h").agg(F.min("_t").alias("_f"))
    firsts = firsts.select(*keys, "_h", F.lead("_f").over(after).alias("_next_hour"))
    spans = edges.withColumn("_next", F.lead("_t").over(inside)).join(firsts, [*keys, "_h"])
    spans = spans.select(*keys, F.when(F.col("_n") > 0, "period").otherwise("gap").alias("span_kind"), F.col("_t").alias("_a"), F.coalesce("_next", "_next_hour").alias("_b")).where("_b is not null")
    return spans.select(
        *keys,
        "span_kind",
        F.when(F.col("_a") == LOW, F.lit(-1)).otherwise(F.col("_a")).cast("bigint").alias("from_us"),
        F.when(F.col("_b") == HIGH, F.lit(-1)).otherwise(F.col("_b")).cast("bigint").alias("until_us"),
    )


def claim_periods(memories: DataFrame) -> DataFrame:
    """Periods and gaps of every claim of ``memories``: tenant, subject and both claim key fields in normal form."""
    spark = memories.sparkSession
    rows = memories.where("tenant_id is not null and subject_id is not null and claim_key_subject is not null and claim_key_predicate is not null")
    rows = rows.select(
        "tenant_id",
        "subject_id",
        normal_key_col(F.col("claim_key_subject")).alias("claim_subject"),
        normal_key_col(F.col("claim_key_predicate")).alias("claim_predicate"),
        epoch_micros(spark, F.col("valid_from")).alias("from_at"),
        epoch_micros(spark, F.col("valid_until")).alias("until_at"),
    )
    return periods_and_gaps(rows, ["tenant_id", "subject_id", "claim_subject", "claim_predicate"], "from_at", "until_at")
