"""The scope of a recall as one conjunctive filter, and exact counts of what it leaves out, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.cleaning import cut_col

LIVE = ("active", "contested")


def effective_time() -> Column:
    return F.coalesce("occurred_at", "recorded_at")


@dataclass(frozen=True)
class Scope:
    """Filters of a recall; None is no filter, an empty list of statuses matches nothing.

    Defined results: a null status, subject or tag never matches a wanted one; null bounds of validity are unbounded; the
    period holds both its ends, validity only its start; a memory whose decay floor is now is decayed.
    """

    tenant: str
    statuses: Sequence[str] | None = LIVE
    subject: str | None = None
    include_subjectless: bool = False
    attributes: dict[str, str] = field(default_factory=dict)
    labels: Sequence[str] | None = None
    since: str | None = None
    until: str | None = None
    valid_at: str | None = None
    exclude_provenance: Sequence[str] = ()
    alive_at: str | None = None
    alive_seq: int | None = None
    any_axis: bool = False

    def tenant_filter(self) -> Column:
        return F.col("tenant_id") == self.tenant

    def subject_filter(self) -> Column:
        if self.subject is None:
            return F.lit(True)
        same = F.col("subject_id") == self.subject
        return same | F.col("subject_id").isNull() if self.include_subjectless else same

    def status_filter(self) -> Column:
        if self.statuses is None:
            return F.lit(True)
        return F.col("status").isin(list(self.statuses)) if self.statuses else F.lit(False)

    def period_filter(self) -> Column:
        at, out = effective_time(), F.lit(True)
        if self.since:
            out = out & (at >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until:
            out = out & (at <= F.lit(self.until).cast("timestamp_ntz"))
        return out

    def validity_filter(self) -> Column:
        if not self.valid_at:
            return F.lit(True)
        at = F.lit(self.valid_at).cast("timestamp_ntz")
        return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))

    def decay_filter(self) -> Column:
        wall = F.col("decay_floor_at") > F.lit(self.alive_at).cast("timestamp_ntz") if self.alive_at else None
        activity = F.col("decay_floor_seq").isNull() | (F.col("decay_floor_seq") > self.alive_seq) if self.alive_seq is not None else None
        if wall is None or activity is None:
            one = wall if wall is not None else activity
            return F.lit(True) if one is None else one
        return wall | activity if self.any_axis else wall & activity

    def filter(self) -> Column:
        out = self.tenant_filter() & self.status_filter() & self.subject_filter() & self.period_filter() & self.validity_filter() & self.decay_filter()
        for k, v in self.attributes.items():
            out = out & F.coalesce(F.col("attributes")[k] == v, F.lit(False))
        if self.labels:
            out = out & F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in self.labels])), F.lit(False))
        if self.exclude_provenance:
            out = out & ~F.col("provenance_kind").isin(list(self.exclude_provenance))
        return out


def scope_aggregate(memories: DataFrame, scope: Scope, skip: bool = False) -> DataFrame:
    """One row of exact counts (with ``skip`` nothing is read, and all of them are null: unknown), rows of one id counting once: live rows in scope, those not indexed by reason, and those left out by the first filter that stops them."""
    live, period, valid, alive = F.col("status").isin(list(LIVE)), scope.period_filter(), scope.validity_filter(), scope.decay_filter()
    at = F.lit(scope.valid_at).cast("timestamp_ntz") if scope.valid_at else None
    expired = live & period & (F.col("valid_until") <= at) if at is not None else F.lit(False)
    early = live & period & ~F.coalesce(F.col("valid_until") <= at, F.lit(False)) & (F.col("valid_from") > at) if at is not None else F.lit(False)
    inside = live & period & valid & alive
    flags = {
        "in_scope": inside,
        **{f"not_indexed_{s}": inside & (F.col("embedding_status") == s) for s in ("pending", "failed", "skipped")},
        **{s: F.col("status") == s for s in ("archived", "superseded", "forgotten")},
        "filtered_period": live & ~period,
        "filtered_expired": expired,
        "filtered_not_yet_valid": early,
        "filtered_decayed": live & period & valid & ~alive,
        "excluded_provenance": inside & F.col("provenance_kind").isin(list(scope.exclude_provenance)) if scope.exclude_provenance else F.lit(False),
    }
    # A row's flags are the bits of one integer, so that its repetitions are removed by a hash aggregate of integers.
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(flags.values())), F.lit(0))
    rows = memories.where(scope.tenant_filter() & scope.subject_filter()).select("id", bits.alias("bits")).groupBy("id").agg(F.max("bits").alias("bits"))
    counts = rows.agg(*[F.count_if(F.col("bits").bitwiseAND(1 << i) != 0).alias(n) for i, n in enumerate(flags)])
    if skip:
        return memories.sparkSession.range(1).select(*[F.lit(None).cast("bigint").alias(c) for c in counts.columns])
    return counts


def subject_groups(memories: DataFrame, scope: Scope) -> DataFrame:
    """Live rows of each subject; those without one are a group."""
    return memories.where(scope.filter()).groupBy("subject_id").agg(F.count("*").alias("n_rows"))


def label_groups(memories: DataFrame, scope: Scope, labels: Sequence[str]) -> DataFrame:
    """Rows of each label; key null counts rows that have none of them."""
    rows = memories.where(scope.filter()).select(F.array_intersect(F.coalesce("tags", F.array()), F.array(*[F.lit(x) for x in labels])).alias("has"))
    return rows.select(F.explode_outer("has").alias("label")).groupBy("label").agg(F.count("*").alias("n_rows"))


def digest_band(memories: DataFrame, scope: Scope, limit: int = 50, characters: int = 4000, entry: int = 120, overhead: int = 64, returned: DataFrame | None = None) -> DataFrame:
    """The newest digests that fit: in order of effective time and id, until the first that doesn't fit, each cut to ``entry`` at a grapheme's end.

    What a recall has ``returned`` already, rows with ``id``, isn't repeated. A top-k by limit, then a window over at most
    ``limit`` rows; sizes are UTF-16 units.
    """
    from pyspark.sql import Window as W

    rows = memories.where(scope.filter()).select("id", effective_time().alias("at"), "digest").dropDuplicates(["id"])
    if returned is not None:
        rows = rows.join(returned.select("id").distinct(), "id", "left_anti")
    rows = rows.orderBy(F.desc("at"), F.desc("id")).limit(limit).withColumn("digest", cut_col(F.col("digest"), entry))
    order = W.orderBy(F.desc("at"), F.desc("id"))
    sized = rows.withColumn("used", F.sum((F.length(F.encode("digest", "UTF-16BE")) / 2).cast("bigint") + overhead).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return sized.where(F.col("used") <= characters).select("id", "place", F.col("used").cast("bigint").alias("used"))
