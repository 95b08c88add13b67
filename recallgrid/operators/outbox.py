"""The job queue as relations: claims, terminal states, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claimable(jobs: DataFrame, now: str, lease_seconds: int, limit: int) -> DataFrame:
    """The next jobs, the longest available first, with the attempt they get; one whose lease ran out goes to the tail at now."""
    t = F.lit(now).cast("timestamp_ntz")
    expired = F.col("claimed_at") <= t - F.make_dt_interval(secs=F.lit(lease_seconds))
    free = F.col("completed_at").isNull() & F.col("failed_at").isNull() & (F.col("available_at") <= t) & (F.col("claimed_at").isNull() | expired)
    out = jobs.where(free).orderBy("available_at", "job_id").limit(limit)
    return out.select("job_id", (F.col("attempts") + 1).alias("attempt"), F.when(F.col("claimed_at").isNull(), F.col("available_at")).otherwise(t).alias("available_at"))


def terminal_states(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows ``(job_id, outcome)``: the first report with the current attempt ends a job; another attempt is a conflict."""
    first = reports.groupBy("job_id", "attempt").agg(F.min(F.struct("at", "kind")).alias("m"))
    joined = jobs.join(first, "job_id")
    outcome = F.when(F.col("completed_at").isNotNull() | F.col("failed_at").isNotNull(), "already_ended").when(F.col("attempt") != F.col("attempts"), "conflict").otherwise(F.col("m.kind"))
    return joined.select("job_id", "attempt", outcome.alias("outcome"))


def purge_summary(rows: DataFrame, at: str, before: str, limit: int) -> DataFrame:
    """Count, oldest and newest of what a purge of at most ``limit`` takes, and whether more is left; limit + 1 rows are looked at."""
    old = rows.where(F.col(at) < F.lit(before).cast("timestamp_ntz")).orderBy(at).select(at).limit(limit + 1)
    seen = old.agg(F.sort_array(F.collect_list(at)).alias("a"))
    taken = F.slice("a", 1, limit)
    return seen.select(F.size(taken).cast("bigint").alias("n_purged"), F.array_min(taken).alias("oldest"), F.array_max(taken).alias("newest"), (F.size("a") > limit).alias("reached_limit"))


def activity(recalls: DataFrame) -> DataFrame:
    """Rows ``(tenant_id, subject_id, seq)``: counters that recalls advance, a subject's or, with null, the tenant's."""
    return recalls.groupBy("tenant_id", "subject_id").agg(F.count("*").alias("seq"))


def activity_now(memories: DataFrame, counters: DataFrame) -> DataFrame:
    """``memories`` with ``now_seq``: the tenant's counter and that of the row's own subject, 0 where there is none."""
    tenant = counters.where("subject_id is null").select("tenant_id", F.col("seq").alias("tenant_seq"))
    own = counters.where("subject_id is not null").select("tenant_id", "subject_id", F.col("seq").alias("own_seq"))
    rows = memories.join(tenant, "tenant_id", "left").join(own, ["tenant_id", "subject_id"], "left")
    return rows.withColumn("now_seq", F.coalesce("tenant_seq", F.lit(0)) + F.coalesce("own_seq", F.lit(0))).drop("tenant_seq", "own_seq")
