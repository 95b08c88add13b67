"""Structured Streaming counterparts: idempotent ingest, activity counters, first terminal report of a job, reinforcement, late events, ticks.

All but ``tick`` take a streaming DataFrame and give one; ``run_available`` reads what is there and stops, which batch tests use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_once(observations: DataFrame, lateness: str = "28 days") -> DataFrame:
    """Observations without later deliveries of an external id; state is kept for ``lateness`` of recorded time, rows later than that are left out."""
    keyed = observations.withColumn("record_key", F.coalesce("external_id", "id")).withColumn("arrived", F.col("recorded_at").cast("timestamp"))
    return keyed.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["tenant_id", "record_key"])


def activity_counters(events: DataFrame) -> DataFrame:
    """Running counts of a tenant's events."""
    return events.groupBy("tenant_id").agg(F.count("*").alias("seq"))


def last_uses(usages: DataFrame) -> DataFrame:
    """The last use of each memory; a maximum doesn't depend on the order of arrival."""
    return usages.groupBy("memory_id").agg(F.max("used_at").alias("used_at"))


def first_reports(reports: DataFrame) -> DataFrame:
    """The first report of each (job, attempt)."""
    return reports.groupBy("job_id", "attempt").agg(F.min(F.struct("at", "kind")).alias("first")).select("job_id", "attempt", F.col("first.at").alias("at"), F.col("first.kind").alias("kind"))


def arrival_cells(observations: DataFrame, disorder: str = "2 days", cutoff: str = "96 hours") -> DataFrame:
    """Rows ``(tenant_id, period_day, arrival, n_obs)``: the triangle of event days by arrival days, each cell once its arrival day is over.

    The watermark is on the recorded time, which runs nearly in order, so a wrong clock in the event time makes nothing late;
    deliveries of one external id within ``disorder`` count once. ``cutoff`` counts from the start of the event day.
    """
    rows = ingest_once(observations, disorder)
    day = F.date_trunc("day", F.coalesce("occurred_at", "recorded_at")).cast("timestamp_ntz")
    rows = rows.withColumn("period_day", day).where(F.col("recorded_at") < F.col("period_day") + F.expr(f"interval {cutoff}"))
    return rows.groupBy("tenant_id", "period_day", F.window("arrived", "1 day").alias("arrival")).agg(F.count("*").alias("n_obs"))


def tick(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], done: Callable[[str, int, str | None], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Starts the job loop: each batch goes to the handlers by kind; what became of a kind's jobs is told to ``done(kind, n, error)``.

    ``jobs`` has ``(job_id, attempt, kind)``; a job that comes twice in a batch is done once. A handler that fails leaves the
    other kinds' jobs alone; kinds without a handler are told as failed. With an ``interval`` it runs on, as a periodic driver;
    without one it does what is there and ends, as an inline scheduler. Batches come one after another.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["job_id", "attempt"]).persist()
        try:
            for kind, n in sorted((r.kind, r["count"]) for r in rows.groupBy("kind").count().collect()):  # one row a kind
                if kind not in handlers:
                    done(kind, n, "no handler")
                    continue
                try:
                    handlers[kind](rows.where(F.col("kind") == kind))
                except Exception as error:  # noqa: BLE001  the jobs of other kinds go on
                    done(kind, n, str(error))
                else:
                    done(kind, n, None)
        finally:
            rows.unpersist()

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> None:
    """Runs a stream over what is there into the memory table ``name``."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
