"""Lifecycle operators as new versions of rows: no in-place change, each is a filter, a join or one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.cleaning import cut_col
from recallgrid.functions.decay import wall_floor_ms
from recallgrid.functions.time import epoch_micros


def one_each(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the same id are one record."""
    return df.dropDuplicates([key])


def reinforced(memories: DataFrame, usages: DataFrame) -> DataFrame:
    """Rows ``(id, last_reinforced_at, floor_ms)`` of the memories whose last use moves forward; the strength stays.

    ``usages`` has ``(memory_id, used_at)``; its maximum is taken before the join, so order and repetition don't matter.
    """
    last = usages.where("memory_id is not null").groupBy(F.lower("memory_id").alias("id")).agg(F.max("used_at").alias("used_at"))
    rows = one_each(memories).join(last, "id").where("last_reinforced_at is null or used_at > last_reinforced_at")
    ms = epoch_micros(memories.sparkSession, F.col("used_at")) / 1000.0
    return rows.select("id", F.col("used_at").alias("last_reinforced_at"), wall_floor_ms(F.col("strength").cast("double"), ms, F.col("half_life_hours").cast("double")).alias("floor_ms"))


def archive_sweep(memories: DataFrame, now: str, limit: int) -> DataFrame:
    """Active memories whose decay floor has come, the earliest first."""
    dead = (F.col("status") == "active") & (F.col("decay_floor_at") <= F.lit(now).cast("timestamp_ntz"))
    return one_each(memories.where(dead)).orderBy("decay_floor_at", "id").limit(limit).select("id", "decay_floor_at")


def requeue(memories: DataFrame, limit: int) -> DataFrame:
    """Live memories that still need an embedding, the longest unchanged first."""
    wanted = F.col("status").isin("active", "contested") & F.coalesce(F.col("embedding_status") != "ready", F.lit(True))
    return one_each(memories.where(wanted)).orderBy("updated_at", "id").limit(limit).select("id", "updated_at")


def expired_events(events: DataFrame, settings: DataFrame, now: str) -> DataFrame:
    """Events past their tenant's retention; the record of a purge itself stays. A tenant without a retention keeps all."""
    # tenant_settings has one row a tenant; the planner broadcasts it while it is small.
    days = settings.where("event_retention_days is not null").select("tenant_id", "event_retention_days")
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.col("event_retention_days"))
    return one_each(events).join(days, "tenant_id").where((F.col("event_at") < cutoff) & (F.col("kind") != "events_purged"))


def purged_content(memories: DataFrame, events: DataFrame) -> DataFrame:
    """Tombstones of purged memories: texts gone, keys, subject and hash kept."""
    gone = events.where("kind = 'purged'").select(F.lower("memory_id").alias("id")).distinct()
    return one_each(memories).join(gone, "id", "left_semi").select("id", "tenant_id", "subject_id", "content_hash", F.lit("").alias("content"), F.lit("").alias("digest"), F.lit("forgotten").alias("status"))


#: What each operation does to each status, and else leaves alone; fixed values.
TRANSITIONS = [("active", "superseded", "superseded"), ("active", "archived", "archived"), ("archived", "restored", "active"), ("superseded", "unsuperseded", "active"), ("active", "forgotten", "forgotten"), ("contested", "forgotten", "forgotten"), ("archived", "forgotten", "forgotten"), ("superseded", "forgotten", "forgotten"), ("active", "updated", "active"), ("contested", "updated", "contested")]


def _step(state: Column, kind: Column) -> Column:
    out = None
    for before, operation, after in TRANSITIONS:
        hit = (state == before) & (kind == operation)
        out = F.when(hit, F.lit(after)) if out is None else out.when(hit, F.lit(after))
    return out.otherwise(state)


def replayed_status(events: DataFrame) -> DataFrame:
    """Rows ``(memory_id, status, n_events)``: the status that a memory's events, in order of time and sequence, lead to from active.

    A memory's events are one array; a memory has few, the log of a tenant is never collected.
    """
    rows = one_each(events.where("memory_id is not null"))
    logs = rows.groupBy(F.lower("memory_id").alias("memory_id")).agg(F.array_sort(F.collect_list(F.struct("event_at", "seq", "kind"))).alias("log"))
    return logs.select("memory_id", F.aggregate("log", F.lit("active"), lambda s, e: _step(s, e["kind"])).alias("status"), F.size("log").cast("bigint").alias("n_events"))


def consolidated(memories: DataFrame, group: Column, least: int = 2) -> DataFrame:
    """One row a group of at least ``least`` memories: common subject, tags in first-seen order, validity all share, last event, attributes all agree on.

    Sources are seen by recorded time and id. Tags and attributes are counted per group and value first, so that a buffer has a
    group's distinct tags and not its rows. ``attributes`` is a sorted list of ``name=value``.
    """
    rows = one_each(memories).withColumn("_g", group).where("_g is not null")
    sizes = rows.groupBy("_g").agg(
        F.count("*").alias("n_sources"),
        F.when((F.count("subject_id") == F.count("*")) & (F.min("subject_id") == F.max("subject_id")), F.max("subject_id")).alias("subject_id"),
        F.max("occurred_at").alias("occurred_at"),
        F.max("valid_from").alias("valid_from"),
        F.min("valid_until").alias("valid_until"),
    )
    seen = rows.select("_g", "recorded_at", "id", F.posexplode("tags").alias("at", "tag")).groupBy("_g", "tag").agg(F.min(F.struct("recorded_at", "id", "at")).alias("first"))
    tags = seen.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("tags"))
    shared = rows.select("_g", F.explode("attributes").alias("k", "v")).groupBy("_g", "k", "v").agg(F.count("*").alias("n"))
    shared = shared.join(sizes.select("_g", "n_sources"), "_g").where("n = n_sources").groupBy("_g").agg(F.array_sort(F.collect_list(F.concat("k", F.lit("="), "v"))).alias("attributes"))
    out = sizes.where(F.col("n_sources") >= least).join(tags, "_g", "left").join(shared, "_g", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("_g").alias("group_key"), "n_sources", "subject_id", "occurred_at", "valid_from", "valid_until", F.coalesce("tags", none).alias("tags"), F.coalesce("attributes", none).alias("attributes"))


def places(rows: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``: their numbers from 0 within ``by``, by the time ``at`` and then ``order``.

    A group may hold any share of the rows, so it is numbered in two levels: hours are counted, the counts' running sums are
    the offsets, and rows are numbered within their hour. A null time comes first.
    """
    hour = F.coalesce(F.date_trunc("hour", at).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    rows = rows.withColumn("_hour", hour)
    counts = rows.groupBy(*by, "_hour").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_hour").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*by, "_hour", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*by, "_hour").orderBy(at, *order))
    return rows.withColumn("_own", own).join(counts, [*by, "_hour"]).withColumn("place", F.col("_before") + F.col("_own") - 1).drop("_hour", "_own", "_before")


def chunks(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows ``(id, chunk)`` of fixed-size groups within ``by``; a last chunk of one row is left out. ``by`` isn't null."""
    out = places(rows, [by], order, ["id"]).select("id", by, F.floor(F.col("place") / size).alias("chunk"))
    return out.withColumn("n", F.count("*").over(W.partitionBy(by, "chunk"))).where("n > 1").select("id", by, "chunk")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last write of each key wins."""
    both = old.unionByName(new)
    value = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in value if c != at])).alias("m"))
    return latest.select(*keys, *[F.col("m")[c].alias(c) for c in value])


def inserted_once(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there, each key once."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def activity_dead(floor_seq: Column, now_seq: Column) -> Column:
    """Whether a memory's counter floor has come; one without a floor never dies by activity."""
    return floor_seq.isNotNull() & (floor_seq <= now_seq)


def archive_sweep_by_clock(rows: DataFrame, now: str) -> DataFrame:
    """Rows ``(id, decay_floor_at)`` of active memories that are dead on their tenant's clock: wall, activity, or both of them for ``either``.

    ``rows`` are memories with ``decay_clock`` and ``now_seq``; without a clock the wall's counts.
    """
    wall = F.col("decay_floor_at") <= F.lit(now).cast("timestamp_ntz")
    activity = activity_dead(F.col("decay_floor_seq"), F.col("now_seq"))
    dead = F.when(F.col("decay_clock") == "activity", activity).when(F.col("decay_clock") == "either", wall & activity).otherwise(wall)
    return one_each(rows.where((F.col("status") == "active") & F.coalesce(dead, F.lit(False)))).select("id", "decay_floor_at")


def contested_groups(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows ``(group_id, id, outcome, status)`` of requests ``(group_id, id)`` to contest: a group of two or more is marked if all are active, else refused as a whole."""
    state = one_each(memories).select("id", "status")
    rows = groups.select("group_id", F.lower("id").alias("id")).distinct().join(state, "id", "left")
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("status") == "active", F.lit(False))).alias("active"))
    done = (F.col("n") >= 2) & (F.col("n") == F.col("active"))
    return rows.join(sizes, "group_id").select("group_id", "id", F.when(done, "contested").otherwise("refused").alias("outcome"), F.when(done, "contested").otherwise(F.col("status")).alias("status"))


def resolved(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows ``(id, outcome, status, superseded_by_id)`` of requests ``(winner_id, loser_id)``: the winner of a mutual contested pair becomes active, the loser superseded by it.

    A pair that isn't contested with each other is refused, and both keep their status. Without a loser a winner whose partner
    is missing or no longer contested with it (an orphan) becomes active.
    """
    state = one_each(memories).select("id", "status", F.lower("contested_with_id").alias("other"))
    asked = requests.select(F.lower("winner_id").alias("winner_id"), F.lower("loser_id").alias("loser_id")).distinct()
    w = state.select(F.col("id").alias("winner_id"), F.col("status").alias("w_status"), F.col("other").alias("w_other"))
    partner = state.select(F.col("id").alias("w_other"), F.col("status").alias("p_status"), F.col("other").alias("p_other"))
    rows = asked.join(w, "winner_id", "left").join(partner, "w_other", "left")
    contested = F.coalesce(F.col("w_status") == "contested", F.lit(False))
    mutual = contested & F.coalesce((F.col("p_status") == "contested") & (F.col("p_other") == F.col("winner_id")), F.lit(False))
    pair = mutual & F.coalesce(F.col("w_other") == F.col("loser_id"), F.lit(False))
    orphan = contested & ~mutual & F.col("loser_id").isNull()
    outcome = F.when(pair, "resolved").when(orphan, "orphan_resolved").otherwise("refused")
    winners = rows.select(F.col("winner_id").alias("id"), outcome.alias("outcome"), F.when(pair | orphan, "active").otherwise(F.col("w_status")).alias("status"), F.lit(None).cast("string").alias("superseded_by_id"))
    losers = rows.where("loser_id is not null").select(F.col("loser_id").alias("id"), outcome.alias("outcome"), pair.alias("pair"), "winner_id").join(state.select("id", F.col("status").alias("s")), "id", "left")
    losers = losers.select("id", "outcome", F.when(F.col("pair"), "superseded").otherwise(F.col("s")).alias("status"), F.when(F.col("pair"), F.col("winner_id")).alias("superseded_by_id"))
    return winners.unionByName(losers)


def reflected(memories: DataFrame, group: Column, contents: DataFrame, least: int = 2, digest_units: int = 120) -> DataFrame:
    """One new row a group: what ``consolidated`` gives, with the text written for it, its digest, hash, sorted sources and provenance.

    ``contents`` has ``(group_key, content, digest, tags)``; without a digest it is the text's beginning, a null list of tags
    leaves the sources' tags, blank tags are dropped. A group without a text, or with an empty one, comes to nothing.
    """
    built = consolidated(memories, group, least).withColumnRenamed("tags", "_tags")
    sources = one_each(memories).withColumn("group_key", group).groupBy("group_key").agg(F.array_sort(F.collect_list("id")).alias("sources"))
    rows = built.join(contents.where("content is not null and content <> ''"), "group_key").join(sources, "group_key")
    own = F.filter("tags", lambda t: F.trim(t) != "")
    return rows.select(
        "group_key", "n_sources", "sources", "subject_id", "content", F.sha2("content", 256).alias("content_hash"), F.coalesce(F.when(F.col("digest") != "", F.col("digest")), cut_col(F.col("content"), digest_units)).alias("digest"),
        F.coalesce(own, F.col("_tags")).alias("tags"), "attributes", "occurred_at", "valid_from", "valid_until", F.lit("reflected").alias("provenance_kind"),
    )


def corrected(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rows ``(id, new_id, outcome)`` of corrections ``(id, new_id)``: an active memory is superseded by the new one; already so, refused or not found."""
    state = one_each(memories).select("id", "status", F.lower("superseded_by_id").alias("by"))
    rows = corrections.select(F.lower("id").alias("id"), F.lower("new_id").alias("new_id")).distinct().join(state, "id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "active", "superseded").when((F.col("status") == "superseded") & (F.col("by") == F.col("new_id")), "already").otherwise("refused")
    return rows.select("id", "new_id", outcome.alias("outcome"))


def candidate_subject(given: Column, own: Column, observed: Column) -> Column:
    """A candidate's subject if it was given, be it null, else the observation's."""
    return F.when(given, own).otherwise(observed)
