"""Integrity and cross-reference checks: each is empty on clean data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of statuses; fixed values.
STATUSES = ["active", "superseded", "contested", "archived", "forgotten"]
EMBEDDING = ["pending", "ready", "failed", "skipped"]


def violations(memories: DataFrame) -> DataFrame:
    """Rows ``(rule, n_rows)`` of the stored rules that rows break, in one pass."""
    kind = F.get_json_object("provenance", "$.kind")
    half = F.col("half_life_hours")
    rules = {
        "strength": ~((F.col("strength") > 0) & (F.col("strength") <= 1)),
        "half_life": ~((half > 0) & (half < float("inf"))),
        "needs_source": F.col("provenance_kind").isin("stated", "inferred") & F.col("source_observation_id").isNull(),
        "kind_matches": ~F.coalesce(kind == F.col("provenance_kind"), F.lit(False)),
        "status": ~F.col("status").isin(STATUSES),
        "embedding_status": ~F.col("embedding_status").isin(EMBEDDING),
        "inverted_validity": F.col("valid_until") <= F.col("valid_from"),
        "superseded_link": (F.col("status") == "superseded") & F.col("superseded_by_id").isNull(),
    }
    one = memories.dropDuplicates(["id"]).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "n_rows"))


def foreign_references(memories: DataFrame, observations: DataFrame) -> DataFrame:
    """Rows ``(kind, id, other_id)`` of references that lead to another tenant's row."""
    rows = memories.dropDuplicates(["id"])
    target = rows.select(F.col("id").alias("other_id"), F.col("tenant_id").alias("other_tenant"))
    links = [
        rows.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), "id", "tenant_id", F.lower(c).alias("other_id")).join(target, "other_id")
        for c in ("superseded_by_id", "contested_with_id")
    ]
    seen = observations.dropDuplicates(["id"]).select(F.col("id").alias("other_id"), F.col("tenant_id").alias("other_tenant"))
    links.append(rows.where("source_observation_id is not null").select(F.lit("source_observation_id").alias("kind"), "id", "tenant_id", F.lower("source_observation_id").alias("other_id")).join(seen, "other_id"))
    return reduce(DataFrame.unionByName, links).where("tenant_id <> other_tenant").select("kind", "id", "other_id")


def stated_basis(memories: DataFrame) -> DataFrame:
    """Rows ``(id, basis_id)`` of the inferred memories: the memories that their provenance lists, else the stated ones of their source observation."""
    rows = one_each_with_lower(memories)
    listed = F.from_json(F.get_json_object("provenance", "$.basis.memoryIds"), "array<string>")
    inferred = rows.where("provenance_kind = 'inferred'").select("id", "tenant_id", "source", listed.alias("listed"))
    named = inferred.where("listed is not null").select("id", F.explode("listed").alias("b")).select("id", F.lower("b").alias("basis_id"))
    stated = rows.where("provenance_kind = 'stated' and source is not null").select("tenant_id", "source", F.col("id").alias("basis_id"))
    return named.unionByName(inferred.where("listed is null").join(stated, ["tenant_id", "source"]).select("id", "basis_id"))


def one_each_with_lower(memories: DataFrame) -> DataFrame:
    return memories.dropDuplicates(["id"]).withColumn("source", F.lower("source_observation_id"))


def basis_lost(memories: DataFrame, basis: DataFrame) -> DataFrame:
    """Rows ``(id, n_basis, n_lost)`` of the memories that have lost a basis: it is missing, forgotten or purged. ``basis`` has ``(id, basis_id)``.

    Archived and superseded memories keep their text, so they don't count as lost; a memory without a basis has no row.
    """
    target = memories.dropDuplicates(["id"]).select(F.col("id").alias("basis_id"), ((F.col("status") == "forgotten") | F.col("purged_at").isNotNull()).alias("gone"))
    lost = F.count_if(F.coalesce("gone", F.lit(True)))
    return basis.distinct().join(target, "basis_id", "left").groupBy("id").agg(F.count("*").alias("n_basis"), lost.alias("n_lost")).where("n_lost > 0")


def one_sided_pairs(memories: DataFrame) -> DataFrame:
    """Contested memories whose partner isn't contested with them."""
    sides = memories.dropDuplicates(["id"]).where("contested_with_id is not null").select("id", F.lower("contested_with_id").alias("other"))
    return sides.join(sides.select(F.col("id").alias("other"), F.col("other").alias("id")), ["id", "other"], "left_anti").select("id")


def claim_conflicts(memories: DataFrame) -> DataFrame:
    """Rows ``(id, n_overlaps)``: live memories of one tenant, subject and claim whose validity overlaps that of others, with the number of these.

    No pairs are made: an interval overlaps all that start before its end, without those that end by its start, which are two
    running counts over the boundaries of the claim. Both are sums by hour first, so a claim of any size spreads over tasks.
    Empty and inverted intervals overlap nothing.
    """
    from pyspark.sql import Window as W

    from recallgrid.functions.time import epoch_micros

    keys = ["tenant_id", "subject_id", "claim_key_subject", "claim_key_predicate"]
    micros = lambda c: epoch_micros(memories.sparkSession, F.col(c))
    low, high = F.lit(-(2**62)), F.lit(2**62)
    rows = memories.dropDuplicates(["id"]).where(F.col("status").isin("active", "contested")).dropna(subset=keys)
    rows = rows.select(*keys, "id", F.coalesce(micros("valid_from"), low).alias("a"), F.coalesce(micros("valid_until"), high).alias("b")).where("a < b")
    marks = rows.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("b").alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")))))
    marks = marks.withColumn("h", F.expr("t div 3600000000")).groupBy(*keys, "h", "t").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    by_hour = W.partitionBy(*keys).orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    hours = marks.groupBy(*keys, "h").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    hours = hours.select(*keys, "h", F.coalesce(F.sum("s").over(by_hour), F.lit(0)).alias("s0"), F.coalesce(F.sum("e").over(by_hour), F.lit(0)).alias("e0"))
    inside = W.partitionBy(*keys, "h").orderBy("t")
    upto = marks.join(hours, [*keys, "h"]).select(*keys, "t", (F.col("s0") + F.coalesce(F.sum("s").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("started"), (F.col("e0") + F.sum("e").over(inside.rowsBetween(W.unboundedPreceding, 0))).alias("ended"))
    ends = rows.join(upto.select(*keys, F.col("t").alias("b"), "started"), [*keys, "b"])
    both = ends.join(upto.select(*keys, F.col("t").alias("a"), "ended"), [*keys, "a"])
    return both.select("id", (F.col("started") - F.col("ended") - 1).alias("n_overlaps")).where("n_overlaps > 0")
