"""Classifications and verdicts over retrieval results, and outcomes of lifecycle requests: one pass or one join each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a digest and of an empty index, by which a recall's size is estimated; fixed values.
DIGEST_CHARS, INDEX_CHARS = 15.458, 170.881


def gold_outcome(returned: Column, decayed: Column, found: Column, score: Column, threshold: float = 0.1) -> Column:
    """``returned``, ``decayed``, ``not_reached``, ``below_threshold`` or ``outranked``, the first that holds."""
    return F.when(returned, "returned").when(decayed, "decayed").when(~found, "not_reached").when(score < threshold, "below_threshold").otherwise("outranked")


def correction_order(new_rank: Column, old_rank: Column) -> Column:
    """How a corrected fact stands to the one it replaces."""
    return (
        F.when(new_rank.isNull() & old_rank.isNull(), "neither").when(old_rank.isNull(), "only_new").when(new_rank.isNull(), "only_old").when(new_rank < old_rank, "new_first").otherwise("old_first")
    )


def pair_order(newer: Column, older: Column, tie: float) -> Column:
    """Whether the newer of two scores wins, loses or ties within ``tie``."""
    return F.when(F.abs(newer - older) <= tie, "tie").when(newer > older, "newer").otherwise("older")


def outcome_counts(rows: DataFrame, outcome: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by, outcome.alias("outcome")).agg(F.count("*").alias("n_rows"))


def crossing(rows: DataFrame, by: str) -> DataFrame:
    """Trials, those with two eligible at least, those that mix subjects, their share among these, and the widest.

    ``rows`` has ``(by, trial, subject)`` of eligible candidates.
    """
    trials = rows.groupBy(by, "trial").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("subject", F.lit("\0"))).alias("span"))
    two, mixed = F.count_if(F.col("n") >= 2), F.count_if((F.col("n") >= 2) & (F.col("span") > 1))
    return trials.groupBy(by).agg(F.count("*").alias("n_trials"), two.alias("n_two"), mixed.alias("n_mixed"), F.when(two > 0, mixed / F.when(two > 0, two)).alias("mixed_share"), F.avg("n").alias("mean_eligible"), F.max("span").alias("widest"))


def margins(rows: DataFrame) -> DataFrame:
    """Rows ``(probe, margin)``: gold less distractor similarity, of ``(probe, role, similarity)``; null where one is missing."""
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("similarity")))
    return rows.groupBy("probe").agg((role("gold") - role("distractor")).alias("margin"))


def protection(rows: DataFrame) -> DataFrame:
    """Rows ``(probe, least_protected, most_other, protection_margin)`` of candidates ``(probe, id, protected, score)``; one without an id isn't protected, and a margin needs both sides."""
    kept = F.col("id").isNotNull() & F.coalesce("protected", F.lit(False))
    sides = rows.groupBy("probe").agg(F.min(F.when(kept, F.col("score"))).alias("least_protected"), F.max(F.when(~kept, F.col("score"))).alias("most_other"))
    return sides.withColumn("protection_margin", F.col("least_protected") - F.col("most_other"))


def drop_verdict(measured: DataFrame, baseline: DataFrame, times: float, least: int) -> DataFrame:
    """One row: probes whose margin fell by ``times`` the baseline's deviation, and whether there are ``least`` of them; without a deviation never."""
    spread = baseline.agg(F.stddev_samp("margin").alias("deviation"))
    both = measured.join(baseline.select("probe", F.col("margin").alias("base")), "probe").join(F.broadcast(spread))
    drops = F.count_if((F.col("base") - F.col("margin")) >= times * F.col("deviation"))
    return both.agg(drops.alias("n_drops"), (drops >= least).alias("red"))


def drift_verdict(measured: DataFrame, baseline: DataFrame, fall: float) -> DataFrame:
    """Rows ``(group_key, red)``: hit1 below the baseline's or its mrr by ``fall``; a group without a baseline isn't red."""
    base = baseline.select("group_key", F.col("hit1").alias("hit1_0"), F.col("mrr").alias("mrr_0"))
    return measured.join(base, "group_key", "left").select("group_key", F.coalesce((F.col("hit1") < F.col("hit1_0")) | (F.col("mrr_0") - F.col("mrr") >= fall), F.lit(False)).alias("red"))


def equal_terms(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(a) == F.col(b)).alias("n_equal"), F.count("*").alias("n_rows"))


def footprint(rows: DataFrame, by: str) -> DataFrame:
    """Rows ``(by, n, chars, tokens, estimate, saturated)`` of digests: their size, a token for four characters, the estimate from counts, and whether 50 are reached."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(F.length("digest")).alias("chars"), F.sum(F.ceil(F.length("digest") / 4)).alias("tokens"),
        (F.count("*") * DIGEST_CHARS + INDEX_CHARS).alias("estimate"), (F.count("*") >= 50).alias("saturated"),
    )


def preserved(answer: Column, accepted: Column) -> Column:
    """Whether an answer holds any accepted term."""
    return F.exists(accepted, lambda t: F.contains(answer, t))


def reconciled(first: Column, second: Column) -> Column:
    return F.when(first == second, first).otherwise("indeterminate")


#: Statuses that an operation applies to, and what it makes of them; fixed values.
REQUESTS = {
    "forget": (("active", "contested", "archived", "superseded"), "forgotten"), "restore_archived": (("archived",), "active"), "restore_superseded": (("superseded",), "active"),
    "contest": (("active",), "contested"), "resolve_both": (("contested",), "active"), "archive": (("active",), "archived"),
}


def requested(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows ``(id, operation, outcome, status)``: done, already (it has the status), refused or not_found; each request once."""
    state = memories.select("id", "status").dropDuplicates(["id"])
    joined = requests.select(F.lower("id").alias("id"), "operation").distinct().join(state, "id", "left")
    target = applies = None
    for op, (before, after) in REQUESTS.items():
        is_op = F.col("operation") == op
        target = F.when(is_op, after) if target is None else target.when(is_op, after)
        hit = is_op & F.col("status").isin(*before)
        applies = hit if applies is None else applies | hit
    outcome = F.when(F.col("status").isNull(), "not_found").when(applies, "done").when(F.col("status") == target, "already").otherwise("refused")
    return joined.select("id", "operation", outcome.alias("outcome"), F.when(applies, target).otherwise(F.col("status")).alias("status"))


def reextracted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows ``(id, decision)`` of the memories of re-extracted observations: skip what isn't active, keep unchanged hashes, else supersede."""
    hashes = new.select("source_observation_id", "content_hash").distinct().withColumn("_there", F.lit(True))
    rows = old.dropDuplicates(["id"]).join(new.select("source_observation_id").distinct(), "source_observation_id", "left_semi").join(hashes, ["source_observation_id", "content_hash"], "left")
    return rows.select("id", F.when(F.col("status") != "active", "skip").when(F.col("_there"), "unchanged").otherwise("supersede").alias("decision"))


def erasure(tables: dict[str, DataFrame], tenant: str, limit: int) -> DataFrame:
    """Rows ``(table_name, n_rows, more)``: what erasing a tenant takes from each table, at most ``limit`` each."""
    out = None
    for name, df in tables.items():
        one = df.where(F.col("tenant_id") == tenant).limit(limit + 1).agg(F.count("*").alias("n"))
        one = one.select(F.lit(name).alias("table_name"), F.least("n", F.lit(limit)).cast("bigint").alias("n_rows"), (F.col("n") > limit).alias("more"))
        out = one if out is None else out.unionByName(one)
    return out


def expired_with_uses(recalls: DataFrame, uses: DataFrame, before: str) -> DataFrame:
    """Rows ``(recall_id, n_uses)``: recalls from before a moment, with the uses that go with them."""
    old = recalls.where(F.col("at") < F.lit(before).cast("timestamp_ntz")).select("recall_id")
    n = uses.groupBy("recall_id").agg(F.count("*").alias("n_uses"))
    return old.join(n, "recall_id", "left").select("recall_id", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


def in_registry(memories: DataFrame, registry: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids whose tags hold a wanted label that their tenant has registered; of ``registry`` one row a (tenant, label) counts."""
    names = registry.where(F.col("label").isin(wanted)).select("tenant_id", "label").distinct()
    rows = memories.select("id", "tenant_id", F.explode("tags").alias("label")).where(F.col("label").isin(wanted))
    return rows.join(names, ["tenant_id", "label"], "left_semi").select("id").distinct()


def usage_mismatches(uses: DataFrame, recalls: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows ``(usage_id, other_recall, other_memory)``: uses ``(usage_id, tenant_id, recall_id, memory_id)`` whose recall ``(recall_id, recall_tenant)`` or memory ``(memory_id, memory_tenant)`` is another tenant's."""
    rows = uses.join(recalls, "recall_id").join(memories, "memory_id")
    return rows.select("usage_id", (F.col("recall_tenant") != F.col("tenant_id")).alias("other_recall"), (F.col("memory_tenant") != F.col("tenant_id")).alias("other_memory"))
