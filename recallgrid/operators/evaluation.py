"""Retrieval and detection quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retrieval_quality(ranks: DataFrame) -> DataFrame:
    """One row of mean reciprocal rank (of all, control and other probes), hits at 1 and 10; ``ranks`` has ``(probe_id, rank, control)``, rank null if missed."""
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return ranks.agg(
        F.count("*").alias("n_probes"), mean(rr).alias("mrr"), mean(F.when(F.col("control"), rr)).alias("mrr_control"), mean(F.when(~F.col("control"), rr)).alias("mrr_other"),
        F.count_if(F.col("rank") == 1).alias("hit1"), F.count_if(F.col("rank") <= 10).alias("hit10"),
    )


def detection_quality(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Confusion counts, precision, recall and F1 of ``(gold, found)``; undefined ratios are null."""
    gold, found = F.col("gold"), F.col("found")
    counts = [F.count_if(gold & found).alias("tp"), F.count_if(~gold & found).alias("fp"), F.count_if(gold & ~found).alias("fn"), F.count_if(~gold & ~found).alias("tn")]
    out = rows.groupBy(by).agg(*counts) if by else rows.agg(*counts)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def term_spread(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows ``(term, n, least, most, spread, n_distinct)`` of score terms, in one pass."""
    long = rows.select(F.explode(F.create_map(*[x for t in terms for x in (F.lit(t), F.col(t).cast("double"))])).alias("term", "value"))
    return long.groupBy("term").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), (F.max("value") - F.min("value")).alias("spread"), F.count_distinct("value").alias("n_distinct"))


def tie_runs(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """Rows ``(by, coverage, rank, n, splits)``: runs of equal (coverage, rank) in rank order, and whether the limit divides one.

    Equal values are neighbours in that order, so runs are groups and their places running sums over groups.
    """
    groups = rows.groupBy(by, "coverage", "rank").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(by).orderBy(F.desc("coverage"), F.desc("rank")))
    return groups.withColumn("upto", upto).select(by, "coverage", "rank", "n", ((F.col("upto") > limit) & (F.col("upto") - F.col("n") < limit)).alias("splits"))


def margin_statistics(rows: DataFrame, margin: Column) -> DataFrame:
    """Count, mean, sample deviation, least and most of the margins that aren't null."""
    return rows.agg(F.count(margin).alias("n"), F.avg(margin).alias("mean"), F.stddev_samp(margin).alias("deviation"), F.min(margin).alias("least"), F.max(margin).alias("most"))


def red_windows(runs: DataFrame, n: int, k: int) -> DataFrame:
    """One row: share of the disjoint windows of ``n`` consecutive runs with at least ``k`` red ones; a partial last window is dropped.

    ``runs`` has ``(position, red)`` with positions from 0 without gaps.
    """
    windows = runs.groupBy(F.floor(F.col("position") / n).alias("w")).agg(F.count("*").alias("size"), F.count_if("red").alias("reds")).where(F.col("size") == n)
    return windows.agg(F.count("*").alias("n_windows"), F.count_if(F.col("reds") >= k).alias("n_red"))


def at_least(n: int, k: int, p: float) -> float:
    """Probability of at least ``k`` of ``n`` at ``p``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided p of a sign test; 1 without discordant pairs."""
    n = wins + losses
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def clopper_pearson_upper(k: int, n: int, alpha: float = 0.05) -> float:
    """Upper bound of a share of ``k`` of ``n``, by bisection of the exact binomial tail."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - at_least(n, k + 1, mid) > alpha / 2 else (low, mid)
    return (low + high) / 2


def noisy_ranks(scored: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Rows ``(probe_id, id, place)`` after each score is perturbed by ``sigma`` and ``seed``; equal scores go by id."""
    noisy = perturbed(F.col("score"), F.lit(sigma), F.lit(seed), "probe_id", "id")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("probe_id").orderBy(F.desc(noisy), "id"))).select("probe_id", "id", "place")


def list_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: positions that differ, the matching prefix, ids in one list only; ``a`` and ``b`` have ``(position, id)``."""
    both = a.select("position", F.col("id").alias("ia")).join(b.select("position", F.col("id").alias("ib")), "position", "full")
    differs = ~F.col("ia").eqNullSafe(F.col("ib"))
    ids = a.select("id", F.lit(1).alias("ina")).join(b.select("id", F.lit(1).alias("inb")), "id", "full").agg(F.count_if(F.col("inb").isNull()).alias("only_a"), F.count_if(F.col("ina").isNull()).alias("only_b"))
    out = both.agg(F.count_if(differs).alias("n_different"), F.coalesce(F.min(F.when(differs, F.col("position"))), F.count("*")).alias("prefix"))
    return out.join(F.broadcast(ids))  # one row each


def pair_outcomes(trials: DataFrame) -> DataFrame:
    """Rows ``(pair, n, off_passed, on_passed, off_rate, on_rate)`` of paired trials ``(pair, off_verdict, on_verdict)``; a verdict other than ``correct`` isn't passed."""
    passed = lambda c: F.count_if(F.coalesce(F.col(c) == "correct", F.lit(False)))
    out = trials.groupBy("pair").agg(F.count("*").alias("n"), passed("off_verdict").alias("off_passed"), passed("on_verdict").alias("on_passed"))
    return out.withColumns({"off_rate": F.col("off_passed") / F.col("n"), "on_rate": F.col("on_passed") / F.col("n")})


def superseded_groups(rows: DataFrame) -> DataFrame:
    """Rows ``(reason, group_key, n_rows, first_id, confidence)``: consolidated memories are one group (``structural``), resolved ones stand alone (``per_item``), others are one group a reason (``unknown``).

    ``rows`` has ``(id, reason)``; no reason is a reason of its own.
    """
    alone = F.coalesce(F.col("reason") == "contested_resolved", F.lit(False))
    confidence = F.when(F.col("reason") == "consolidated", "structural").when(alone, "per_item").otherwise("unknown")
    return rows.groupBy("reason", F.when(alone, F.col("id")).alias("group_key"), confidence.alias("confidence")).agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"))


def intrusion(rows: DataFrame) -> DataFrame:
    """Rows ``(probe, intrusion_margin)`` of candidates ``(probe, id, protected, score, place)``: the first one's score less the least protected score; null unless the first is protected."""
    kept = F.col("id").isNotNull() & F.coalesce("protected", F.lit(False))
    top = F.max(F.when(F.col("place") == 1, F.col("score")))
    held = F.bool_or((F.col("place") == 1) & kept)
    return rows.groupBy("probe").agg(F.when(held, top - F.min(F.when(kept, F.col("score")))).alias("intrusion_margin"))


def perturbed(score: Column, sigma: Column, seed: Column, *key: str) -> Column:
    """A score times 1 + sigma e, with e in [-1, 1) from the first 32 bits of an MD5 of seed and key, which other engines have too."""
    text = F.concat_ws("|", seed.cast("string"), *[F.col(k).cast("string") for k in key])
    e = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**31) - 1
    return score * (1 + sigma * e)


def noise_grid(sparse: DataFrame, dense: DataFrame, sigmas: list[float], seeds: list[int], fall: float) -> DataFrame:
    """Rows ``(sigma, seed, sparse_mrr, dense_mrr, mrr_match, red_match)``: whether two sets of candidates give the same figures under the same noise.

    Both have ``(probe_id, id, score, gold)``. A round is red where its mean reciprocal rank falls by ``fall`` or more from that
    without noise. The grid is a short list of the caller's, so every candidate is repeated for it by ``explode``.
    """
    grid = F.array(*[F.struct(F.lit(float(s)).alias("sigma"), F.lit(n).alias("seed")) for s in [0.0, *sigmas] for n in seeds])

    def figures(rows: DataFrame, name: str) -> DataFrame:
        noisy = rows.select("*", F.inline(grid)).withColumn("noisy", perturbed(F.col("score"), F.col("sigma"), F.col("seed"), "probe_id", "id"))
        gold = noisy.where("gold").groupBy("sigma", "seed", "probe_id").agg(F.max("noisy").alias("best"))
        # A rank is one more than the number of candidates above the best gold one: a join by probe and a count, no sort.
        above = noisy.join(gold, ["sigma", "seed", "probe_id"]).groupBy("sigma", "seed", "probe_id").agg((F.count_if(F.col("noisy") > F.col("best")) + 1).alias("rank"))
        return above.groupBy("sigma", "seed").agg(F.avg(1.0 / F.col("rank")).alias(name))

    both = figures(sparse, "sparse_mrr").join(figures(dense, "dense_mrr"), ["sigma", "seed"])
    first = both.where("sigma = 0").select("seed", F.col("sparse_mrr").alias("s0"), F.col("dense_mrr").alias("d0"))
    red = lambda now, base: (F.col(base) - F.col(now)) >= fall
    out = both.where("sigma > 0").join(F.broadcast(first), "seed")  # one row a seed
    return out.select("sigma", "seed", "sparse_mrr", "dense_mrr", (F.abs(F.col("sparse_mrr") - F.col("dense_mrr")) < 1e-12).alias("mrr_match"), (red("sparse_mrr", "s0") == red("dense_mrr", "d0")).alias("red_match"))


def association_report(probes: DataFrame, by: str) -> DataFrame:
    """Rows ``(by, n_probes, gold_returned, via_association, hit1, hit10, mrr, returned, memory_chars, association_chars, n_skipped)`` of an arm's probes."""
    true = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rank = F.col("rank")
    return probes.groupBy(by).agg(
        F.count("*").alias("n_probes"), true(rank.isNotNull()).alias("gold_returned"), true(F.col("via") == "association").alias("via_association"), true(rank == 1).alias("hit1"), true(rank <= 10).alias("hit10"),
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"), F.sum("returned").alias("returned"), F.sum("memory_chars").alias("memory_chars"), F.sum("association_chars").alias("association_chars"), true(F.col("skipped").isNotNull()).alias("n_skipped"),
    )
