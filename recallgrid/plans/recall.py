"""The read path as one lazy plan: channels, rescoring, threshold, limit, companions, association, budget, omissions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.cleaning import measured_affinity
from recallgrid.functions.decay import activity_strength, clock_strength, wall_strength
from recallgrid.functions.scoring import SCORE_THRESHOLD, affinity, freshness, partition, score_bound, tag_match, total, truncation_verdict
from recallgrid.functions.time import epoch_micros
from recallgrid.operators.outbox import activity_now
from recallgrid.operators.scope import Scope
from recallgrid.operators.search import lexical_search, vector_search, vector_search_many

LIMIT, OVER_FETCH, NEAR_MISSES = 10, 4, 5


def candidates(memories: DataFrame, vectors: DataFrame, query: Sequence[float] | None, phrases: Sequence[Sequence[str]] | None, scope: Scope, limit: int = LIMIT) -> DataFrame:
    """Rows ``(id, similarity, lexical)``: the union of both channels, each memory once with both of its scores."""
    k = limit * OVER_FETCH
    near = vector_search(memories, vectors, query, scope, k).select("id", (1 - F.col("distance")).alias("similarity")) if query is not None else None
    words = lexical_search(memories, phrases, scope, k).select("id", F.col("coverage").alias("lexical")) if phrases else None
    if near is None:
        return words.withColumn("similarity", F.lit(None).cast("double"))
    return near.join(words, "id", "full") if words is not None else near.withColumn("lexical", F.lit(None).cast("double"))


def scoring_decay(rows: DataFrame, now: str) -> Column:
    """Decay of ``rows`` at ``now`` for scores: by ``decay_clock`` and ``now_seq`` where the rows have both, else on the wall clock."""
    spark = rows.sparkSession
    ms = lambda c: epoch_micros(spark, c) / 1000.0
    base = F.coalesce(ms(F.col("last_reinforced_at")), ms(F.col("recorded_at")))
    wall = wall_strength(F.lit(1.0), base, ms(F.lit(now).cast("timestamp_ntz")), F.col("half_life_hours").cast("double"))
    if not {"decay_clock", "now_seq"} <= set(rows.columns):
        return wall
    activity = activity_strength(F.lit(1.0), F.col("decay_base_seq"), F.col("now_seq"), F.col("half_life_recalls").cast("double"))
    return clock_strength(F.col("decay_clock"), wall, activity)


def clocked(rows: DataFrame, settings: DataFrame, counters: DataFrame) -> DataFrame:
    """``rows`` with their tenant's ``decay_clock`` and their ``now_seq``."""
    return activity_now(rows, counters).join(settings.select("tenant_id", "decay_clock"), "tenant_id", "left")


@dataclass(frozen=True)
class Strategy:
    """How a candidate's score comes about, as functions that give columns; a project can put its own in.

    ``score`` takes the columns affinity, decay, freshness, tags and strength; ``bound`` gives, from the wanted tags, the most
    that the rest of the score can multiply a similarity by, or None where there is no such bound.
    """

    score: Callable[[Column, Column, Column, Column, Column], Column] = total
    bound: Callable[[Sequence[str]], float | None] = score_bound


def rescored(
    found: DataFrame, memories: DataFrame, now: str, wanted_tags: Sequence[str] = (), limit: int = LIMIT, threshold: float = SCORE_THRESHOLD, settings: DataFrame | None = None, counters: DataFrame | None = None, strategy: Strategy = Strategy()
) -> DataFrame:
    """Rows ``(id, total, part, place, at, digest_length, score)``: returned, over_limit, below_threshold or not_comparable, in rank order.

    ``score`` has the parts of the total, and whether any relevance was measured. ``found`` has at most two channels of
    limit * 4 rows, so its windows and its broadcast are small whatever the memories. With ``settings`` and ``counters`` decay
    goes by each tenant's clock, else by the wall clock.
    """
    spark = memories.sparkSession
    now_ms = epoch_micros(spark, F.lit(now).cast("timestamp_ntz")) / 1000.0
    ms = lambda c: epoch_micros(spark, F.col(c)) / 1000.0
    # The join with the few found ids comes first, so that the memories aren't shuffled for their duplicates.
    rows = memories.join(F.broadcast(found.select("id", "similarity", "lexical")), "id").dropDuplicates(["id"])
    if settings is not None and counters is not None:
        rows = clocked(rows, settings, counters)
    half = F.col("half_life_hours").cast("double")
    measured = F.col("similarity").isNotNull() | F.col("lexical").isNotNull()
    parts = F.struct(
        scoring_decay(rows, now).alias("decay"), freshness(ms("occurred_at"), now_ms, half).alias("freshness"), tag_match(F.col("tags"), wanted_tags).alias("tag_match"), F.col("strength").cast("double").alias("strength"),
        affinity(F.col("similarity"), F.col("lexical")).alias("affinity"), measured.alias("affinity_measured"), "similarity", "lexical",
    )
    rows = rows.select("id", parts.alias("score"), F.coalesce("occurred_at", "recorded_at").alias("at"), F.length("digest").alias("digest_length"))
    of = lambda c: F.col("score")[c]
    rows = rows.withColumn("total", strategy.score(of("affinity"), of("decay"), of("freshness"), of("tag_match"), of("strength")))
    rows = rows.withColumn("side", partition(F.col("total"), threshold))
    order = W.partitionBy("side").orderBy(F.isnan("total"), F.desc("total"), F.desc("at"), "id")
    rows = rows.withColumn("place", F.row_number().over(order))
    part = F.when(F.col("side") == "not_comparable", "not_comparable").when(F.col("side") == "below", "below_threshold").when(F.col("place") <= limit, "returned").otherwise("over_limit")
    return rows.select("id", "total", part.alias("part"), "place", "at", "digest_length", "score")


def truncation(scored: DataFrame, wanted_tags: Sequence[str] = (), threshold: float = SCORE_THRESHOLD, strategy: Strategy = Strategy(), lexical_ran: bool = False) -> DataFrame:
    """One row ``(bar, last_similarity, ratio, verdict)``: whether a vector beyond the search's window could have come among the returned.

    The bar is the last returned total, the threshold if none was returned. Where words were searched too a row beyond the
    window may have any relevance, so nothing can be said.
    """
    bound = None if lexical_ran else strategy.bound(wanted_tags)
    row = scored.agg(F.coalesce(F.min(F.when(F.col("part") == "returned", F.col("total"))), F.lit(threshold)).alias("bar"), F.min(F.col("score.similarity")).alias("last_similarity"))
    limit = F.lit(bound).cast("double")
    ratio = F.col("bar") / F.when(F.col("last_similarity") * limit > 0, F.col("last_similarity") * limit)
    return row.select("bar", "last_similarity", ratio.alias("ratio"), truncation_verdict(F.col("bar"), F.col("last_similarity"), limit).alias("verdict"))


def neighbourhood(found: DataFrame, seed: str, least: float, most: int) -> DataFrame:
    """Rows ``(id, affinity, place)``: the seed first, then the found whose measured relevance is ``least`` or more, the best first, ``most`` in all.

    ``found`` has at most two channels' rows, so the window is small.
    """
    near = found.select("id", measured_affinity(F.col("similarity"), F.col("lexical")).alias("affinity")).where((F.col("affinity") >= least) | (F.col("id") == seed))
    place = F.row_number().over(W.orderBy(F.desc(F.col("id") == seed), F.desc("affinity"), "id"))
    return near.withColumn("place", place).where(F.col("place") <= most)


def correction_candidates(scored: DataFrame, exclude: DataFrame, most: int = 3) -> DataFrame:
    """Rows ``(id, place, total)``: the best returned without the excluded ids; they keep their places in the recall."""
    rows = scored.where("part = 'returned'").join(exclude.select(F.lower("id").alias("id")).distinct(), "id", "left_anti")
    return rows.orderBy("place").limit(most).select("id", "place", "total")


def companions(returned: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows ``(id, companion_id)``: the other side of each returned memory's contested pair, if the pairing is mutual."""
    sides = memories.where("contested_with_id is not null").select("id", F.lower("contested_with_id").alias("other")).dropDuplicates(["id"])
    back = sides.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return returned.select("id").join(sides, "id").join(back, ["id", "other"], "left_semi").select("id", F.col("other").alias("companion_id"))


def associated(returned: DataFrame, memories: DataFrame, vectors: DataFrame, scope: Scope, now: str, anchors: int = 3, least: float = 0.5, most: int = 10, wanted_tags: Sequence[str] = ()) -> DataFrame:
    """Rows ``(id, anchor_id, anchor_similarity, rank_key, place)``: neighbours of the best returned, each with the first anchor that reaches it.

    They rank by the similarity to the anchor times the score without relevance: decay, freshness, tags and strength. Anchors,
    and what they find, are at most ``anchors`` times ``most`` * 4 rows, so the windows are small whatever the memories.
    """
    top = returned.where((F.col("part") == "returned") & (F.col("place") <= anchors)).select("id", "place")
    queries = top.join(vectors.select(F.col("memory_id").alias("id"), "embedding"), "id").select(F.col("id").alias("key"), F.col("place").alias("position"), F.col("embedding").alias("query"))
    near = vector_search_many(memories, vectors, queries, scope, most * OVER_FETCH).where((~F.isnan("distance")) & (1 - F.col("distance") >= least))
    near = near.join(F.broadcast(top.select(F.col("id").alias("key"), F.col("place").alias("anchor_place"))), "key").join(returned.where("part = 'returned'").select("id"), "id", "left_anti")
    first = near.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("anchor_place"))).where("n = 1").select("id", "key", "distance")
    nothing = F.lit(None).cast("double")
    own = rescored(first.select("id", nothing.alias("similarity"), nothing.alias("lexical")), memories.where(scope.tenant_filter()), now, wanted_tags, limit=most, threshold=float("-inf")).select("id", "total")
    similarity = 1 - F.col("distance")
    keyed = first.join(own, "id").select("id", F.col("key").alias("anchor_id"), similarity.alias("anchor_similarity"), (similarity * F.col("total")).alias("rank_key"))
    rank = F.row_number().over(W.orderBy(F.desc("rank_key"), "id"))
    return keyed.withColumn("place", rank).where(F.col("place") <= most)


def budget_cut(units: DataFrame, characters: int, tokens: int | None = None, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """The longest prefix, by ``place``, whose characters (and tokens) fit; a unit that doesn't fit ends it. Rows ``(id, place, kept)``.

    ``counter`` gives a digest's tokens from the column ``digest``, by default a token for four characters; what it counts as
    null, NaN or less than nothing ends the prefix.
    """
    before = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    fits = F.sum("digest_length").over(before) <= characters
    if tokens is not None:
        each = F.ceil(F.col("digest_length") / 4).cast("double") if counter is None else counter(F.col("digest")).cast("double")
        each = F.when((each >= 0) & ~F.isnan(each), each).otherwise(F.lit(float("inf")))
        fits = fits & (F.sum(each).over(before) <= tokens)
    return units.select("id", "place", fits.alias("kept"))


def omissions(scored: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """Counts of what the plan found and didn't return, by kind; all are exact. Rows ``promoted`` by a companion or association aren't left out."""
    rows = scored.where("part <> 'returned'")
    if promoted is not None:
        rows = rows.join(promoted.select("id").distinct(), "id", "left_anti")
    return rows.groupBy(F.col("part").alias("kind")).agg(F.count("*").alias("n_rows"))


def near_misses(scored: DataFrame, most: int = NEAR_MISSES) -> DataFrame:
    """Rows ``(id, total, place)``: the best of those below the threshold."""
    return scored.where((F.col("part") == "below_threshold") & (F.col("place") <= most)).select("id", "total", "place")
