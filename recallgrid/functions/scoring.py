"""Scores of retrieved memories. NaN is kept apart: in Spark it equals itself and is above all numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.decay import decay_factor

#: Weight of the score that time can't take away, bonus of a matching tag, least score returned; fixed values.
TIME_FLOOR, TAG_BONUS, SCORE_THRESHOLD = 0.5, 0.1, 0.1


def freshness(occurred_ms: Column, now_ms: Column, half_life_hours: Column, fallback_ms: Column | None = None) -> Column:
    """1 without an event time (or the fallback's time under the older policy), else decay by age, at most 1."""
    at = occurred_ms if fallback_ms is None else fallback_ms
    return F.when(at.isNull(), 1.0).otherwise(F.least(F.lit(1.0), decay_factor((now_ms - at) / 3.6e6, half_life_hours)))


def tag_match(tags: Column, wanted: Sequence[str]) -> Column:
    """1 and a bonus for each wanted tag present; a tag wanted twice counts twice."""
    return sum((F.when(F.coalesce(F.array_contains(tags, t), F.lit(False)), TAG_BONUS).otherwise(0.0) for t in wanted), F.lit(1.0))


def affinity(similarity: Column, lexical: Column) -> Column:
    """The larger of the measured ones, 1 if neither was; NaN stays NaN."""
    return F.when(similarity.isNull() & lexical.isNull(), 1.0).when(F.isnan(similarity), F.lit(float("nan"))).otherwise(F.greatest(similarity, lexical))


def total(affinity_: Column, decay: Column, fresh: Column, tags: Column, strength: Column, time_floor: float = TIME_FLOOR) -> Column:
    return affinity_ * (time_floor + (1 - time_floor) * decay * fresh) * tags * strength


def partition(score: Column, threshold: float = SCORE_THRESHOLD) -> Column:
    """``passed``, ``below`` or ``not_comparable``."""
    return F.when(score.isNull() | F.isnan(score), "not_comparable").when(score >= threshold, "passed").otherwise("below")


def validity_class(valid_from: Column, valid_until: Column, at: Column) -> Column:
    """``expired`` (tested first), ``not_yet_valid`` or null."""
    return F.when(valid_until <= at, "expired").when(valid_from > at, "not_yet_valid")


def truncation_verdict(bar: Column, last_similarity: Column, bound: Column) -> Column:
    """Whether rows beyond an approximate search's window could have reached the bar."""
    most = last_similarity * bound
    usable = bound.isNotNull() & (most > 0) & ~F.isnan(most) & (most < float("inf"))
    return F.when(~usable | ~F.coalesce(usable, F.lit(False)), "undecidable").when(bar / most >= 1, "provably_safe").otherwise("loss_possible")


def score_bound(wanted: Sequence[str]) -> float:
    """The most that the rest of the default score multiplies a similarity by: the wanted tags' bonus, if decay, freshness and strength are 1 at most."""
    return 1 + TAG_BONUS * len(wanted)
