"""Time decay of memories on the wall clock and on the recall counter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strength at which a memory counts as decayed, and the largest moment and counter of the source system; fixed values.
THRESHOLD, LAST_MS, LAST_SEQ = 0.05, 8.64e15, 2**53 - 1


def decay_factor(elapsed: Column, half_life: Column) -> Column:
    """0.5 to the power of elapsed half lives."""
    return F.pow(F.lit(0.5), elapsed / half_life)


def floor_offset(strength: Column, half_life: Column, threshold: float = THRESHOLD) -> Column:
    """Time until the strength reaches the threshold, 0 if it has."""
    return F.when(strength <= threshold, 0.0).otherwise(half_life * F.log2(strength / threshold))


def wall_strength(strength: Column, base_ms: Column, now_ms: Column, half_life_hours: Column) -> Column:
    """Strength at ``now_ms``; not clamped, so a base in the future gives more than the strength."""
    return strength * decay_factor((now_ms - base_ms) / 3.6e6, half_life_hours)


def activity_strength(strength: Column, base_seq: Column, now_seq: Column, half_life_recalls: Column) -> Column:
    """Strength at a recall counter; not clamped, as ``wall_strength``."""
    return strength * decay_factor(now_seq - base_seq, half_life_recalls)


def clock_strength(clock: Column, wall: Column, activity: Column) -> Column:
    """Strength by the tenant's clock: wall, activity, or the larger for either; the wall's without a clock or an activity strength."""
    return F.when(clock.isin("activity", "either") & activity.isNull(), wall).when(clock == "activity", activity).when(clock == "either", F.greatest(wall, activity)).otherwise(wall)


def wall_floor_ms(strength: Column, base_ms: Column, half_life_hours: Column, threshold: float = THRESHOLD) -> Column:
    """Moment at which the strength reaches the threshold, in whole milliseconds."""
    return F.floor(F.least(F.lit(LAST_MS), base_ms + floor_offset(strength, half_life_hours, threshold) * 3.6e6)).cast("bigint")


def activity_floor(strength: Column, base_seq: Column, half_life_recalls: Column, threshold: float = THRESHOLD) -> Column:
    """Recall counter at which the strength reaches the threshold."""
    return F.least(F.lit(LAST_SEQ), base_seq + F.ceil(floor_offset(strength, half_life_recalls, threshold))).cast("bigint")


def alive_on_activity(floor_seq: Column, now_seq: Column, subject_seq: Column | None = None) -> Column:
    """The activity gate: null floors never die; a subject's own counter adds to the tenant's."""
    now = now_seq if subject_seq is None else now_seq + F.coalesce(subject_seq, F.lit(0))
    return floor_seq.isNull() | (floor_seq > now)


def first_miss_hours(similarity: Column, half_life: Column, threshold: float = THRESHOLD, score_threshold: float = 0.1) -> Column:
    """Hours until a fact drops below the score threshold or the decay threshold, whichever comes first; negative if it is below already."""
    return F.least(half_life * F.log2(similarity / score_threshold), half_life * math.log2(1 / threshold))
