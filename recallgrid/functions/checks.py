"""Well-formedness: of values before they reach a plan (driver side), and of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of ids, least and greatest 4-byte integer, writes after which statistics are due; fixed values.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
INT4, ANALYZE_FROM = (-(2**31), 2**31 - 1), 1000
_UUID = re.compile(UUID)


def malformed(value: str) -> tuple[str, int] | None:
    """The first fault of an identifier, ``nul`` or ``lone_surrogate``, and its place in UTF-16 units; None if it has none."""
    at = 0
    for c in value:
        if c == "\0":
            return "nul", at
        if "\ud800" <= c <= "\udfff":  # Python keeps pairs as one character, so what is left is alone
            return "lone_surrogate", at
        at += 1 + (c > "￿")
    return None


def uuid_like(value: str) -> bool:
    return _UUID.match(value) is not None


def fits_int4(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and INT4[0] <= value <= INT4[1]


def identifier_class(value: Column) -> Column:
    """``missing``, ``nul``, ``uuid`` or ``other``; strings in columns are UTF-8 and have no lone surrogates."""
    return F.when(value.isNull(), "missing").when(value.contains("\0"), "nul").when(value.rlike(UUID), "uuid").otherwise("other")


def event_fault(kind: Column, memory_id: Column, digest: Column, at: Column) -> Column:
    """The first rule that an event breaks, null if none: a purge of events names no memory, any other kind needs a time."""
    return F.when((kind == "events_purged") & memory_id.isNotNull(), "purge_names_a_memory").when(at.isNull(), "no_time").when(memory_id == "", "empty_id").when(digest.contains("\0"), "nul")


def space_problem(space: str, dimensions: int) -> str | None:
    if not re.fullmatch(r"[a-z0-9_]{1,63}", space):
        return f"{space!r} is no name of a space"
    return None if fits_int4(dimensions) and dimensions > 0 else f"{dimensions} is no number of dimensions"


def analyze_due(before: int, after: int, first: int = ANALYZE_FROM) -> bool:
    """Whether a table that grew from ``before`` to ``after`` writes has passed one of first, 2 first, 4 first and so on."""
    due = first
    while due <= before:
        due *= 2
    return due <= after
