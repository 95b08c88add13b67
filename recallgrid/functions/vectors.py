"""Vector expressions in double arithmetic over float arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"


def cosine_distance_sql(a: str, b: str) -> str:
    """1 - cosine of two SQL expressions; NaN for a zero vector, other lengths or a null element, and such rows sort last.

    One SQL text, as a plan made of single columns takes longer to build than to run.
    """
    norms = f"sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)})"
    return f"coalesce(if(size({a}) = size({b}) and {norms} > 0, 1 - {dot_sql(a, b)} / ({norms}), null), double('NaN'))"


def vector_sql(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" if math.isfinite(v) else f"double('{v}')" for v in values) + ")"


def deterministic_embedding(text: Column, dimensions: int = 8) -> Column:
    """Bucket i has the sum of the UTF-16 units at positions i, i + dimensions, ..., modulo 997; zeros for an empty text, null for null."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("bigint"))
    bucket = lambda all_, i: F.aggregate(F.filter(all_, lambda c, j: j % dimensions == i), F.lit(0).cast("bigint"), lambda s, c: s + c) % 997
    # An array of one, so that the units are decoded once a text and not once a bucket.
    value = F.transform(F.array(codes), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: bucket(all_, i)))[0]
    return F.when(text.isNotNull(), value)
