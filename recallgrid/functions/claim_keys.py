"""Normal form of claim keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_KEY_LENGTH = 256
#: White space of the source system's runtime; it differs from Python's in U+0085, U+001C to U+001F and U+FEFF; fixed values.
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN = re.compile(f"[{WHITE}]+")


def normal_key(text: str | None) -> str | None:
    """NFKC, trimmed, lower case, each run of white space one ``_``; null for what is empty, longer than 256 or holds NUL."""
    if text is None:
        return None
    key = _RUN.sub("_", _RUN.sub(" ", unicodedata.normalize("NFKC", text)).strip(" ").lower())
    return key if key and len(key) <= MAX_KEY_LENGTH and "\0" not in key else None


@F.pandas_udf(StringType())
def _normal_key_udf(text: pd.Series) -> pd.Series:
    return text.map(normal_key, na_action="ignore")


def normal_key_col(col: Column) -> Column:
    """``normal_key`` of a column: ASCII keys by built-in functions, only the others go to Python (NFKC has no built-in)."""
    ascii_only = col.rlike(r"^[\x00-\x7f]*$")
    plain = F.regexp_replace(F.lower(F.regexp_replace(col, r"^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$", "")), r"[\t\n\x0b\f\r ]+", "_")
    plain = F.when((F.length(plain) > 0) & (F.length(plain) <= MAX_KEY_LENGTH) & ~plain.contains("\0"), plain)
    return F.when(ascii_only, plain).otherwise(_normal_key_udf(F.when(~ascii_only, col)))
