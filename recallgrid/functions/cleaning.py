"""Cleaning of fields before they are stored."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recallgrid.functions.claim_keys import WHITE

FAILURE_LENGTH = 4096
_CLUSTER = regex.compile(r"\X")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def content_key(text: Column) -> Column:
    """The form in which contents are compared: NFC, without white space of any kind at its ends. Only texts that aren't ASCII go to Python."""
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.regexp_replace(F.when(plain, text).otherwise(_composed(F.when(~plain, text))), f"\\A[{WHITE}]+|[{WHITE}]+\\z", "")


def cut(text: str | None, units: int) -> str | None:
    """The longest prefix of whole grapheme clusters of at most ``units`` UTF-16 units."""
    if text is None:
        return None
    out, used = [], 0
    for c in _CLUSTER.findall(text):
        used += len(c.encode("utf-16-le")) // 2
        if used > units:
            break
        out.append(c)
    return "".join(out)


def cut_col(text: Column, units: int) -> Column:
    """``cut`` of a column: ASCII by a built-in function."""
    plain = text.rlike(r"\A[\x00-\x7f]*\z") & ~text.contains("\r\n")

    @F.pandas_udf(StringType())
    def clusters(t: pd.Series) -> pd.Series:
        return t.map(lambda x: cut(x, units), na_action="ignore")

    return F.when(plain, F.substring(text, 1, units)).otherwise(clusters(F.when(~plain, text)))


def fits_float(value: Column) -> Column:
    """Whether a half life survives storage as a 4-byte float: finite and not zero."""
    f = value.cast("float")
    return value.isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) & (f != 0)


def clamped(at: Column, least: str) -> Column:
    """Times before the first that can be stored become it; null stays null."""
    return F.when(at.isNotNull(), F.greatest(at, F.lit(least).cast("timestamp_ntz")))


def failure_text(text: Column, by: str = "recallgrid") -> Column:
    """An error's text without the values of its statement: what follows the first line that begins ``params: `` gives way to its length.

    At most 4,096 UTF-16 units of whole graphemes, then a note of the whole length; ``by`` names who left it out. A second time
    changes nothing but for texts that were cut.
    """
    at = F.instr(text, "\nparams: ")
    head, rest = F.substring(text, F.lit(1), at + 8), F.substring(text, at + 9, F.length(text))
    units = lambda t: (F.length(F.encode(t, "UTF-16BE")) / 2).cast("int").cast("string")
    done = rest.rlike(rf"\A\(omitted by {by}, \d+ chars\)\z")
    short = F.when((at > 0) & ~done, F.concat(head, F.lit(f"(omitted by {by}, "), units(rest), F.lit(" chars)"))).otherwise(text)
    long = F.length(F.encode(short, "UTF-16BE")) > 2 * FAILURE_LENGTH
    return F.when(long, F.concat(cut_col(F.when(long, short), FAILURE_LENGTH), F.lit(f"… (truncated by {by}, original length "), units(short), F.lit(" chars)"))).otherwise(short)


def clean_tags(tags: Column) -> Column:
    """Tags without those that hold NUL; order and repetition stay."""
    return F.filter(tags, lambda t: ~t.contains("\0"))


def measured_affinity(similarity: Column, lexical: Column) -> Column:
    """The larger of what was measured; NaN and missing are below all."""
    low = float("-inf")
    return F.greatest(F.coalesce(F.nanvl(similarity, F.lit(low)), F.lit(low)), F.coalesce(lexical, F.lit(low)))
