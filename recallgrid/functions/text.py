"""Text functions of ingest and lexical search, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.cleaning import cut_col

#: Ranges that count as CJK for the token heuristic; fixed values.
CJK = r"ᄀ-ᇿ⺀-⿟　-〿぀-ヿ㄀-ㄯ㄰-㆏ㆠ-ㆿㇰ-ㇿ㐀-䶿一-鿿ꥠ-꥿가-퟿豈-﫿＀-￯"
QUERY_WORDS, WORD_LENGTH, QUERY_LENGTH = 32, 64, 600


def heuristic_tokens(text: Column) -> Column:
    """ceil((18 CJK + 5 other) / 20) of code points."""
    other = F.length(F.regexp_replace(text, f"[{CJK}]", ""))
    return F.ceil(((F.length(text) - other) * 18 + other * 5) / 20).cast("bigint")


def plain_escapes(json: Column) -> Column:
    """JSON as JavaScript writes it: surrogate pairs that ``get_json_object`` escapes become their character, other escapes by number get small letters."""
    pair = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    pieces = F.regexp_extract_all(json, F.lit(rf"({pair}|\\u[0-9a-fA-F]{{4}}|\\.|[^\\]+)"), F.lit(1))
    character = lambda x: F.decode(F.unhex(F.concat(F.substring(x, 3, 4), F.substring(x, 9, 4))), "UTF-16BE")
    plain = F.transform(pieces, lambda x: F.when(x.rlike(f"^{pair}$"), character(x)).when(x.rlike(r"^\\u[0-9a-fA-F]{4}$"), F.lower(x)).otherwise(x))
    return F.when(json.contains("\\u"), F.array_join(plain, "")).otherwise(json)


def observation_text(payload: Column) -> Column:
    """The text of an observation's payload as it goes to extraction: marked title and content, marked name and JSON of data, else text, content, name or the payload itself.

    Only true marks; a blank title or empty data doesn't count, nor do values that aren't strings. Parts are two line breaks apart.
    """
    parsed = F.try_parse_json(payload)
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))
    said = lambda k: F.when((kind(k) == "STRING") & (get(k) != ""), get(k))
    marked = lambda k: (kind(k) == "BOOLEAN") & (get(k) == "true")
    title, content, name = said("title"), said("content"), said("name")
    has_data = kind("data").startswith("OBJECT<") & (get("data") != "{}")
    return (
        F.when(marked("extractTitle") & title.rlike(r"[^\s\p{Z}\x{FEFF}]"), F.concat_ws("\n\n", title, content))
        .when(marked("extractData") & name.isNotNull() & has_data, F.concat_ws("\n\n", name, plain_escapes(get("data"))))
        .otherwise(F.coalesce(said("text"), content, name, payload, F.lit("null")))
    )


def pad_ascii(text: Column) -> Column:
    """Each ASCII run between spaces, so that words of mixed scripts are tokens of their own."""
    return F.regexp_replace(text, r"([\x00-\x7f]+)", " $1 ")


def query_terms(text: Column) -> Column:
    """A query's ASCII words: other runs become a space."""
    return F.regexp_replace(text, r"[^\x00-\x7f]+", " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, ASCII apart from other scripts."""
    return F.filter(F.split(F.lower(pad_ascii(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def capped_words(text: Column) -> Column:
    """A query's distinct words in first-seen order, at most 32, each cut to 64 characters, of its first 600 UTF-16 units of whole graphemes."""
    words = F.filter(F.split(F.lower(query_terms(cut_col(text, QUERY_LENGTH))), r"\s+"), lambda w: w != "")
    return F.slice(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, WORD_LENGTH))), 1, QUERY_WORDS)


def language_mismatch(observed: Column, content: Column) -> Column:
    """Whether a memory of a Japanese observation was written in Latin script.

    The observation has at least 4 kana and kanji, 30 % of these and its Latin letters. The content has none of them, nothing
    that looks like code, and without its links at least 20 Latin letters, 90 % of its letters, and 3 words in lower case.
    """
    kana_or_kanji = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    n = lambda t, p: F.regexp_count(t, F.lit(p))
    latin = r"[\p{IsLatin}&&\p{L}]"
    cjk, other = n(observed, kana_or_kanji), n(observed, latin)
    prose = F.regexp_replace(content, r"(?i)https?://\S+", " ")
    code = content.rlike(r"[`{}<>|\\]|&&|=>|(?:^|\s)--[a-z]|(?:^|\s)\.{0,2}/[A-Za-z0-9_.-]+")
    words = F.size(F.filter(F.split(prose, r"\s+"), lambda w: w.rlike(r"^[a-z]+(?:'[a-z]+)?[.,!?;:]?$")))
    return (cjk >= 4) & (cjk * 10 >= (cjk + other) * 3) & (n(content, kana_or_kanji) == 0) & ~code & (n(prose, latin) >= 20) & (n(prose, latin) * 10 >= n(prose, r"\p{L}") * 9) & (words >= 3)


def space_name(provider: Column, model: Column, dimensions: Column, most: int = 63) -> Column:
    """A table name of an embedding space: safe characters, at most 63 bytes, then a hash tells cut names apart."""
    slug = F.regexp_replace(F.lower(F.concat_ws("_", provider, model, dimensions.cast("string"))), "[^a-z0-9]+", "_")
    return F.when(F.octet_length(slug) <= most, slug).otherwise(F.concat(F.substring(slug, 1, most - 9), F.lit("_"), F.substring(F.sha2(slug, 256), 1, 8)))
