"""Sentence units across languages and scripts (problem 8): statistics of periods, learnt without labels.

One pass over all texts counts, per language, each word with and without a final period, what follows such words, and which
words open sentences after sure ends; Spark adds these up. Log-likelihood ratios then give each language's abbreviations, the
words whose period takes a number, the collocations (an abbreviation, initial or number with a period and the word after it)
and its frequent sentence starters, and whether its numbers with a period go on in lower case (ordinals). A second pass
classifies every period with these lists and divides the texts.

Language is found per line: by script, and in Latin script by the words that are more frequent in one language than in others.
These words come from the tags of about ``LANGUAGE_SAMPLE`` documents, any language that is tagged among them. The models
that are sent to the workers are bounded: at most 1 / ``LEAST_WORD`` words a language, and only types and collocations that
make up at least a millionth of their language's words, so no more than a million per language and list.

Defined results: null, empty and blank texts have no units; offsets count code points; whole texts are read; a quotation or
bracket of any length isn't divided; repeated or null document ids come out as they are; an empty table has no rows; without
tags all Latin script is one language; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recallgrid.session import cut_lineage, spread

#: Polite particles that end a Thai sentence before a space; fixed values.
THAI_ENDINGS = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า", "นะคะ", "นะครับ")
#: Scripts and the language that each stands for where the tag doesn't tell another; fixed values.
_SCRIPTS = {"ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "th": r"\p{Thai}", "hi": r"\p{Devanagari}", "ar": r"\p{Arabic}", "el": r"\p{Greek}", "ru": r"\p{Cyrillic}", "ko": r"\p{Hangul}", "": r"\p{Latin}"}
_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _ranges(pattern: str) -> list[tuple[str, str]]:
    """The runs of code points that a class of ``regex`` holds."""
    return [(m.group(0)[0], m.group(0)[-1]) for m in regex.finditer(f"(?V1)(?:{pattern})+", _ALL)]


def _class(pattern: str, most: str = "\U0010ffff") -> str:
    """The same class for ``re``, which is several times as fast but knows no properties; without characters beyond ``most``."""
    return "[" + "".join(f"{re.escape(a)}-{re.escape(min(b, most))}" for a, b in _ranges(pattern) if a <= most) + "]"


#: For ``str.translate``: a digit for each character of a script, other characters go.
_SCRIPT_TABLE: dict[int, str | None] = defaultdict(lambda: None)
for _i, _p in enumerate(_SCRIPTS.values()):
    for _a, _b in _ranges(_p):
        _SCRIPT_TABLE.update((o, str(_i)) for o in range(ord(_a), ord(_b) + 1))
_SCRIPT_NAMES = list(_SCRIPTS)
_LATIN_LINE = re.compile(r"[\x00-\u024f\u2018\u2019\u201c\u201d\u2013\u2014\u2026\s]*+")
_LATIN = re.compile(_class(r"\p{Latin}"))
_WORD = regex.compile(r"[\p{L}\p{M}]+[’']?")
#: A token: letters, marks and digits with inner periods, hyphens and apostrophes; a final period if white space, a mark or the
#: end follows. Scripts without spaces between words have none.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\u30fc"


def _tokens(most: str) -> str:
    part = _class(rf"[[\p{{L}}\p{{M}}\p{{N}}]--[{_UNSPACED}]]", most) + "+"
    return rf"{part}(?:(?:\.-|[.\u2019'\-]){part})*+(?:\.(?=[\s\"'\u201d\u2019\u00bb)\],;:]|$))?"


_TOKEN, _TOKENS = re.compile(_tokens("\U0010ffff")), re.compile(f"({_tokens(chr(0x10FFFF))})")
#: The same for texts without characters beyond the basic plane, by a table in place of a list of ranges.
_TOKENS_BASIC = re.compile(f"({_tokens(chr(0xFFFF))})")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_NUMBER = regex.compile(r"[\p{N}.,:\-]+")
_ROMAN = regex.compile(r"[IVXLC]{1,6}")
_CJK = re.compile(_class(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆｡-ﾟ、。「」『』（）！？・：；]"))
_NO_SPACES = re.compile(_class(rf"[{_UNSPACED}\u3001-\u301f\uff01-\uff1f]"))
_CASELESS = re.compile(_class(r"\p{Lo}"))
_MARKER = regex.compile(r"(?:#{1,6}\s|[-*•‣◦▪·]\s+\S|\(?\p{N}{1,3}[.)]\s+\S|\p{Ll}[)]\s+\S)")
_TURN = regex.compile(r"(?:\[\d{1,2}:\d{2}(?::\d{2})?\]\s*[^\n]|(?:user|assistant|system|tool|[\p{Lu}\p{Lo}][\p{L}\p{M}.'\-]*(?:\s[\p{Lu}\p{Lo}][\p{L}\p{M}.'\-]*){0,2})\s?[:：]\s)")
_TURN_LABEL = regex.compile(r"\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]\s*)?(?:user|assistant|system|tool|[\p{Lu}\p{Lo}][\p{L}\p{M}.'\-]*(?:\s[\p{Lu}\p{Lo}][\p{L}\p{M}.'\-]*){0,2})\s?[:：]\s")
_ITEM_MARK = regex.compile(r"\s*(?:#{1,6}|[-*•‣◦▪·]|\(?\p{N}{1,3}[.)]|\p{Ll}[)])\s+")
_NUMBERED = regex.compile(r"\(?\p{N}{1,3}[.)]\s+|\p{Ll}[)]\s+")
_ENDS = re.compile(r"[.!?…。！？｡．؟۔।॥;;]+")
_SURE, _MARKS = re.compile(r"[!?؟]\S*\s"), re.compile(r"[:;…\"“”«»'‘]")
_THAI_END = regex.compile(r"(?<=" + "|".join(THAI_ENDINGS) + r")[”\"')]*\s+(?=\S)")
_SPACE = re.compile(r"\s*")
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "»": "«", "„": "“”\"", "“": "”", "‹": "›", '"': '"', "'": "'", "‘": "’", "｢": "｣", "”": "”"}
_BRACKETS = set("([{（［")
_PAIRED = re.compile("[" + re.escape("".join(dict.fromkeys("".join(_OPEN) + "".join(_OPEN.values())))) + "]")
#: Marks that open and close alike.
_ALIKE = set("\"'»”")
_CLOSERS = set(")]}）］」』》〉】»”’›“\"'｣")
_STARTS = set("¿¡") | set(_OPEN) | set("—–-")
#: What follows a period, if no word that could open a sentence: a number, a word in lower case, a mark.
NUMBER, LOWER, MARK = "#", "_", ","
#: A type counts for the model from this share of its language's tokens on, and from this many.
LEAST_SHARE, LEAST_COUNT = 1e-6, 2
ABBREVIATION, STARTER, COLLOCATION, ORDINALS, SENTENCE_END = 0.3, 30.0, 7.88, 0.05, 0.8
FLUSH = 400_000
#: Documents that the words of languages are fitted on, about, of which those with a tag count; the least share of its language that such a word has, and how many times its mean over languages.
LANGUAGE_SAMPLE, LEAST_WORD, PREFERRED = 20_000, 5e-4, 2.0


def known_language(tag: str | None) -> str:
    tag = (tag or "").strip().lower().replace("_", "-").split("-")[0]
    return tag if len(tag) == 2 else "und"


class Languages:
    """Words of the languages in Latin script with their log ratios, and the script of each language that is tagged."""

    def __init__(self, words: dict[str, list[tuple[str, float]]], script_of: dict[str, str]):
        self.words, self.script_of = words, script_of
        self.latin = {la: True for la, script in script_of.items() if script == ""}
        self.common = next(iter(self.latin), "und")  # the first is the most frequent

    def of_line(self, line: str, said: str) -> str:
        """A language by script, in Latin script by words; empty if neither tells."""
        if not line.isascii() and not _LATIN_LINE.fullmatch(line):
            found = line.translate(_SCRIPT_TABLE)
            counts = {name: found.count(str(i)) for i, name in enumerate(_SCRIPT_NAMES)}
            latin = counts.pop("")
            if counts["ja"]:
                counts["ja"] += counts["zh"]
            best = max(counts, key=counts.get)
            if counts[best] and counts[best] * 3 >= latin:
                return said if self.script_of.get(said) == best else best
        score: dict[str, float] = {}
        get = self.words.get
        for w in line.lower().split():
            for la, weight in get(w, ()):
                score[la] = score.get(la, 0.0) + weight
        if not score:
            return ""
        best = max(score, key=score.get)
        return said if score.get(said) == score[best] else best


def count_words(text: str, lang: str | None, counts: Counter) -> None:
    """Adds a tagged text's words and its letters by script: (tag, word or NUL and script)."""
    tag = known_language(lang)
    if tag == "und":
        return
    counts.update((tag, w) for w in text.lower().split() if len(w) <= 24)
    found = text.translate(_SCRIPT_TABLE)
    for i, name in enumerate(_SCRIPT_NAMES):
        if n := found.count(str(i)):
            counts[tag, "\0" + name] += n


def learn_languages(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """From the tags of a sample by a hash of key and text; a wrong tag here and there doesn't matter, as only words well above their mean count."""
    tagged = F.col(text).isNotNull() & F.col(lang).isNotNull()
    wanted = F.pmod(F.xxhash64(key, text), F.lit(max(documents.count(), 1))) < LANGUAGE_SAMPLE
    sample = documents.where(tagged & wanted).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t, la in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count_words(t, la, counts)
            if len(counts) > FLUSH:
                yield _table(counts, 2)
        yield _table(counts, 2)

    schema = StructType([StructField("a", StringType()), StructField("b", StringType()), StructField("n", LongType())])
    sums = cut_lineage(spread(sample).mapInArrow(count, schema).groupBy("a", "b").agg(F.sum("n").alias("n")))
    letters = F.expr("left(b, 1) = '\\0'")
    own = sums.groupBy("a").agg(F.max_by(F.when(letters, F.expr("substring(b, 2)")), F.when(letters, F.col("n"))).alias("script"), F.sum(F.when(letters, F.col("n"))).alias("letters"), F.sum(F.when(~letters, F.col("n"))).alias("total"))
    tags = sorted(own.collect(), key=lambda r: (-(r.letters or 0), r.a))  # one row a language tag
    script_of = {r.a: r.script or "" for r in tags}
    total = {r.a: r.total for r in tags if script_of[r.a] == "" and r.total}
    least = F.create_map(*[F.lit(x) for a, n in total.items() for x in (a, max(2.0, LEAST_WORD * n))]) if total else None
    often = sums.where(~letters & (F.col("n") >= least[F.col("a")])).collect() if total else []  # at most 1 / LEAST_WORD words a language
    share: dict[str, dict[str, float]] = defaultdict(dict)
    for r in often:
        share[r.b][r.a] = r.n / total[r.a]
    languages = max(1, sum(script == "" for script in script_of.values()))
    words = {}
    for w, by in share.items():
        mean = sum(by.values()) / languages
        kept = [(la, log(v / mean)) for la, v in by.items() if v >= PREFERRED * mean or languages == 1]
        if kept:
            words[w] = kept
    return Languages(words, script_of)


def _table(counts: Counter, width: int) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(width)]
    out = pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in keys], pa.int64())], names=[*"abcd"[:width], "n"])
    counts.clear()
    return out


_LIST_FIRST = set("#-*•‣◦▪·(")


class Lines:
    """A text's lines: spans, languages, and whether each line's break ends a unit."""

    def __init__(self, text: str, lang: str | None, languages: Languages):
        self.text = text
        spans, at = [], 0
        for m in _BREAK.finditer(text):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, len(text)))
        self.spans = spans
        bodies = [text[a:b].strip() for a, b in spans]
        raw = [len(text[a:b].rstrip()) for a, b in spans]
        said = known_language(lang)
        if said not in languages.script_of and said not in _SCRIPTS:
            said = "und"
        own = [languages.of_line(b, said) if b else "" for b in bodies]
        votes: Counter = Counter()
        for la, b in zip(own, bodies):
            if la:
                votes[la] += len(b)
        common = votes.most_common(1)[0][0] if votes else said
        latin = Counter({la: n for la, n in votes.items() if la in languages.latin})
        latin = latin.most_common(1)[0][0] if latin else (said if said in languages.latin else languages.common)
        self.langs = [la or (common if common in languages.latin or not _LATIN.search(b) else latin) for la, b in zip(own, bodies)]
        width = [0] * len(spans)
        i = 0
        while i < len(spans):
            j = i
            while j < len(spans) and bodies[j]:
                j += 1
            width[i:j] = [max(raw[i:j], default=0)] * (j - i)
            i = max(j, i + 1)
        #: ends[i]: the break after line i ends a unit.
        self.ends = []
        for i in range(len(spans) - 1):
            here, after = bodies[i], bodies[i + 1]
            if not here or not after or here[0] == "#" or ((":" in after or "：" in after) and _TURN.match(after)):
                self.ends.append(True)
                continue
            word = after.split(None, 1)[0]
            if not word.isascii() and _NO_SPACES.search(word):
                wrapped = width[i] >= 15 and raw[i] >= width[i] - 2 and not _ENDS.search(here[-1:])
            else:
                wrapped = width[i] >= 30 and raw[i] + 1 + len(word) > width[i]
            first = after[0]
            if (first in _LIST_FIRST or first.isnumeric() or after[1:2] == ")") and _MARKER.match(after) and (not wrapped or _ENDS.search(here[-1:]) or _MARKER.match(here)):
                self.ends.append(True)
            else:
                self.ends.append(not (wrapped or first.islower()))

    def segments(self):
        """(start, end, language) of the runs of lines that no break divides."""
        first = 0
        for i in range(len(self.spans)):
            if i == len(self.spans) - 1 or self.ends[i]:
                a, b = self.spans[first][0], self.spans[i][1]
                if self.text[a:b].strip():
                    yield a, b, self.langs[first]
                first = i + 1


class Counts:
    """Counts of types. Tokens are counted as written, most of them in one step a segment, and become types at the end."""

    def __init__(self):
        self.rows: Counter = Counter()
        self.tokens, self.opens, self.aside = (defaultdict(Counter) for _ in range(3))

    def add(self, text: str, lang: str | None, languages: Languages) -> None:
        split = (_TOKENS if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text) else _TOKENS_BASIC).split
        for a, b, la in Lines(text, lang, languages).segments():
            segment = text[a:b]
            label = _TURN_LABEL.match(segment) if ":" in segment or "：" in segment else None
            label = label or _ITEM_MARK.match(segment)
            parts = split(segment[label.end() :] if label else segment)
            gaps, tokens = parts[::2], parts[1::2]
            if not tokens:
                continue
            self.tokens[la].update(tokens)
            opens, aside, last = [tokens[0]], [], len(tokens) - 1
            for i in [i for i, gap in enumerate(gaps) if gap != " "]:
                gap = gaps[i]
                if 0 < i <= last:
                    if _SURE.search(gap):
                        opens.append(tokens[i])
                    elif tokens[i - 1][-1] != "." and _MARKS.search(gap):
                        aside.append(tokens[i])
            for i in [i for i, t in enumerate(tokens) if t[-1] == "."]:
                kind = _kind(tokens[i][:-1])
                rest = gaps[i + 1].lstrip()
                if i == last:
                    then = ""
                else:
                    following = tokens[i + 1]
                    if not _SURE.search(gaps[i + 1]):
                        aside.append(following)
                    if rest[:1] and rest[0] in ",;:":
                        then = MARK
                    else:
                        then = NUMBER if following[0].isnumeric() else LOWER if following[0].islower() else _start_type(following)
                        if kind == NUMBER and then == LOWER:
                            self.rows[la, "ordinal", NUMBER, ""] += 1
                self.rows[la, "pair", kind, then] += 1
            self.opens[la].update(opens)
            self.aside[la].update(aside)

    def __len__(self) -> int:
        return len(self.rows) + sum(map(len, self.tokens.values()))

    def flush(self) -> pa.RecordBatch:
        for la, tokens in self.tokens.items():
            opens, aside = self.opens[la], self.aside[la]
            for t, n in tokens.items():
                dotted = t[-1] == "."
                word = t[:-1] if dotted else t
                kind = _kind(word)
                self.rows[la, "dot" if dotted else "plain", kind, ""] += n
                if kind == NUMBER:
                    continue
                start, opened = _start_type(word), opens.get(t, 0)
                if opened:
                    self.rows[la, "opens", start, ""] += opened
                if n := n - opened - aside.get(t, 0):
                    self.rows[la, "upper" if word[0].isupper() else "lower", start, ""] += n
        for c in (self.tokens, self.opens, self.aside):
            c.clear()
        return _table(self.rows, 4)


@lru_cache(maxsize=100_000)
def _kind(word: str) -> str:
    """The type of a word without its period: lower case, or that of all numbers."""
    return NUMBER if _NUMBER.fullmatch(word) else word.lower()


@lru_cache(maxsize=100_000)
def _start_type(word: str) -> str:
    """The type of a word that opens a sentence: lower case, up to an apostrophe."""
    m = _WORD.match(word)
    return (m.group(0) if m else word).lower()


def _ll(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at probability p; 0 log 0 is 0."""
    part = lambda c, q: F.when(c > 0, c * F.log(F.greatest(q, F.lit(1e-300)))).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def _collocated(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of b given a against b in general."""
    rest = F.greatest(n - a, F.lit(1))
    p, p1, p2 = b / n, ab / F.greatest(a, F.lit(1)), (b - ab) / rest
    return -2 * (_ll(ab, a, p) + _ll(b - ab, rest, p) - _ll(ab, a, p1) - _ll(b - ab, rest, p2))


def learn(documents: DataFrame, languages: Languages, text: str = "text", lang: str = "lang") -> dict[str, set[tuple[str, ...]]]:
    """The lists of (language, type) that classify periods: ``abbreviation``, ``starter``, ``takes_number`` and ``ordinal``, and of (language, type, type): ``collocation``."""
    source = documents.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("t").isNotNull())
    schema = StructType([StructField(c, StringType()) for c in "abcd"] + [StructField("n", LongType())])

    def count(batches):
        counts = Counts()
        for batch in batches:
            for t, la in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.add(t, la, languages)
            if len(counts) > FLUSH:
                yield counts.flush()
        yield counts.flush()

    sums = spread(source).mapInArrow(count, schema).toDF("lang", "kind", "a", "b", "n")
    sums = cut_lineage(sums.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    types = sums.where("kind <> 'pair'").groupBy("lang", "a").agg(*[of(k).alias(k) for k in ("dot", "plain", "opens", "upper", "lower", "ordinal")])
    totals = types.groupBy("lang").agg(F.sum(F.col("dot") + F.col("plain")).alias("tokens"), F.sum("dot").alias("dots"))
    types = cut_lineage(types.join(F.broadcast(totals), "lang"))  # one row a language
    enough = lambda c: (c >= LEAST_COUNT) & (c >= LEAST_SHARE * F.col("tokens"))

    letters = F.length(F.regexp_replace("a", r"\.", ""))
    inner = F.length("a") - letters
    dot, both = F.col("dot"), F.col("dot") + F.col("plain")
    ratio = -2 * (_ll(dot, both, F.col("dots") / F.col("tokens")) - _ll(dot, both, F.lit(0.99)))
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -F.col("plain").cast("double"))
    abbreviations = types.where(enough(dot) & (F.col("a") != NUMBER) & (score >= ABBREVIATION)).select("lang", "a")
    abbreviations = cut_lineage(abbreviations)

    # Sentences open after sure ends and after the periods of words that aren't abbreviations.
    pairs = cut_lineage(sums.where("kind = 'pair'").join(F.broadcast(types.select("lang", "tokens").distinct()), "lang").select("lang", "a", "b", "n", "tokens"))
    words = ~F.col("b").isin("", NUMBER, LOWER, MARK)
    after = pairs.join(abbreviations, ["lang", "a"], "left_anti").where((F.col("a") != NUMBER) & (F.length("a") > 1) & words).groupBy("lang", F.col("b").alias("a")).agg(F.sum("n").alias("after"))
    opened = types.join(after, ["lang", "a"], "left").withColumn("ab", F.col("opens") + F.coalesce("after", F.lit(0)))
    breaks = opened.groupBy("lang").agg(F.sum("ab").alias("breaks"))
    opened = opened.join(F.broadcast(breaks), "lang").withColumn("b", F.greatest("ab", F.col("opens") + F.col("upper") + F.col("lower") + F.coalesce("after", F.lit(0))))
    often = (F.col("ab") / F.col("b") > F.col("breaks") / F.col("tokens")) & (_collocated(F.col("breaks"), F.col("b"), F.col("ab"), F.greatest("tokens", "breaks")) >= STARTER)
    opens_only = (F.col("ab") > 0) & (F.col("lower") > 0) & (F.col("upper") == 0)
    starters = opened.where(enough(F.col("b")) & (F.col("a") != NUMBER) & ((often & (F.col("upper") * 4 < F.col("ab"))) | opens_only)).select("lang", "a")
    starters = cut_lineage(starters)

    # A word whose period nearly always stands before a starter or at the end only looks like an abbreviation.
    ending = pairs.join(abbreviations, ["lang", "a"], "left_semi").join(starters.select("lang", F.col("a").alias("b"), F.lit(1).alias("is_start")), ["lang", "b"], "left")
    ending = ending.groupBy("lang", "a").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("is_start").isNotNull() | (F.col("b") == ""), F.col("n")).otherwise(0)).alias("ends"))
    abbreviations = abbreviations.join(ending.where(F.col("ends") > SENTENCE_END * F.col("all")), ["lang", "a"], "left_anti")

    seconds = pairs.groupBy("lang", "a").agg(F.sum("n").alias("a_n"), F.sum(F.when(F.col("b") == NUMBER, F.col("n")).otherwise(0)).alias("ab"), F.first("tokens").alias("tokens"))
    overall = seconds.groupBy("lang").agg(F.sum("a_n").alias("all_pairs"), F.sum("ab").alias("all_numbers"))
    seconds = seconds.join(F.broadcast(overall), "lang")
    numbers = seconds.where(enough(F.col("ab")) & (F.col("a") != NUMBER) & (F.col("ab") * 2 >= F.col("a_n")) & (_collocated(F.col("a_n"), F.col("all_numbers"), F.col("ab"), F.col("all_pairs")) >= COLLOCATION)).select("lang", "a")
    ordinals = types.where((F.col("a") == NUMBER) & (F.col("ordinal") > ORDINALS * F.col("dot"))).select("lang", "a")

    # Collocations: an abbreviation, initial or number with its period, and a word in upper case that follows it more often than others do, and opens no sentences.
    a_n = pairs.groupBy("lang", "a").agg(F.sum("n").alias("a_n"))
    b_n = pairs.where(words).groupBy("lang", "b").agg(F.sum("n").alias("b_n"))
    dots = pairs.groupBy("lang").agg(F.sum("n").alias("all_pairs"))
    joined = pairs.where(words & enough(F.col("n"))).join(abbreviations.withColumn("short", F.lit(True)), ["lang", "a"], "left")
    joined = joined.where(F.col("short") | (F.col("a") == NUMBER) | (F.length("a") == 1)).join(starters.select("lang", F.col("a").alias("b")), ["lang", "b"], "left_anti")
    joined = joined.join(a_n, ["lang", "a"]).join(b_n, ["lang", "b"]).join(F.broadcast(dots), "lang")
    above = F.col("n") * F.col("all_pairs") > F.col("a_n") * F.col("b_n")
    collocations = joined.where(above & (_collocated(F.col("a_n"), F.col("b_n"), F.col("n"), F.col("all_pairs")) >= COLLOCATION)).select("lang", "a", "b", F.lit("collocation").alias("k"))

    found = collocations
    for name, part in (("abbreviation", abbreviations), ("starter", starters), ("takes_number", numbers), ("ordinal", ordinals)):
        found = found.unionByName(part.select("lang", "a", F.lit(None).cast("string").alias("b"), F.lit(name).alias("k")))
    model: dict[str, set[tuple[str, ...]]] = {k: set() for k in ("abbreviation", "starter", "takes_number", "ordinal", "collocation")}
    table = found.toArrow()
    for la, a, b, k in zip(*(table.column(c).to_pylist() for c in ("lang", "a", "b", "k"))):
        model[k].add((la, a) if b is None else (la, a, b))
    return model


def protected(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of text[a:b], of any length: positions of the marks.

    One pass with a stack: a mark closes the last open one that it can close, and those opened since come to nothing.
    """
    spans: list[tuple[int, int]] = []
    stack: list[tuple[int, str, str]] = []
    for m in _PAIRED.finditer(text, a, b):
        p, mark = m.start(), m.group(0)
        before, after = text[p - 1 : p] if p > a else "", text[p + 1 : p + 2]
        opens = mark in _OPEN and not (mark in "\"'‘»”" and ((before and not (before.isspace() or before in "([{（—–«„“:：¿¡" or (mark in '"”' and _CJK.match(before)))) or not after or after.isspace()))
        closes = not (mark in "'’" and after.isalpha()) and not (opens and mark in _ALIKE and before.isspace())
        if closes:
            at = next((i for i in range(len(stack) - 1, -1, -1) if mark in stack[i][2]), -1)
            if at >= 0:
                start = stack[at][0]
                del stack[at:]
                while spans and spans[-1][0] > start:
                    spans.pop()
                spans.append((start, p))
                continue
        if opens:
            if mark in _ALIKE:  # opened again: the one before was none
                stack = [o for o in stack if o[1] != mark]
            stack.append((p, mark, _OPEN[mark]))
    return spans


def divide(text: str | None, lang: str | None, model: dict[str, set[tuple[str, ...]]], languages: Languages) -> list[tuple[int, int]]:
    """The units of a text as (start, end)."""
    if not text or not text.strip():
        return []
    units = []
    for a, b, la in Lines(text, lang, languages).segments():
        cut = a
        for at in _cuts(text, a, b, la, model):
            units.append((cut, at))
            cut = at
        units.append((cut, b))
    out = []
    for a, b in units:
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        if left < len(part):
            out.append((a + left, a + len(part.rstrip())))
    return out


def _cuts(text: str, a: int, b: int, la: str, model) -> list[int]:
    cuts: list[int] = []
    body = _SPACE.match(text, a, b).end()
    marker = _NUMBERED.match(text, body, b)
    if marker:
        body = marker.end()
    spans = protected(text, body, b)
    s, after_span = 0, {}
    for p, q in spans:
        after_span[q] = p
    if la == "th":
        cuts += [m.start() for m in _THAI_END.finditer(text, body, b)]
    for m in _ENDS.finditer(text, body, b):
        start, end = m.span()
        run = m.group(0)
        while s < len(spans) and spans[s][1] < start:
            s += 1
        closing = None
        if s < len(spans) and spans[s][0] < start:
            # Within a quotation or bracket: only its end may be the end of a unit.
            e = end
            while e < spans[s][1] and (text[e] in _CLOSERS or text[e].isspace()):
                e += 1
            if e != spans[s][1]:
                continue
            closing, end = spans[s][0], e + 1
        while end < b and text[end] in _CLOSERS and not (text[end] in "\"'“" and end + 1 < b and not text[end + 1].isspace() and text[end + 1] not in ".,;:!?") and not any(p == end for p, _ in spans[s : s + 2]):
            end += 1
        if end < b and _ENDS.match(text, end, b):
            continue
        if end < b and text[end] in ",;:،、，；：" and end == m.end():
            continue
        if end >= b or not text[end:b].strip():
            continue
        if _is_end(text, a, b, body, start, end, run, closing, la, model):
            cuts.append(end)
    return sorted(set(cuts))


def _is_end(text: str, a: int, b: int, body: int, start: int, end: int, run: str, closing: int | None, la: str, model) -> bool:
    spaced = text[end].isspace()
    j = _SPACE.match(text, end, b).end()
    following = text[j]
    k = j
    while k < b and text[k] in _STARTS:
        k += 1
    opener = k > j
    first = text[k] if k < b else following
    wide = any(c in "。！？｡．" for c in run)
    dots = run.strip(".…") == "" and (len(run) > 1 or run == "…")
    before = text[start - 1 : start]
    if not spaced:
        if run == "．":
            if before.isnumeric() and following.isnumeric():
                return False
        elif wide or any(c in "।॥" for c in run):
            pass
        elif any(c in "!?؟" for c in run) and _CJK.match(before) and _CJK.match(following):
            pass
        else:
            return False
    if following in ",;:،、，；：)]}）」』》" or (following in "—–" and j + 1 < b and (text[j + 1].islower() or (text[j + 1].isspace() and text[j + 2 : j + 3].islower()))):
        return False
    if run.strip(";;") == "" and (la != "el" or not spaced or first.islower()):
        return False
    caseless = bool(_CASELESS.match(first)) or bool(_CJK.match(first))
    if closing is not None:
        if first.islower():
            return False
        if text[closing] in _BRACKETS:
            opened = text[body:closing].rstrip()
            return not opened or bool(_ENDS.search(opened[-1:])) or opened[-1] in _CLOSERS
        if caseless or _CJK.match(before) or _CASELESS.match(before):
            return False
        if not any(c in ".!?…" for c in run):
            return True
    if dots:
        return not (first.islower() or caseless) if not wide else not caseless
    if wide:
        return True
    if first.islower():
        return False
    if run.strip(".") == "" and len(run) == 1:
        if la == "th":
            return False
        return _period(text, a, start, first, opener, following, k, b, la, model, caseless)
    return True


def _period(text: str, a: int, start: int, first: str, opener: bool, following: str, k: int, b: int, la: str, model, caseless: bool) -> bool:
    """Whether a single period before white space ends a sentence."""
    i = start
    while i > a and not text[i - 1].isspace() and text[i - 1] not in "\"“”«»()[]（）「」„—":
        i -= 1
    word = text[i:start].lstrip("'’‘-")
    m = None
    for m in _TOKEN.finditer(word):
        pass
    word = m.group(0) if m and m.end() == len(word) else word
    kind = word.lower()
    follows = _TOKEN.match(text, k, b)
    then = _start_type(follows.group(0)) if follows else ""
    starts = (la, then) in model["starter"] or following in "¿¡"
    if not opener and (la, _kind(word), then) in model["collocation"]:
        return False
    if first.isnumeric():
        if _NUMBER.fullmatch(word):
            return (la, NUMBER) not in model["ordinal"]
        return not ((la, kind) in model["abbreviation"] or (la, kind) in model["takes_number"])
    if _NUMBER.fullmatch(word) or _ROMAN.fullmatch(word):
        return starts or caseless or opener or (la, NUMBER) not in model["ordinal"]
    if (la, kind) in model["abbreviation"] or (len(word) == 1 and word.isalpha() and word.isupper()):
        return starts and not caseless
    return True


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows ``(key, sent_start, sent_end)``: the units of every text, in two passes, the second a map without shuffle."""
    languages = learn_languages(documents, key, text, lang)
    model = learn(documents, languages, text, lang)
    source = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    schema = StructType([StructField("_key", source.schema["_key"].dataType), StructField("sent_start", LongType()), StructField("sent_end", LongType())])

    def run(batches):
        for batch in batches:
            at, starts, ends = [], [], []
            for i, (t, la) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for s, e in divide(t, la, model, languages):
                    at.append(i)
                    starts.append(s)
                    ends.append(e)
            take = pa.array(np.asarray(at, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["_key", "sent_start", "sent_end"])

    return spread(source).mapInArrow(run, schema).select(F.col("_key").alias(key), "sent_start", "sent_end")
