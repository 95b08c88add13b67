"""Trains the tagger of problem 4: python -m recallgrid.llm.pii_training FOLDER [--more].

Labelled spans come from a bounded sample (``ROWS`` texts) of a folder's memories and observations: the patterns below, which
hold for these texts, and the reference list of name parts, completed by what stands beside its entries, mark the spans. In
every second copy names, kanji, digits and house names are replaced, so that the tagger learns from surroundings and shapes.
It runs at build time only; queries load the saved weights.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.dataset as ds

from recallgrid.llm.tagger import Alphabet, Tagger

TYPES = ["email", "phone", "id_number", "street_address", "person_name"]
#: Labelled texts that the tagger is fitted on, at most, and the size of a state.
ROWS, HIDDEN, ROUNDS = 30_000, 40, 18

#: Longest text, in characters, that is labelled; the windows of longer ones look the same to the tagger.
LONGEST = 400
_PLAIN_WORD = re.compile(r"(?<!\S)([a-z]{3,})(?=[\s,;:!?]|$)")

DOT, AT = r"(?:\.|\s?\[dot\]\s?|\(dot\))", r"(?:@|＠|\s?\[at\]\s?|\(at\))"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+\-]*{AT}[A-Za-z0-9\-]+(?:{DOT}[A-Za-z0-9\-]+)*{DOT}(?:example|test|invalid|com|org|net)\b", re.I)
PHONE = re.compile(r"\+\d{1,3} (?:\(0\))?\d[\d ()-]{5,}\d|\(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)|(?<!\d)0044\d{10}(?!\d)|(?<![\d-])0\d-0000-\d{4}(?!\d)|０９０－００００－[０-９]{4}|(?<![\d-])555-0\d{3}(?![\d-])")
ID = re.compile(r"(?<![\w-])9\d\d([- ])\d\d\1\d{4}(?!\w)|\bQQ \d\d \d\d \d\d [A-D]\b|\b[XYZ]\d{7}[A-Z]\b|(?<![\w-])\d{8}-[A-Z]\b|\b[A-Z]\d\d[A-Z]\d{5}\b|(?<!checksum )(?<![\w-])\d{4} \d{4} \d{4}(?![\w-])", re.A)
ADDRESS = re.compile(
    r"\b\d{1,3} [A-Z][a-z]+ (?:Street|St|Ave\.|Avenue|Road|Lane|Court|Terrace|Blvd)\b(?:\.(?=,))?(?:, (?:Apt|Unit) \w+)?(?! Café)"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.|weg|gasse) \d+[a-z]?\b"
    r"|\b\d+ (?:bis |ter )?(?:rue|quai|bd|avenue) (?:aux Hirondelles|du Vieux-Cadran|de la Brumaille|des Ormes-Bleus)"
    r"|(?:\bCalle|\bC/|\bAvda\.|\bPlaza) (?:de la Bruma|de los Vencejos|del Azulejo Roto|Campoluna),? (?:nº )?\d+"
    r"|[一-鿿]{2}区(?:風待|星降町|水鏡町|朝凪町)\d+(?:丁目\d+番\d+号|-\d+-\d+)"
)


def strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def read_texts(folder: str) -> tuple[list[str], list[tuple[str, str, str]]]:
    texts = set(ds.dataset(f"{folder}/memories.parquet").to_table(columns=["content"]).column(0).to_pylist())
    for p in ds.dataset(f"{folder}/observations.parquet").to_table(columns=["payload"]).column(0).to_pylist():
        texts.update(strings(json.loads(p)))
    names = ds.dataset(f"{folder}/name_parts.parquet").to_table()
    return sorted(t for t in texts if t and t.strip()), list(zip(*(names.column(c).to_pylist() for c in ("name_part", "part_kind", "writing"))))


class Labeller:
    """Marks the spans of a text."""

    def __init__(self, texts: list[str], parts: list[tuple[str, str, str]]):
        given, family = ([p for p, k, w in parts if k == kind and w == "Latn"] for kind in ("given", "family"))
        beside = re.compile(rf"\b(?:{'|'.join(given)}) ([A-Z][a-z]{{4,}})(?:-([A-Z][a-z]+))?\b")
        seen: dict[str, int] = {}
        before = {"&", "In", "Since", "from", "after"}
        for t in texts:
            for m in beside.finditer(t):
                for w in m.groups():
                    if w and w not in before and not re.fullmatch(r"(?:[bdghkmnprstz][aeiou]){3,}", w.lower()):
                        seen[w] = seen.get(w, 0) + 1
        family = sorted(set(family) | {w for w, n in seen.items() if n >= 8})
        self.given, self.family = given, family
        g, f = "(?:" + "|".join(given) + ")", "(?:" + "|".join(family) + ")"
        self.full = re.compile(rf"\b(?:{g}(?:-{g})?|[A-Z]\.) {f}(?:-{f})?\b|\b{f}(?:-{f})?\b(?! Ltd)|\b{g}(?:-{g})?\b")
        words = Counter(w for t in texts for w in set(_PLAIN_WORD.findall(t)))
        self.plain = {w for w in given if words[w.lower()] > 40 or w in ("April", "May")}
        jg, jf = ([p for p, k, w in parts if k == kind and w == "Jpan"] for kind in ("given", "family"))
        other = re.compile(r"(?:私は|の|担当の|^|[。\s])([一-鿿]{2,3})[ 　]?(?:" + "|".join(jg) + ")")
        found: dict[str, int] = {}
        for t in texts:
            for m in other.finditer(t):
                found[m[1]] = found.get(m[1], 0) + 1
        self.jf = sorted(set(jf) | {w for w, n in found.items() if n >= 8}, key=len, reverse=True)
        self.jg = jg
        a, b = "(?:" + "|".join(self.jf) + ")", "(?:" + "|".join(jg) + ")"
        self.japanese = re.compile(rf"{a}[ 　]?{b}|{a}|{b}(?=さん|様|氏)")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if not any(a < y and x < b for x, y, _ in out):
                out.append((a, b, kind))

        for pattern, kind in ((EMAIL, "email"), (ADDRESS, "street_address"), (PHONE, "phone"), (ID, "id_number")):
            for m in pattern.finditer(text):
                add(m.start(), m.end(), kind)
        for m in self.full.finditer(text):
            solo = m.group(0)
            if solo in self.plain and not re.match(r" (?:and [A-Z]|discussed|lives at|vive en)", text[m.end() :]) and not re.search(r"sister $", text[: m.start()]):
                continue
            if "@" in text[m.end() : m.end() + 1] or re.search(r"& $", text[: m.start()]):
                continue
            add(m.start(), m.end(), "person_name")
        for m in self.japanese.finditer(text):
            add(m.start(), m.end(), "person_name")
        return sorted(out)


class Varier:
    """Replaces the words of a text's spans, and house and topic names, by made-up ones."""

    def __init__(self, rng: random.Random, labeller: Labeller):
        self.r = rng
        self.kanji = "山川田中村木林森石井上野原小大高橋本松竹藤佐伊加渡辺斎清水池谷岡島崎東西南北雪月星花草風空海波浜沢瀬戸門久保和正明昭平安達也子美恵香織真奈由紀健太郎翔優斗葵陽菜結衣悠一二三次良雄樹琴遠藍霧朽潮樫鳴白銀桜梅桃柳椿楓栗杉"
        self.labeller = labeller

    def word(self) -> str:
        r = self.r
        on, nu, co = "b c d f g h j k l m n p r s t v w z br ch cr dr fl fr gl gr kl kr pl pr qu sch sh sl st str th tr".split(), "a e i o u ai au ea ee ei ie oa oo ou ia io".split(), "b d f g k l m n p r s t x z ck ld ll lm ln lt mm nd ng nn nt rd rk rn rs rt ss st tt".split()
        w = "".join(r.choice(on) + r.choice(nu) + (r.choice(co) if r.random() < 0.6 else "") for _ in range(r.choice((1, 2, 2, 2, 3))))
        return w[:12].capitalize()

    def name(self, old: str) -> str:
        if re.search(r"[一-鿿]", old):
            gap = re.search(r"[ 　]", old)
            pick = lambda a, b: "".join(self.r.choice(self.kanji) for _ in range(self.r.randint(a, b)))
            long = len(old) > 3
            return pick(1, 3) + ((gap.group(0) if gap else "") + pick(1, 3) if gap or long else "")
        return re.sub(r"[^\W\d_]{2,}", lambda m: self.word() if self.r.random() < 0.8 else self.r.choice(self.labeller.family + self.labeller.given), old)

    def digits(self, old: str, keep: int = 0) -> str:
        return old[:keep] + re.sub(r"\d", lambda m: str(self.r.randint(0, 9)) if m.group(0).isascii() else m.group(0), old[keep:])

    def vary(self, text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        out, at, marks = "", 0, []
        for a, b, kind in spans:
            out += text[at:a]
            old, new = text[a:b], text[a:b]
            if self.r.random() < 0.85:
                if kind == "person_name":
                    new = self.name(old)
                elif kind == "email":
                    new = re.sub(r"[A-Za-z]{4,}", lambda m: m.group(0) if m.group(0).lower() in ("example", "test", "invalid", "mail") or self.r.random() < 0.4 else (self.word().lower() if m.group(0).islower() else self.word()), old)
                elif kind == "street_address":
                    new = self.digits(old)
                    new = re.sub(r"(?<=\d )[A-Z][a-z]{5,}(?= )", lambda m: self.word() + self.r.choice(("", "", "fen", "moor", "gate", "field")), new)
                    new = re.sub(r"\b[A-ZÄÖÜ][a-zäöüß]{4,}?(?=straße|str\.|weg|gasse)", lambda m: self.word() + self.r.choice(("", "er", "en")), new)
                    new = re.sub(r"(?<=aux |des )[A-Z][\w-]+|(?<=du )[A-Z][\w-]+|(?<=de la )[A-Z]\w+|(?<=los )[A-Z]\w+|(?<=del )[A-Z]\w+(?: [A-Z]\w+)?", lambda m: self.word(), new)
                    new = re.sub(r"^[一-鿿]{2}区[一-鿿]{2,3}(?=\d)", lambda m: "".join(self.r.choice(self.kanji) for _ in range(2)) + "区" + "".join(self.r.choice(self.kanji) for _ in range(2)) + self.r.choice(("町", "町", "")), new)
                elif kind == "id_number":
                    new = self.digits(old, 1 if old[:1] == "9" else 0)
                elif kind == "phone":
                    new = self.digits(old, 4 if old[0] in "+0" else 5)
            marks.append((len(out), len(out) + len(new), kind))
            out, at = out + new, b
        return out + text[at:], marks


def tags_of(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(length, dtype=np.int64)
    for a, b, kind in spans:
        k = TYPES.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def sample(folder: str, seed: int = 12) -> tuple[list[tuple[str, list]], Labeller]:
    """At most ``ROWS`` labelled texts: three fifths with spans, every second of them varied, the others without."""
    rng = random.Random(seed)
    texts, parts = read_texts(folder)
    labeller = Labeller(texts, parts)
    rng.shuffle(texts)
    have, none = [], []
    for t in texts:
        if len(t) > LONGEST:
            continue
        s = labeller.spans(t)
        (have if s else none).append((t, s))
    varier = Varier(rng, labeller)
    out = []
    for i, (t, s) in enumerate(have[: ROWS * 3 // 5]):
        out.append(varier.vary(t, s) if i % 2 else (t, s))
    tricky = [x for x in none if re.search(r"[@\d]|\b(?:Mark|Rose|April|Will|May)\b|町|& ", x[0])]
    easy = none[: ROWS // 5]
    out += tricky[: ROWS - len(out) - len(easy)] + easy
    rng.shuffle(out)
    return out, labeller


def main(folder: str, out: str, more: bool = False) -> None:
    rows, _ = sample(folder)
    counts: dict[str, int] = {}
    for t, _ in rows:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    own = [c for c, n in counts.items() if n >= 20 and ord(c) < 0x10000 and not ("ァ" <= c <= "ヺ") and not (("一" <= c <= "鿿") and n < 150)]
    tagger = Tagger(Alphabet("".join(sorted(own))), HIDDEN, 1 + 2 * len(TYPES), seed=3)
    if more:  # goes on from the saved weights, at half the rate
        tagger = Tagger.load(out)
    print("texts", len(rows), "alphabet", tagger.alphabet.size, flush=True)
    tagger.fit([tagger.alphabet.encode(t).astype(np.int64) for t, _ in rows], [tags_of(len(t), s) for t, s in rows], ROUNDS, rate=0.006 if more else 0.012, say=lambda i, loss: (tagger.save(out), print("round", i, "loss", round(loss, 4), flush=True)))
    tagger.save(out)


if __name__ == "__main__":
    main(sys.argv[1], str(Path(__file__).with_name("pii_weights.npz")), "--more" in sys.argv)
