"""Personal information in free text (problem 4): character-level BiLSTM with CRF transitions.

Texts are cut into overlapping windows; the network scores each window's characters, the scores of overlapping windows are
averaged by their distance from the windows' edges, and one Viterbi path is decoded over the whole text, so that a span that
crosses windows comes out once. An exact check then trims each span to the form of its type. The weights come from
``pii_training`` and are read once per worker; the operator is a map without shuffle, but for the duplicates of its result.

Defined results: null and blank texts have no spans; a payload that isn't JSON is one text, one that is nested too deep for the
parser is read string by string; keys of objects aren't searched; redacting leaves everything else of a JSON text as it is
written; a record exported twice gives its rows once; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recallgrid.llm.tagger import Tagger
from recallgrid.session import spread

TYPES = ["email", "phone", "id_number", "street_address", "person_name"]
WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))
WINDOW, STRIDE = 256, 176
#: Characters of a batch of windows, with padding; its gates stay in a core's cache.
PANEL = 40_000
_WORD = re.compile(r"[^\W_]")
_EMAIL = re.compile(r"(?:mailto:)?([A-Za-z0-9][\w.+\-]*(?:@|＠|\s?\[at\]\s?|\s?\(at\)\s?)[\w\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[\w\-]+)+)", re.I)
#: A string of JSON, what makes it a key, and what is written for one character of its value.
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*+)"', re.S)
_COLON = re.compile(r"[ \t\r\n]*:")
_WRITTEN = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", re.S)
#: What may stand between two parts of one span.
_JOINTS = {"person_name": (" ", "-", "\u3000"), "street_address": (", ",)}
#: Words in lower case after a name or address, and titles or words in lower case before a name, aren't part of it.
_TAIL = re.compile(r"(?:\s+[a-zà-ÿ]+)+$")
_HEAD = re.compile(r"(?:[a-zà-ÿ]+|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Dra)\.?\s+")


@lru_cache(maxsize=2)
def tagger(path: str) -> Tagger:
    return Tagger.load(path)


def tag_texts(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, type number) of the spans of each text, before the exact check."""
    coded = [model.alphabet.encode(t) for t in texts]
    windows: list[tuple[int, int, int]] = []
    for i, c in enumerate(coded):
        at = 0
        while True:
            end = min(at + WINDOW, len(c))
            if end > at:
                windows.append((i, at, end))
            if end == len(c):
                break
            at += STRIDE
    windows.sort(key=lambda w: w[2] - w[1])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    at = 0
    while at < len(windows):
        # Windows go up in length, so a batch's padding is its last window's length.
        n = 1
        while at + n < len(windows) and (n + 1) * (windows[at + n][2] - windows[at + n][1]) <= PANEL:
            n += 1
        chosen = windows[at : at + n]
        at += n
        lengths = np.array([e - s for _, s, e in chosen])
        x = np.zeros((lengths.max(), n), dtype=np.int64)
        for j, (i, s, e) in enumerate(chosen):
            x[: e - s, j] = coded[i][s:e]
        scores = model.emissions(x, lengths)
        whole = np.array([len(coded[i]) == e - s for i, s, e in chosen])
        open_ = np.flatnonzero(whole & ~model.certain_zero(scores, lengths))
        if len(open_):
            paths = model.decode(scores[:, open_], lengths[open_])
            for j, w in enumerate(open_.tolist()):
                found[chosen[w][0]] = _spans(paths[: lengths[w], j])
        for w in np.flatnonzero(~whole).tolist():
            i, s, e = chosen[w]
            parts.setdefault(i, []).append((s, scores[: e - s, w].copy()))
    for i, pieces in parts.items():
        total, weight = np.zeros((len(coded[i]), model.tags), dtype=np.float32), np.zeros(len(coded[i]), dtype=np.float32)
        for s, piece in pieces:
            near = np.minimum(np.arange(len(piece)) + 1, np.arange(len(piece), 0, -1)).astype(np.float32)
            total[s : s + len(piece)] += piece * near[:, None]
            weight[s : s + len(piece)] += near
        scores, length = (total / weight[:, None])[:, None], np.array([len(coded[i])])
        if not model.certain_zero(scores, length)[0]:
            found[i] = _spans(model.decode(scores, length)[:, 0])
    return found


def _spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(path).tolist():
        kind, begins = (int(path[i]) - 1) // 2, path[i] % 2 == 1
        if out and not begins and out[-1][1] == i and out[-1][2] == kind:
            out[-1] = (out[-1][0], i + 1, kind)
        else:
            out.append((i, i + 1, kind))
    return out


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span in the exact form of its type, or None if it can't have it."""
    # No word or number is cut: a span's edge moves out to the end of the run of letters or digits of ASCII that it cuts.
    while a > 0 and text[a - 1].isascii() and text[a - 1].isalnum() and text[a].isascii() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isascii() and text[b].isalnum() and text[b - 1].isascii() and text[b - 1].isalnum():
        b += 1
    while a < b and not (_WORD.match(text[a]) or (kind == "phone" and text[a] in "+(")):
        a += 1
    while b > a and not _WORD.match(text[b - 1]) and not (kind == "street_address" and text[b - 1] == "." and re.search(r"\b(?:Ave|Blvd|Rd|St|Ln|Ct|Str)\.$", text[a:b])):
        b -= 1
    if kind == "email":
        m = _EMAIL.search(text, a, b)
        return m.span(1) if m else None
    if kind in ("phone", "id_number"):
        if kind == "phone":
            while a < b and not (text[a].isdigit() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isdigit():
                b -= 1
        # Part of a longer number, such as an order's or a version's, is none of these.
        if re.match(r"[-.]\d", text[b : b + 2]) or re.match(r"\d[-.]", text[max(a - 2, 0) : a]):
            return None
        part = text[a:b]
        digits = sum(c.isdigit() for c in part)
        return (a, b) if digits >= (7 if kind == "phone" else 5) and (kind == "phone" or not any(c.islower() for c in part)) else None
    if kind == "street_address":
        m = _TAIL.search(text, a, b)
        b = m.start() if m else b
        part = text[a:b]
        return (a, b) if any(c.isdigit() for c in part) and re.search(r"[^\W\d_]{3}|[区丁番]", part) else None
    while m := _HEAD.match(text, a, b):
        a = m.end()
    m = _TAIL.search(text, a, b)
    b = m.start() if m else b
    part = text[a:b]
    return None if not part or any(c.isdigit() for c in part) or part[0].islower() or (len(part) > 2 and part.isupper()) else (a, b)


def find(texts: list[str], weights: str = WEIGHTS) -> list[list[tuple[int, int, str]]]:
    """Checked (start, end, type) of the spans of each text; each distinct text is read once."""
    distinct = list(dict.fromkeys(t for t in texts if t and not t.isspace()))
    known = {}
    for t, spans in zip(distinct, tag_texts(tagger(weights), distinct)):
        out: list[tuple[int, int, str]] = []
        for a, b, k in spans:
            good = checked(t, a, b, TYPES[k])
            if good and (not out or good[0] >= out[-1][1]):
                kind = TYPES[k]
                if kind == "person_name" and re.search(r"(?<![^\W\d_])[A-Z]\. $", t[max(0, good[0] - 4) : good[0]]):
                    good = (good[0] - 3, good[1])  # an initial
                if out and out[-1][2] == kind and t[out[-1][1] : good[0]] in _JOINTS.get(kind, ()):
                    out[-1] = (out[-1][0], good[1], kind)
                elif not out or good[0] >= out[-1][1]:
                    out.append((*good, kind))
        known[t] = out
    return [known.get(t, []) for t in texts]


def strings_of(payload: str | None) -> list[str]:
    """The string values of a JSON text, at any depth."""
    if not payload:
        return []
    try:
        value = json.loads(payload)
    except ValueError:
        return [payload]
    except RecursionError:
        return [t for _, _, t in literals(payload)]
    out, rest = [], [value]
    while rest:
        v = rest.pop()
        if isinstance(v, str):
            out.append(v)
        else:
            rest += v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
    return out


def _redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def literals(payload: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of a JSON text's string values as they are written, without their quotes; keys aren't among them."""
    return [(m.start(1), m.end(1), json.loads(m.group(0), strict=False) if "\\" in m.group(1) else m.group(1)) for m in _LITERAL.finditer(payload) if not _COLON.match(payload, m.end())]


def redact_json(payload: str, known: dict[str, list[tuple[int, int, str]]]) -> str:
    """The JSON text with the spans of its string values replaced where they are written."""
    out, at = [], 0
    for start, end, decoded in literals(payload):
        spans = known.get(decoded)
        if not spans:
            continue
        places = range(start, end + 1)
        if len(decoded) != end - start:  # escapes: where each decoded character is written
            places = [m.start() for m in _WRITTEN.finditer(payload, start, end)] + [end]
        for a, b, kind in spans:
            out += [payload[at : places[a]], f"[{kind.upper()}]"]
            at = places[b]
    return "".join(out) + payload[at:]


def is_json(payload: str) -> bool:
    try:
        json.loads(payload)
    except ValueError:
        return False
    except RecursionError:
        pass
    return True


def pii_spans(records: DataFrame, key: str, text: str, json_text: bool, name: str, weights: str = WEIGHTS) -> DataFrame:
    """Rows ``(rec_table, rec_id, pii_type, pii_text)`` of one table, each once."""
    schema = StructType([StructField(c, StringType()) for c in ("rec_id", "pii_type", "pii_text")])

    def run(batches):
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, of = [], []
            for i, v in enumerate(values):
                for t in strings_of(v) if json_text else [v] if v else []:
                    texts.append(t)
                    of.append(i)
            rows = [(keys[i], kind, t[a:b]) for i, t, spans in zip(of, texts, find(texts, weights)) for a, b, kind in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], names=["rec_id", "pii_type", "pii_text"])

    found = spread(records.select(F.col(key).cast("string"), F.col(text).cast("string"))).mapInArrow(run, schema).distinct()
    return found.select(F.lit(name).alias("rec_table"), "rec_id", "pii_type", "pii_text")


def redacted(records: DataFrame, key: str, text: str, json_text: bool, name: str, weights: str = WEIGHTS) -> DataFrame:
    """Rows ``(rec_table, rec_id, redacted)``: every row's text with placeholders such as [EMAIL]; null stays null, a row that was exported twice comes out twice."""
    schema = StructType([StructField(c, StringType()) for c in ("rec_id", "redacted")])

    def run(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            parsed = [bool(v) and json_text and is_json(v) for v in values]
            texts = list(dict.fromkeys(t for v, p in zip(values, parsed) for t in ([x for _, _, x in literals(v)] if p else [v] if v else [])))
            known = dict(zip(texts, find(texts, weights)))
            out = [redact_json(v, known) if p else _redact_text(v, known[v]) if v else v for v, p in zip(values, parsed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rec_id", "redacted"])

    found = spread(records.select(F.col(key).cast("string"), F.col(text).cast("string"))).mapInArrow(run, schema)
    return found.select(F.lit(name).alias("rec_table"), "rec_id", "redacted")
