"""Problem 4: gradients, decoding, windows and accuracy on texts that weren't trained on."""

import json

import numpy as np

from recallgrid.llm import pii
from recallgrid.llm.tagger import Alphabet, Tagger


def test_gradients_follow_differences():
    r = np.random.default_rng(0)
    m = Tagger(Alphabet("abc"), 4, 3, seed=1)
    x, y, n = r.integers(13, 16, (6, 3)), r.integers(0, 3, (6, 3)), np.array([6, 4, 1])
    loss, grads = m.gradients(x, y, n)
    for k in ("V", "b", "A", "s", "e"):
        p = m.p[k].reshape(-1)
        i = int(r.integers(len(p)))
        p[i] += 1e-2
        up = m.gradients(x, y, n)[0]
        p[i] -= 2e-2
        down = m.gradients(x, y, n)[0]
        p[i] += 1e-2
        assert abs((up - down) / 2e-2 - grads[k].reshape(-1)[i]) < 2e-2


def test_decoding_is_the_best_path():
    import itertools

    r = np.random.default_rng(3)
    m = Tagger(Alphabet("ab"), 3, 3)
    m.p["A"], m.p["s"], m.p["e"] = (r.normal(size=s).astype(np.float32) for s in ((3, 3), 3, 3))
    scores = r.normal(size=(5, 1, 3)).astype(np.float32)
    value = lambda p: m.p["s"][p[0]] + m.p["e"][p[-1]] + sum(scores[t, 0, k] for t, k in enumerate(p)) + sum(m.p["A"][a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(3), repeat=5), key=value)
    assert tuple(m.decode(scores, np.array([5]))[:, 0]) == best


TEXTS = {
    "The user can be reached at joao.brennavik@corp.test about Horikugaso.": [("email", "joao.brennavik@corp.test")],
    "Call Leila Thornevale on 415.555.0126 before the Nigonudodu meeting.": [("person_name", "Leila Thornevale"), ("phone", "415.555.0126")],
    "Her social security number is 939 46 6818, keep it off the Hugugedoba sheet.": [("id_number", "939 46 6818")],
    "ユーザーは霞野区水鏡町7丁目6番1号へ引っ越した。パスホコリは置いてきた。": [("street_address", "霞野区水鏡町7丁目6番1号")],
    "Order 555-0455-177 for Mehahutupe shipped on 2024-03-16.": [],
    "Mark the Nominukago row as done; Rose wine is off the list and Will-call closes at 12:15.": [],
}


def test_known_texts_alone_and_in_a_long_text():
    for text, want in TEXTS.items():
        assert [(k, text[a:b]) for a, b, k in pii.find([text])[0]] == want
    long = "\n".join(list(TEXTS) * 40)
    found = [(k, long[a:b]) for a, b, k in pii.find([long])[0]]
    want = [x for w in TEXTS.values() for x in w] * 40
    assert len(set(map(tuple, found)) & set(want)) == len(set(want)) and abs(len(found) - len(want)) <= len(want) * 0.05


def test_tables(spark):
    mail = "reach me at joao.brennavik@corp.test now"
    rows = [("a", mail), ("a", mail), ("b", None), ("c", ""), ("d", "   ")]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "'x' as pii_text")
    got = pii.pii_spans(df, "id", "content", False, "memories").collect()
    assert [tuple(r) for r in got] == [("memories", "a", "email", "joao.brennavik@corp.test")]
    payload = [("o", json.dumps({"text": "é " + mail, "n": 1, "deep": [{"x": mail}]})), ("p", "not json " + mail), ("q", None)]
    obs = spark.createDataFrame(payload, "id string, payload string")
    assert {r.rec_id for r in pii.pii_spans(obs, "id", "payload", True, "observations").collect()} == {"o", "p"}
    out = {r.rec_id: r.redacted for r in pii.redacted(obs, "id", "payload", True, "observations").collect()}
    assert json.loads(out["o"]) == {"text": "é reach me at [EMAIL] now", "n": 1, "deep": [{"x": "reach me at [EMAIL] now"}]} and out["q"] is None
    assert pii.pii_spans(df.limit(0), "id", "content", False, "m").count() == 0


def test_redacting_leaves_the_rest_of_the_json_as_written(spark):
    mail = "joao.brennavik@corp.test"
    raw = '{ "a" :1.50,"t":"\\u00e9\\ud83d\\ude00 mail joao.brennavik@corp.test, \\"now\\"\\n", "t": "reach me at joao.brennavik@corp.test now","joao.brennavik@corp.test":[ "x" ] }'
    deep = "[" * 60_000 + f'"reach me at {mail} now"' + "]" * 60_000
    df = spark.createDataFrame([("raw", raw), ("deep", deep), ("number", "1"), ("empty", "")], "id string, payload string")
    out = {r.rec_id: r.redacted for r in pii.redacted(df, "id", "payload", True, "o").collect()}
    assert out["raw"] == raw.replace("mail " + mail, "mail [EMAIL]").replace("at " + mail, "at [EMAIL]")
    assert out["deep"] == deep.replace(mail, "[EMAIL]") and out["number"] == "1" and out["empty"] == ""
    found = pii.pii_spans(df, "id", "payload", True, "o").collect()
    assert {(r.rec_id, r.pii_text) for r in found} == {("raw", mail), ("deep", mail)}
