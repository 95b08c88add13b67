"""Problem 8: boundaries by learnt statistics."""

import pytest

from recallgrid.llm.sentences import divide, sentences

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    from recallgrid.llm.sentences import learn, learn_languages

    docs = spark.read.parquet(f"{D}/documents.parquet")
    languages = learn_languages(docs)
    return learn(docs, languages), languages


def units(text, lang, model):
    return [text[a:b] for a, b in divide(text, lang, *model)]


CASES = [
    ("en", ["Dr. Vintergard asked for approx. 64 rows, e.g. those from March.", "The floor is 0.05.", "It ends at 5 p.m. on Monday."]),
    ("en", ["“Is it live?” the tester asked.", "We waited ... and the lease expired.", "(This was fixed in build 6.)", "See example.py now."]),
    ("de", ["Frau Dr. Haverlock kommt am 9. Oktober um 9.30 Uhr.", "„Das geht nicht. Bitte warten.“, sagte die Prüferin.", "Das Archiv schweigt."]),
    ("es", ["¿Y si falla?, preguntó el revisor.", "El plazo acaba a las 5 p. m. del martes.", "Véase la pág. 3 del art. 6."]),
    ("el", ["Ο κ. Felsinger είδε περίπου 191,5 γραμμές.", "Η μνήμη διαβάζει την πρώτη παρατήρηση;", "Το αρχείο κρατά."]),
]


@pytest.mark.parametrize("lang,want", CASES)
def test_spaced_scripts(lang, want, model):
    assert units(" ".join(want), lang, model) == want


def test_unspaced_scripts(model):
    want = ["「まだですか。」「もう少しです。」という会話が残る。", "えっ……もう終わったの？", "対象は計28社．", "閾値は3.5に上がった！？", "（これは第7版で直した。）"]
    assert units("".join(want), "ja", model) == want
    want = ["“真的吗？”他问。", "《档案说明。第3版》已经过期了吗？", "不行！！！"]
    assert units("".join(want), "zh", model) == want
    assert units("ทีมค้นหาเก็บบันทึก 426 รายการค่ะ รุ่น 3.2 ใช้ไม่ได้ครับ", "th", model) == ["ทีมค้นหาเก็บบันทึก 426 รายการค่ะ", "รุ่น 3.2 ใช้ไม่ได้ครับ"]
    assert units("पृ. 3 पर रु. 744.50 लिखा है। क्या यह सच है?", "hi", model) == ["पृ. 3 पर रु. 744.50 लिखा है।", "क्या यह सच है?"]


def test_layout(model):
    text = "## Notes\r\nThe index moved. It is fine\n\n- Re-embed it. Then compare.\n1. remove the label\n[10:02] Ann: ok\n[10:03] user: No. 7 is on\n🙂\n"
    assert units(text, "en", model) == ["## Notes", "The index moved.", "It is fine", "- Re-embed it.", "Then compare.", "1. remove the label", "[10:02] Ann: ok", "[10:03] user: No. 7 is on", "🙂"]
    wrapped = "The import batch compares two conflicting claims and\nthe archive sweep copies the outdated fallback text. The\nnightly job restores it."
    assert len(units(wrapped, "en", model)) == 2


def test_defined_results(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t", "xx"), (4, "Ok. Yes.", None), (5, "x" * 100_000 + ".", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "0 as sent_start")
    got = sentences(df).collect()
    assert {r.doc_id for r in got} == {4, 5}
    for r in got:
        t = dict((a, b) for a, b, _ in rows)[r.doc_id][r.sent_start : r.sent_end]
        assert t == t.strip() and t
    assert sentences(df.limit(0)).count() == 0


def test_units_cover_the_text(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    spans = {}
    for r in sentences(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    for i, t in texts.items():
        at, rest = 0, ""
        for a, b in sorted(spans.get(i, [])):
            assert at <= a < b
            rest += t[at:a]
            at = b
        assert not (rest + (t or "")[at:]).strip()
