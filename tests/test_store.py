"""Sinks with their checks, lookups, well-formedness, requests on groups, and recorded responses."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import checks
from recallgrid.operators import lifecycle, lookups
from recallgrid.sources import store
from recallgrid.sources.store import Store
from tests.test_operators import MEMORY, NOW, memory

ID = "0a1b2c3d-0000-4000-8000-00000000000"


@pytest.fixture()
def memories(spark):
    return spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "tenant_id string, id string")


def test_events_and_relations_need_their_own_memories(spark, tmp_path, memories):
    s = Store(spark, str(tmp_path / "s"))
    events = lambda rows: spark.createDataFrame(rows, "tenant_id string, memory_id string, kind string")
    s.append_events(events([("t", "A", "x"), ("t", None, "events_purged")]), memories)
    s.append_events(events([("u", "c", "y"), ("t", "A", "x")]), memories)
    assert s.read("memory_events").count() == 4
    for wrong in (("t", "c", "x"), ("t", "nobody", "x")):
        with pytest.raises(ValueError, match="1 events"):
            s.append_events(events([wrong, ("t", "a", "x")]), memories)
    assert s.read("memory_events").count() == 4
    links = lambda rows: spark.createDataFrame(rows, "tenant_id string, from_id string, to_id string")
    s.append_relations(links([("t", "a", "b"), ("t", "a", "b")]), memories)
    s.append_relations(links([("t", "a", "b"), ("t", "b", "a")]), memories)
    assert s.read("relations").count() == 2
    with pytest.raises(ValueError):
        s.append_relations(links([("t", "a", "c")]), memories)


def test_vectors_settings_spaces_and_erasure(spark, tmp_path, memories):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda v, at, i="a": spark.createDataFrame([("t", i, [v], at)], "tenant_id string, memory_id string, embedding array<double>, created_at timestamp_ntz")
    with pytest.raises(ValueError, match="isn't registered"):
        s.upsert_vectors("one", rows(0.1, NOW), memories)
    for space in ("one", "two"):
        s.register_space(space, 1)
    s.register_space("one", 1)
    with pytest.raises(ValueError):
        s.register_space("one", 2)
    with pytest.raises(ValueError):
        s.register_space("no name", 2)
    assert s.spaces() == {"one": 1, "two": 1}
    s.upsert_vectors("one", rows(0.1, NOW), memories)
    s.upsert_vectors("one", rows(0.2, datetime(2018, 3, 1)), memories)
    s.upsert_vectors("two", rows(0.3, NOW), memories)
    got = s.read("vectors-one").collect()
    assert len(got) == 1 and got[0].embedding == [pytest.approx(0.2, abs=1e-7)] and got[0].embedding != [0.2]
    with pytest.raises(ValueError, match="unknown memories"):
        s.upsert_vectors("one", rows(0.1, NOW, "c"), memories)
    s.delete_vectors(spark.createDataFrame([("t", "a")], "tenant_id string, memory_id string"))
    assert s.read("vectors-one").count() == s.read("vectors-two").count() == 0
    settings = lambda *r: spark.createDataFrame(list(r), "tenant_id string, days int")
    s.upsert_settings(settings(("t", 1), ("u", 2)))
    s.upsert_settings(settings(("t", 3)))
    assert {tuple(r) for r in s.read("tenant_settings").collect()} == {("t", 3), ("u", 2)}
    s.write("memories", memories)
    assert s.erase_tenant("t") == {"vectors-one": 0, "vectors-two": 0, "memories": 2, "tenant_settings": 1}
    assert [r.id for r in s.read("memories").collect()] == ["c"] and s.erase_tenant("t")["memories"] == 0
    assert s.read("nothing", "x int").count() == 0
    with pytest.raises(ValueError):
        s.read("nothing")


def test_purged_memories_lose_their_texts_vectors_and_relations(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    m = spark.createDataFrame([("t", i, "text", "d", "active", "h") for i in "abc"], "tenant_id string, id string, content string, digest string, status string, content_hash string")
    s.write("memories", m)
    s.register_space("one", 1)
    s.upsert_vectors("one", spark.createDataFrame([("t", i, [1.0], NOW) for i in "abc"], "tenant_id string, memory_id string, embedding array<float>, created_at timestamp_ntz"), m)
    s.append_relations(spark.createDataFrame([("t", "a", "b"), ("t", "c", "a"), ("t", "b", "c")], "tenant_id string, from_id string, to_id string"), m)
    keys = spark.createDataFrame([("t", "A"), ("t", "A"), ("u", "b")], "tenant_id string, memory_id string")
    for _ in range(2):
        s.purge_memories(keys)
        assert {tuple(r) for r in s.read("memories").collect()} == {("t", "a", "", "", "forgotten", "h"), ("t", "b", "text", "d", "active", "h"), ("t", "c", "text", "d", "active", "h")}
        assert {r.memory_id for r in s.read("vectors-one").collect()} == {"b", "c"} and [(r.from_id, r.to_id) for r in s.read("relations").collect()] == [("b", "c")]


def test_lookups(spark):
    rows = spark.createDataFrame([("t", ID + "1"), ("t", ID + "1"), ("u", ID + "2")], "tenant_id string, id string")
    assert lookups.point(rows, "t", (ID + "1").upper()).count() == 1
    assert lookups.point(rows, "t", ID + "2").count() == 0 and lookups.point(rows, "t", "1' or true").count() == 0
    wanted = spark.createDataFrame([(0, ID + "2"), (1, "absent"), (2, (ID + "1").upper()), (3, ID + "2"), (4, None)], "position int, key string")
    got = lookups.first_seen(rows.distinct(), wanted, "id").orderBy("position").collect()
    assert [(r.id, r.position) for r in got] == [(ID + "2", 0), (ID + "1", 2)]


def test_well_formed_values(spark):
    assert checks.malformed("a😀\0") == ("nul", 3) and checks.malformed("x\ud83d") == ("lone_surrogate", 1) and checks.malformed("ok😀") is None and checks.malformed("") is None
    assert checks.uuid_like(ID + "1") and not checks.uuid_like(ID) and not checks.uuid_like(ID + "1\n0")
    assert checks.fits_int4(2**31 - 1) and not checks.fits_int4(2**31) and not checks.fits_int4(True) and not checks.fits_int4(1.0)
    assert [n for n in range(1, 5000) if checks.analyze_due(n - 1, n)] == [1000, 2000, 4000] and checks.analyze_due(500, 9000) and not checks.analyze_due(1000, 1999)
    rows = spark.createDataFrame([(None,), ("a\0",), (ID + "1",), ("x",)], "v string").select(checks.identifier_class(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == ["missing", "nul", "uuid", "other"]


def test_requests_on_groups_and_pairs(spark):
    pair = lambda a, b, **k: [memory(a, status="contested", contested_with_id=b.upper(), **k), memory(b, status="contested", contested_with_id=a)]
    m = spark.createDataFrame([*pair("a", "b"), *pair("c", "d"), memory("lone", status="contested", contested_with_id="x"), memory("x"), memory("y"), memory("z", status="archived")], MEMORY)
    groups = spark.createDataFrame([("g", "X"), ("g", "y"), ("g", "y"), ("h", "y"), ("h", "z"), ("i", "x")], "group_id string, id string")
    assert {(r.group_id, r.id): (r.outcome, r.status) for r in lifecycle.contested_groups(m, groups).collect()} == {("g", "x"): ("contested", "contested"), ("g", "y"): ("contested", "contested"), ("h", "y"): ("refused", "active"), ("h", "z"): ("refused", "archived"), ("i", "x"): ("refused", "active")}
    asked = spark.createDataFrame([("A", "b"), ("c", "b"), ("lone", None), ("x", None)], "winner_id string, loser_id string")
    got = {(r.id, r.outcome, r.status, r.superseded_by_id) for r in lifecycle.resolved(m, asked).collect()}
    assert got == {("a", "resolved", "active", None), ("b", "resolved", "superseded", "a"), ("c", "refused", "contested", None), ("b", "refused", "contested", None), ("lone", "orphan_resolved", "active", None), ("x", "refused", "active", None)}


def test_reflected_rows(spark):
    rows = [memory("a", tags=["t2", "t1"], attributes={"k": "v", "z": "1"}, subject_id=None), memory("b", tags=["t1", "t3"], attributes={"k": "v", "z": "2"}), memory("c", claim_key_subject="alone")]
    m = spark.createDataFrame(rows, MEMORY)
    texts = spark.createDataFrame([("g", "Some text", "", [" ", "own"]), ("alone", "x", "d", None)], "group_key string, content string, digest string, tags array<string>")
    group = F.coalesce("claim_key_subject", F.lit("g"))
    r = lifecycle.reflected(m, group, texts).collect()
    assert len(r) == 1 and r[0].sources == ["a", "b"] and r[0].tags == ["own"] and r[0].attributes == ["k=v"] and r[0].subject_id is None and r[0].digest == "Some text"
    r = lifecycle.reflected(m, group, texts.withColumn("tags", F.lit(None).cast("array<string>"))).collect()
    assert r[0].tags == ["t2", "t1", "t3"]


def test_recorded_responses(spark, tmp_path):
    lines = [{"request": "q", "response": "old", "seq": 1}, {"request": "q", "response": "new", "seq": 2}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    asked = spark.createDataFrame([("q",), ("other",)], "request string")
    got = {r.request: r.response for r in store.answered(asked, store.recorded_responses(spark, str(tmp_path / "c.jsonl"))).collect()}
    assert got == {"q": "new", "other": None}
