"""Queries over all of their job, against brute force."""

import re
import zlib
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from recallgrid.operators import graph, outcomes, search
from recallgrid.operators.scope import Scope
from recallgrid.plans.recall import near_misses, rescored
from tests.test_operators import MEMORY, NOW, memory

FOLDER = "/root/testdata/sf0.001"


def folder_of(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def contents(spark):
    rows = spark.read.parquet(f"{FOLDER}/memories.parquet").select("id", "content").distinct().collect()
    return {r.id: r.content for r in rows}


def words_of(content):
    words = [w[:64] for w in re.split(r"\s+", re.sub(r"[^\x00-\x7f]+", " ", content[:600]).lower()) if w]
    return list(dict.fromkeys(words))[:32]


def test_query_words_keep_all_words(spark, tmp_path):
    made = {"a": "One two ONE three", "many": " ".join(f"w{i}" for i in range(40)), "mixed": "東京 tower 東京 Tower x", "empty": "", "long": "y" * 65 + " z", "cut": "q " * 299 + "abcdef"}
    d = folder_of(spark, tmp_path, memories=(list(made.items()), "id string, content string"))
    query = e.queries()["query_words"]
    got = {r.id: r.w for r in query(spark, d).collect()}
    assert got == {k: words_of(v) for k, v in made.items()} and len(got["many"]) == 32 and got["a"] == ["one", "two", "three"]
    assert {r.id: r.w for r in query(spark, FOLDER).collect()} == {k: words_of(v) for k, v in contents(spark).items()}


def embedding_of(content):
    if content is None:
        return None
    units = content.encode("utf-16-be")
    codes = [units[i] * 256 + units[i + 1] for i in range(0, len(units), 2)]
    return [sum(codes[i::8]) % 997 for i in range(8)]


def test_deterministic_embedding_takes_every_content(spark, tmp_path):
    made = {"plain": "abcdefghij", "accents": "Grüße, café", "japanese": "東京の天気", "astral": "a😀b𝒳", "lines": "a\nb\tc\x00", "long": "語" * 50000, "empty": "", "null": None}
    d = folder_of(spark, tmp_path, memories=(list(made.items()), "id string, content string"))
    query = e.queries()["deterministic_embedding"]
    got = {r.id: r.v for r in query(spark, d).collect()}
    assert got == {k: embedding_of(v) for k, v in made.items()} and got["empty"] == [0] * 8 and got["null"] is None
    assert {r.id: r.v for r in query(spark, FOLDER).collect()} == {k: embedding_of(v) for k, v in contents(spark).items()}


def test_vector_search_answers_more_queries_than_a_block(spark):
    n, r = 2 * search.BLOCK + 100, np.random.default_rng(3)
    x = r.standard_normal((40, 8)).astype("f4")
    x[7], x[9] = x[3], 0
    made = [memory(f"m{i:02}", recorded_at=NOW + timedelta(hours=i % 3)) for i in range(41)]
    stored = [("t", f"m{i:02}", [float(v) for v in x[i]]) for i in range(40)] + [("t", "m40", [1.0, None])]
    v = spark.createDataFrame(stored, "tenant_id string, memory_id string, embedding array<float>")
    q = r.standard_normal((n, 8)).astype("f4")
    asked = spark.createDataFrame([(i, 0, [float(y) for y in q[i]]) for i in range(n)], "key int, position int, query array<float>")
    got = {(y.key, y.place): (y.id, y.distance) for y in search.vector_search_many(spark.createDataFrame(made, MEMORY), v, asked, Scope("t"), 41).collect()}
    assert len(got) == n * 41
    with np.errstate(all="ignore"):
        want = 1 - (q.astype("f8") @ x.T.astype("f8")) / np.outer(np.linalg.norm(q.astype("f8"), axis=1), np.linalg.norm(x.astype("f8"), axis=1))
    for i in range(n):
        ids = [got[i, p][0] for p in range(1, 42)]
        assert ids[-2:] == ["m40", "m09"] and sorted(ids) == [f"m{j:02}" for j in range(41)] and ids.index("m03") == ids.index("m07") + 1
        assert np.allclose([got[i, p][1] for p in range(1, 40)], np.sort(np.delete(want[i], 9)), atol=1e-9)


def test_vector_search_takes_every_twentieth(spark):
    want = {r.memory_id for r in spark.read.parquet(f"{FOLDER}/memory_vectors.parquet").where("model = 'memo-embed-2' and tenant_id = 'tenant-0042'").collect() if zlib.crc32(r.memory_id.encode()) % 20 == 0 and len(r.embedding or []) == 64}
    got = e.queries()["vector_search_many"](spark, FOLDER).groupBy("key").count().collect()
    assert {r.key for r in got} == want and {r["count"] for r in got} == {10}


def test_observation_text_has_names_and_data(spark, tmp_path):
    made = {
        "data": ('{"name": "form", "data": {"note": "Grüße\\n東京 \\"x\\"", "score": 4, "a": [1, null, {}]}, "extractData": true}', 'form\n\n{"note":"Grüße\\n東京 \\"x\\"","score":4,"a":[1,null,{}]}'),
        "astral": (r'{"name": "n", "data": {"a": "👍👍", "b": "\\ud83d\\udc4d \u001F é"}, "extractData": true}', 'n\n\n' + r'{"a":"👍👍","b":"\\ud83d\\udc4d \u001f é"}'),
        "unmarked": ('{"name": "form", "data": {"note": 1}}', "form"), "string mark": ('{"name": "form", "data": {"note": 1}, "extractData": "true"}', "form"),
        "no data": ('{"name": "form", "data": {}, "extractData": true}', "form"), "list": ('{"name": "form", "data": [1], "extractData": true}', "form"),
        "number": ('{"name": 5, "data": {"a": 1}, "extractData": true}', '{"name": 5, "data": {"a": 1}, "extractData": true}'),
        "title": ('{"title": "T", "content": "C", "extractTitle": true}', "T\n\nC"), "blank title": ('{"title": "\u3000 ", "content": "C", "extractTitle": true}', "C"), "title alone": ('{"title": "T", "content": "", "extractTitle": true}', "T"),
        "both": ('{"title": "T", "extractTitle": true, "name": "n", "data": {"a": 1}, "extractData": true}', "T"), "plain title": ('{"title": "T", "content": "C"}', "C"),
        "text": ('{"text": "x", "content": "C"}', "x"), "empty text": ('{"text": "", "content": "C"}', "C"), "other": ('{"z": 1}', '{"z": 1}'), "null": (None, "null"),
    }
    d = folder_of(spark, tmp_path, observations=([(k, v) for k, (v, _) in made.items()], "id string, payload string"))
    query = e.queries()["observation_text"]
    assert {r.id: r.said for r in query(spark, d).collect()} == {k: said for k, (_, said) in made.items()}
    assert query(spark, FOLDER).where("said = 'name and data'").count() == 0


def test_related_lists_have_every_id(spark, tmp_path):
    made = [(f"m{i * 7919 % 1000:03}", "M003" if i % 100 == 0 else None) for i in range(1000)] + [("m500", None), (None, None)]
    d = folder_of(spark, tmp_path, memories=(made, "id string, contested_with_id string"))
    got = {r.id: (r.position, r.related) for r in e.queries()["related_lists"](spark, d).collect()}
    with_m003 = {i for i, other in made if other}
    assert len(got) == 1000 and all(got[f"m{i:03}"][0] == i for i in range(1000))
    assert set(got["m003"][1]) == with_m003 and got["m003"][1] == sorted(with_m003)
    assert all(got[i][1] == (["m003"] if i in with_m003 else []) for i in got if i != "m003")


def test_numbers_run_on_over_ranges(spark):
    ids = spark.range(5000).repartition(6).select(F.format_string("%05d", (F.col("id") * 7919 % 5000).cast("int")).alias("id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.numbered(ids).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r.position, int(r.id)) for r in got) == [(i, i) for i in range(5000)]


def test_scores_go_by_each_tenants_clock(spark):
    base = dict(recorded_at=NOW - timedelta(hours=720))
    rows = [memory("a", tenant_id="act", **base), memory("w", tenant_id="wall", **base), memory("e", tenant_id="either", **base), memory("n", tenant_id="act", **base), memory("o", tenant_id="act", subject_id=None, **base), memory("x", tenant_id="none", **base)]
    m = spark.createDataFrame(rows, MEMORY).selectExpr("*", "cast(null as timestamp_ntz) as last_reinforced_at", "if(id = 'n', null, 0L) as decay_base_seq", "cast(10 as float) as half_life_recalls")
    settings = spark.createDataFrame([("act", "activity"), ("wall", "wall"), ("either", "either")], "tenant_id string, decay_clock string")
    counters = spark.createDataFrame([("act", None, 20), ("act", "s", 10), ("act", "u", 99), ("either", "s", 5), ("wall", None, 50)], "tenant_id string, subject_id string, seq bigint")
    found = m.selectExpr("id", "1D as similarity", "cast(null as double) as lexical")
    got = {r.id: r.total for r in rescored(found, m, str(NOW), settings=settings, counters=counters).collect()}
    want = {"a": 0.5**3, "o": 0.5**2, "n": 0.5, "w": 0.5, "e": 0.5**0.5, "x": 0.5}
    assert got == {k: pytest.approx(0.5 + 0.5 * v) for k, v in want.items()}
    assert {r.id: r.total for r in rescored(found, m, str(NOW)).collect()} == {k: pytest.approx(0.75) for k in want}


def test_near_misses_are_the_best_five_below(spark):
    scored = spark.createDataFrame([(f"b{i}", 0.09 - i / 100, "below_threshold", i + 1) for i in range(7)] + [("r", 0.5, "returned", 1), ("n", float("nan"), "not_comparable", 1)], "id string, total double, part string, place int")
    assert [(r.id, r.place) for r in near_misses(scored).orderBy("place").collect()] == [(f"b{i}", i + 1) for i in range(5)]


def test_protection_margins(spark):
    rows = [("p", "a", True, 0.9), ("p", "b", True, 0.6), ("p", None, True, 0.7), ("p", "c", False, 0.2), ("all", "a", True, 0.5), ("none", "a", False, 0.5)]
    got = {r.probe: (r.least_protected, r.most_other, r.protection_margin) for r in outcomes.protection(spark.createDataFrame(rows, "probe string, id string, protected boolean, score double")).collect()}
    assert got == {"p": (0.6, 0.7, pytest.approx(-0.1)), "all": (0.5, None, None), "none": (None, 0.5, None)}
