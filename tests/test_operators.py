"""Boundary values of the retrieval and lifecycle operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import decay, scoring, text, vectors
from recallgrid.functions.claim_keys import normal_key
from recallgrid.operators import audit, evaluation, graph, lifecycle, search
from recallgrid.operators.scope import Scope
from recallgrid.operators.skew import lookup_join
from recallgrid.plans.recall import budget_cut

NOW = datetime(2018, 2, 1)
MEMORY = (
    "id string, tenant_id string, subject_id string, status string, content string, digest string, tags array<string>, attributes map<string,string>, provenance_kind string, provenance string,"
    "occurred_at timestamp_ntz, recorded_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, decay_floor_at timestamp_ntz, decay_floor_seq bigint, embedding_status string,"
    "contested_with_id string, superseded_by_id string, source_observation_id string, strength float, half_life_hours float, claim_key_subject string, claim_key_predicate string"
)


def memory(i, **more):
    row = dict(id=i, tenant_id="t", subject_id="s", status="active", content="c", digest="d", tags=[], attributes={}, provenance_kind="imported", provenance='{"kind": "imported"}', occurred_at=None, recorded_at=NOW, valid_from=None, valid_until=None,
               decay_floor_at=NOW + timedelta(days=9), decay_floor_seq=None, embedding_status="ready", contested_with_id=None, superseded_by_id=None, source_observation_id=None, strength=1.0, half_life_hours=720.0, claim_key_subject=None, claim_key_predicate=None)
    return tuple((row | more).values())


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_scope_boundaries(spark):
    ms = timedelta(milliseconds=1)
    df = spark.createDataFrame([
        memory("until_is_now", valid_until=NOW), memory("from_is_now", valid_from=NOW), memory("dead", decay_floor_at=NOW), memory("alive", decay_floor_at=NOW + ms), memory("nobody", subject_id=None),
        memory("tagged", tags=["a"], attributes={"k": "v"}), memory("forgotten", status="forgotten"), memory("other", tenant_id="u"), memory("no_tags", tags=None, attributes=None),
    ], MEMORY)
    at = NOW.isoformat(sep=" ")
    assert ids(df.where(Scope("t", valid_at=at).filter())) == ["alive", "dead", "from_is_now", "no_tags", "nobody", "tagged"]
    assert "dead" not in ids(df.where(Scope("t", alive_at=at).filter())) and "alive" in ids(df.where(Scope("t", alive_at=at).filter()))
    assert "nobody" not in ids(df.where(Scope("t", subject="s").filter())) and "nobody" in ids(df.where(Scope("t", subject="s", include_subjectless=True).filter()))
    assert ids(df.where(Scope("t", statuses=[]).filter())) == []
    assert ids(df.where(Scope("t", labels=["a", "zz"], attributes={"k": "v"}).filter())) == ["tagged"]
    assert len(ids(df.where(Scope("t", since=at, until=at).filter()))) == 7


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = lambda x: F.lit(x).cast("double")
    assert value(decay.floor_offset(lit(0.05), lit(10))) == 0 and value(decay.floor_offset(lit(0.1), lit(10))) == pytest.approx(10)
    assert value(decay.wall_strength(lit(1), lit(0), lit(7.2e6), lit(2))) == pytest.approx(0.5)
    assert value(scoring.partition(lit(0.1))) == "passed" and value(scoring.partition(lit(0.09999999999999999))) == "below" and value(scoring.partition(lit(float("nan")))) == "not_comparable"
    assert value(scoring.tag_match(F.array(F.lit("a"), F.lit("a")), ["a", "a", "b"])) == pytest.approx(1.2)
    assert value(scoring.total(lit(1), lit(0), lit(1), lit(1), lit(1))) == 0.5
    assert value(scoring.affinity(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 1
    assert value(scoring.truncation_verdict(lit(0.5), lit(0.4), lit(1.1))) == "provably_safe" and value(scoring.truncation_verdict(lit(0.1), lit(0.4), F.lit(None).cast("double"))) == "undecidable"
    assert value(F.isnan(F.expr(vectors.cosine_distance_sql("array(0D, 0D)", "array(1D, 0D)")))) and value(F.expr(vectors.cosine_distance_sql(vectors.vector_sql([3, 0]), "array(1D, 0D)"))) == 0
    assert value(text.heuristic_tokens(F.lit("漢字ab"))) == 3
    assert value(text.tokens(F.lit("a-b東京"))) == ["a", "b", "東京"]
    assert normal_key("　Home \t City ") == "home_city" and normal_key(" ") is None and normal_key("a" * 257) is None


def test_search_orders_what_cant_be_compared_last(spark):
    m = spark.createDataFrame([memory("a"), memory("b"), memory("z", recorded_at=NOW + timedelta(days=1))], MEMORY)
    v = spark.createDataFrame([("t", "a", [0.0, 1.0]), ("t", "b", [1.0, 0.0]), ("t", "z", [0.0, 0.0])], "tenant_id string, memory_id string, embedding array<float>")
    assert [r.id for r in search.vector_search(m, v, [1.0, 0.0], Scope("t"), 5).collect()] == ["b", "a", "z"]
    q = spark.createDataFrame([("k", 0, [0.0, 1.0]), ("k", 1, [1.0, 0.0])], "key string, position int, query array<float>")
    assert [(r.place, r.id) for r in search.vector_search_many(m, v, q, Scope("t"), 2).orderBy("place").collect()] == [(1, "b"), (2, "a")]


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 50), ("c", 3, 1)], "id string, place int, digest_length int")
    assert [r.id for r in budget_cut(df, 10).where("kept").collect()] == ["a"]


def test_claim_conflicts_against_brute_force(spark):
    import random

    r = random.Random(2)
    spans = {f"m{i}": sorted((r.randrange(30), r.randrange(30))) for i in range(60)}
    rows = [memory(k, claim_key_subject="u", claim_key_predicate="p", valid_from=NOW + timedelta(hours=a), valid_until=NOW + timedelta(hours=b)) for k, (a, b) in spans.items()]
    want = {k: sum(a < d and c < b and k != o and c < d and a < b for o, (c, d) in spans.items()) for k, (a, b) in spans.items()}
    got = {x.id: x.n_overlaps for x in audit.claim_conflicts(spark.createDataFrame(rows, MEMORY)).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_lifecycle(spark):
    log = [("e1", "M", NOW, 1, "archived"), ("e2", "m", NOW, 2, "restored"), ("e2", "m", NOW, 2, "restored"), ("e3", "n", NOW, 3, "restored"), ("e4", None, NOW, 4, "events_purged")]
    df = spark.createDataFrame(log, "id string, memory_id string, event_at timestamp_ntz, seq bigint, kind string")
    assert {tuple(x) for x in lifecycle.replayed_status(df).collect()} == {("m", "active", 2), ("n", "active", 1)}
    m = spark.createDataFrame([memory("m")], MEMORY).selectExpr("*", "cast('2018-01-05' as timestamp_ntz) as last_reinforced_at")
    uses = lambda day: spark.createDataFrame([("M", datetime(2018, 1, day))] * 2, "memory_id string, used_at timestamp_ntz")
    assert lifecycle.reinforced(m, uses(5)).count() == 0 and lifecycle.reinforced(m, uses(6)).count() == 1


def test_graph(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "x")], "id string, parent_id string")
    got = {r.id: (r.root_id, r.depth) for r in graph.roots(chain).collect()}
    assert got["n0"] == ("n9", 9) and got["n8"] == ("n9", 1)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "z")], "from_id string, to_id string")
    keep = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    start = spark.createDataFrame([("a",)], "id string")
    assert [(r.id, r.level) for r in graph.reachable(start, edges, keep, 2).orderBy("level").collect()] == [("b", 1), ("c", 2)]


def test_skewed_lookup_join_keeps_all_rows(spark):
    left = spark.range(5000).selectExpr("id", "cast(if(id < 4000, 0, id) as bigint) as k")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as v")
    out = lookup_join(left, right, ["k"], "id", "n", hot_rows=100)
    assert out.count() == 5000 and out.where("v = k * 2").count() == 5000


def test_statistics():
    assert evaluation.sign_test(0, 0) == 1 and evaluation.sign_test(8, 0) == pytest.approx(2 / 2**8)
    assert evaluation.at_least(3, 2, 0.5) == pytest.approx(0.5)
    assert evaluation.clopper_pearson_upper(0, 10) == pytest.approx(0.30849710781876083) and evaluation.clopper_pearson_upper(10, 10) == 1


def test_roots_of_cycles_and_long_chains(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("in", "c"), ("self", "self"), ("to_self", "self")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)]
    got = {r.id: (r.root_id, r.depth) for r in graph.roots(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert len(got) == len(rows) and all(got[i] == (None, None) for i in ("a", "b", "c", "d", "e", "in"))
    assert got["self"] == ("self", 1) and got["to_self"] == ("self", 1) and all(got[f"n{i:03}"] == ("n200", 200 - i) for i in range(200))
    assert graph.roots(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_reachable_against_brute_force(spark):
    import random

    r = random.Random(5)
    nodes = [f"v{i:02}" for i in range(40)]
    pairs = {(r.choice(nodes), r.choice(nodes)) for _ in range(60)} | {("v00", n) for n in nodes[1:30]}  # a hub
    both = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    kept = set(nodes) - {"v07", "v11"}
    want = {}
    for s in nodes:
        seen, front, level, out = {s}, [s], 0, []
        while front:
            level += 1
            front = sorted({b for a, b in both if a in front and b in kept} - seen)
            seen |= set(front)
            out += [(level, b) for b in front]
        want[s] = sorted(out)[:3]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {}
    for x in graph.reachable(df([(n,) for n in nodes], "id string"), df(sorted(both), "from_id string, to_id string"), df([(n,) for n in sorted(kept)], "id string"), 3).collect():
        got.setdefault(x.owner_id, []).append((x.level, x.id))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_basis_lost(spark):
    link = lambda *ids: '{"kind": "inferred", "basis": {"memoryIds": [' + ", ".join(f'"{i}"' for i in ids) + "]}}"
    rows = [memory("gone", status="forgotten"), memory("purged"), memory("old", status="superseded"), memory("ok", source_observation_id="O", provenance_kind="stated")]
    rows += [memory("i1", provenance_kind="inferred", provenance=link("GONE", "ok")), memory("i2", provenance_kind="inferred", provenance=link("old", "ok")), memory("i3", provenance_kind="inferred", provenance=link("never")), memory("i4", provenance_kind="inferred", provenance=link("purged")), memory("i5", provenance_kind="inferred", source_observation_id="o")]
    df = spark.createDataFrame(rows, MEMORY).selectExpr("*", "if(id = 'purged', timestamp_ntz'2018-01-01', null) as purged_at")
    got = {r.id: (r.n_basis, r.n_lost) for r in audit.basis_lost(df, audit.stated_basis(df)).collect()}
    assert got == {"i1": (2, 1), "i3": (1, 1), "i4": (1, 1)}


def test_places_and_chunks_in_two_levels(spark):
    at = [NOW + timedelta(minutes=7 * (i * 37 % 100)) for i in range(100)]
    rows = [(f"r{i:02}", "t" if i % 3 else "u", at[i]) for i in range(100)] + [("null", "t", None)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, recorded_at timestamp_ntz")
    for tenant in "tu":
        order = [i for i, k, _ in sorted(rows, key=lambda x: (x[2] or datetime(1, 1, 1), x[0])) if k == tenant]
        assert [r.id for r in lifecycle.places(df, ["tenant_id"], "recorded_at", ["id"]).where(F.col("tenant_id") == tenant).orderBy("place").collect()] == order
    sizes = [r["count"] for r in lifecycle.chunks(df, "tenant_id", "recorded_at", 6).groupBy("tenant_id", "chunk").count().collect()]
    assert set(sizes) <= {2, 3, 4, 5, 6} and sum(sizes) in (100, 101, 99)


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from recallgrid.session import ensure_checkpoint_dir

    unset = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
