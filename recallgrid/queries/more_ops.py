"""Queries of lookups, checks, lifecycle by clock and in groups, corrections, truncation and further evaluation, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import checks, decay
from recallgrid.functions.sql import register
from recallgrid.operators import evaluation, lifecycle, lookups, outcomes
from recallgrid.plans import recall
from recallgrid.queries import round_both
from recallgrid.queries.memory_ops import _E, _RECALL, _SEQ, EVENTS, MEM, NOW, PHRASES, QUERY, T, LIVE, _scored, counters, vec
from recallgrid.sources import store
from recallgrid.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def mem(spark, d):
    return table(spark, d, "memories")


# Every memory's links to others, each mentioned by both sides and again in upper case: keys repeat, and some aren't there.
_WANTED = f"(SELECT upper(contested_with_id) AS key, strlen(id) + ascii(id) AS position FROM {MEM} m WHERE contested_with_id IS NOT NULL UNION ALL SELECT id, 1000 + ascii(id) FROM {MEM} m WHERE contested_with_id IS NOT NULL UNION ALL SELECT 'absent', 0)"


@query("vectors_by_key", f"SELECT v.tenant_id, v.memory_id, v.created_at, w.position::BIGINT AS position FROM (SELECT tenant_id, memory_id, max(created_at) AS created_at FROM memory_vectors GROUP BY ALL) v JOIN (SELECT lower(key) AS memory_id, min(position) AS position FROM {_WANTED} x GROUP BY 1) w USING (memory_id)")
def vectors_by_key(spark, d):
    m = lifecycle.one_each(mem(spark, d)).where("contested_with_id is not null")
    wanted = m.selectExpr("upper(contested_with_id) as key", "length(id) + ascii(id) as position").unionByName(m.selectExpr("id as key", "1000 + ascii(id) as position")).unionByName(spark.range(1).selectExpr("'absent' as key", "0 as position"))
    stored = table(spark, d, "memory_vectors").groupBy("tenant_id", "memory_id").agg(F.max("created_at").alias("created_at"))
    return lookups.first_seen(stored, wanted, "memory_id").select("tenant_id", "memory_id", "created_at", F.col("position").cast("bigint").alias("position"))


@query("event_ownership", f"SELECT e.id, e.memory_id, m.id IS NOT NULL AS owned FROM {EVENTS} e LEFT JOIN {MEM} m ON m.tenant_id = e.tenant_id AND m.id = lower(e.memory_id)")
def event_ownership(spark, d):
    events = lifecycle.one_each(table(spark, d, "memory_events")).select("id", "tenant_id", "memory_id")
    return store.with_ownership(events, mem(spark, d), "memory_id").select("id", "memory_id", "owned")


# Supersession links hold; a contested memory's link to its observation leads to no memory.
@query("relations_refused", f"""WITH r AS (SELECT tenant_id, id AS from_id, lower(superseded_by_id) AS to_id FROM {MEM} m WHERE superseded_by_id IS NOT NULL UNION SELECT tenant_id, id, lower(source_observation_id) FROM {MEM} m WHERE status = 'contested' AND source_observation_id IS NOT NULL)
SELECT tenant_id, from_id, to_id FROM r WHERE NOT EXISTS (SELECT 1 FROM {MEM} m WHERE m.tenant_id = r.tenant_id AND m.id = r.to_id)""")
def relations_refused(spark, d):
    m = mem(spark, d)
    links = [m.where(c).select("tenant_id", F.col("id").alias("from_id"), F.lower(k).alias("to_id")) for c, k in (("superseded_by_id is not null", "superseded_by_id"), ("status = 'contested' and source_observation_id is not null", "source_observation_id"))]
    return store.foreign_targets(links[0].unionByName(links[1]).distinct(), m, "to_id")


@query("vectors_stored", "SELECT memory_id, model, created_at, len(embedding) AS n, coalesce(embedding[1]::FLOAT, 0) AS first FROM memory_vectors")
def vectors_stored(spark, d):
    rows = table(spark, d, "memory_vectors").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return store.stored_vectors(rows).select("memory_id", "model", "created_at", F.size("embedding").alias("n"), F.coalesce(F.get("embedding", F.lit(0)), F.lit(0.0).cast("float")).alias("first"))


_CLASS = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing' WHEN contains({c}, chr(0)) THEN 'nul' WHEN regexp_full_match(lower({c}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'uuid' ELSE 'other' END"


@query("identifier_classes", " UNION ALL ".join(f"SELECT '{c}' AS field, {_CLASS(c)} AS class, count(*) AS n_rows FROM {MEM} m GROUP BY 2" for c in ("id", "tenant_id", "subject_id", "superseded_by_id", "contested_with_id")))
def identifier_classes(spark, d):
    m = lifecycle.one_each(mem(spark, d))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), checks.identifier_class(F.col(c)).alias("class")) for c in ("id", "tenant_id", "subject_id", "superseded_by_id", "contested_with_id")])
    return m.select(F.inline(fields)).groupBy("field", "class").agg(F.count("*").alias("n_rows"))


@query("event_faults", f"SELECT kind, CASE WHEN kind = 'events_purged' AND memory_id IS NOT NULL THEN 'purge_names_a_memory' WHEN event_at IS NULL THEN 'no_time' WHEN memory_id = '' THEN 'empty_id' WHEN contains(digest_snapshot, chr(0)) THEN 'nul' END AS fault, count(*) AS n_rows FROM {EVENTS} e GROUP BY 1, 2")
def event_faults(spark, d):
    e = lifecycle.one_each(table(spark, d, "memory_events"))
    return e.groupBy("kind", checks.event_fault(F.col("kind"), F.col("memory_id"), F.col("digest_snapshot"), F.col("event_at")).alias("fault")).agg(F.count("*").alias("n_rows"))


@query("typed_events", f"SELECT id, seq, epoch_us(event_at) AS at_us, json_extract_string(actor, '$.kind') AS actor_kind, meta IS NOT NULL AND json_valid(meta) AS has_meta FROM {EVENTS} e")
def typed_events(spark, d):
    """Rows of the log as typed records: times in microseconds, the actor's kind from its JSON."""
    from recallgrid.functions.time import epoch_micros

    e = lifecycle.one_each(table(spark, d, "memory_events"))
    return e.select("id", F.col("seq").cast("bigint").alias("seq"), epoch_micros(spark, F.col("event_at")).alias("at_us"), F.get_json_object("actor", "$.kind").alias("actor_kind"), F.try_parse_json("meta").isNotNull().alias("has_meta"))


@query("candidate_subjects", f"SELECT m.id, CASE WHEN m.status = 'active' THEN m.subject_id ELSE o.subject_id END AS subject_id FROM {MEM} m LEFT JOIN (SELECT DISTINCT ON (id) * FROM observations) o ON o.id = lower(m.source_observation_id)")
def candidate_subjects(spark, d):
    o = lifecycle.one_each(table(spark, d, "observations")).select(F.col("id").alias("source"), F.col("subject_id").alias("observed"))
    m = lifecycle.one_each(mem(spark, d)).select("id", "status", "subject_id", F.lower("source_observation_id").alias("source"))
    return m.join(o, "source", "left").select("id", lifecycle.candidate_subject(F.col("status") == "active", F.col("subject_id"), F.col("observed")).alias("subject_id"))


@query("predicates_as_json", f"SELECT tenant_id, '[' || string_agg('\"' || p || '\"', ',' ORDER BY p) || ']' AS predicates FROM (SELECT DISTINCT tenant_id, replace(replace(claim_key_predicate, '\\\\', '\\\\\\\\'), '\"', '\\\\\"') AS p FROM {MEM} m WHERE claim_key_predicate IS NOT NULL AND NOT regexp_matches(claim_key_predicate, '[\\x00-\\x1f]')) GROUP BY 1".replace("\\\\", "\\"))
def predicates_as_json(spark, d):
    """A tenant's distinct predicates as one JSON list in code-point order; those with control characters, which engines escape differently, aside."""
    p = mem(spark, d).where(F.col("claim_key_predicate").isNotNull() & ~F.col("claim_key_predicate").rlike(r"[\x00-\x1f]")).select("tenant_id", "claim_key_predicate").distinct()
    return p.groupBy("tenant_id").agg(F.to_json(F.array_sort(F.collect_list("claim_key_predicate"))).alias("predicates"))


@query("archive_by_clock", f"""WITH c AS ({_SEQ}), r AS (SELECT m.*, s.decay_clock, coalesce(t.seq, 0) + coalesce(o.seq, 0) AS now_seq FROM {MEM} m LEFT JOIN tenant_settings s ON s.tenant_id = m.tenant_id
 LEFT JOIN c t ON t.tenant_id = m.tenant_id AND t.subject_id IS NULL LEFT JOIN c o ON o.tenant_id = m.tenant_id AND o.subject_id = m.subject_id)
SELECT id, decay_floor_at FROM r WHERE status = 'active' AND CASE WHEN decay_clock = 'activity' THEN decay_floor_seq IS NOT NULL AND decay_floor_seq <= now_seq WHEN decay_clock = 'either' THEN decay_floor_at <= {T} AND decay_floor_seq IS NOT NULL AND decay_floor_seq <= now_seq ELSE decay_floor_at <= {T} END""")
def archive_by_clock(spark, d):
    return lifecycle.archive_sweep_by_clock(recall.clocked(lifecycle.one_each(mem(spark, d)), table(spark, d, "tenant_settings"), counters(spark, d)), NOW)


@query("contest_groups", f"""WITH g AS (SELECT DISTINCT tenant_id || '/' || claim_key_predicate || '/' || claim_key_subject || '/' || subject_id AS group_id, id, status FROM {MEM} m WHERE tenant_id || '/' || claim_key_predicate || '/' || claim_key_subject || '/' || subject_id IS NOT NULL),
n AS (SELECT group_id, count(*) AS n, count(*) FILTER (status = 'active') AS a FROM g GROUP BY 1) SELECT g.group_id, id, CASE WHEN n >= 2 AND n = a THEN 'contested' ELSE 'refused' END AS outcome, CASE WHEN n >= 2 AND n = a THEN 'contested' ELSE status END AS status FROM g JOIN n USING (group_id)""")
def contest_groups(spark, d):
    m = mem(spark, d)
    group = F.concat("tenant_id", F.lit("/"), "claim_key_predicate", F.lit("/"), "claim_key_subject", F.lit("/"), "subject_id")
    return lifecycle.contested_groups(m, m.select(group.alias("group_id"), "id").where("group_id is not null"))


_PAIRS = f"(SELECT id AS winner_id, CASE WHEN ascii(id) % 3 > 0 THEN lower(contested_with_id) END AS loser_id FROM {MEM} m WHERE contested_with_id IS NOT NULL AND id < lower(contested_with_id))"


@query("resolved_pairs", f"""WITH r AS (SELECT p.*, w.status AS w_status, lower(w.contested_with_id) AS w_other, x.status AS p_status, lower(x.contested_with_id) AS p_other FROM {_PAIRS} p LEFT JOIN {MEM} w ON w.id = p.winner_id LEFT JOIN {MEM} x ON x.id = lower(w.contested_with_id)),
f AS (SELECT *, coalesce(w_status = 'contested' AND p_status = 'contested' AND p_other = winner_id, false) AS mutual FROM r), o AS (SELECT *, mutual AND coalesce(w_other = loser_id, false) AS pair, coalesce(w_status = 'contested', false) AND NOT mutual AND loser_id IS NULL AS orphan FROM f)
SELECT winner_id AS id, CASE WHEN pair THEN 'resolved' WHEN orphan THEN 'orphan_resolved' ELSE 'refused' END AS outcome, CASE WHEN pair OR orphan THEN 'active' ELSE w_status END AS status, NULL::VARCHAR AS superseded_by_id FROM o
UNION ALL SELECT loser_id, CASE WHEN pair THEN 'resolved' ELSE 'refused' END, CASE WHEN pair THEN 'superseded' ELSE m.status END, CASE WHEN pair THEN winner_id END FROM o LEFT JOIN {MEM} m ON m.id = loser_id WHERE loser_id IS NOT NULL""")
def resolved_pairs(spark, d):
    m = mem(spark, d)
    asked = m.where("contested_with_id is not null and id < lower(contested_with_id)").selectExpr("id as winner_id", "if(ascii(id) % 3 > 0, lower(contested_with_id), null) as loser_id")
    return lifecycle.resolved(m, asked)


@query("reflected", f"""WITH r AS (SELECT *, tenant_id || '/' || claim_key_predicate AS g FROM {MEM} m WHERE claim_key_predicate IS NOT NULL), s AS (SELECT g, count(*) AS n, list_sort(list(id)) AS sources, max(occurred_at) AS occurred_at FROM r GROUP BY 1 HAVING count(*) >= 2)
SELECT g AS group_key, n AS n_sources, sources, 'About ' || g AS content, sha256('About ' || g) AS content_hash, 'About ' || g AS digest, occurred_at, 'reflected' AS provenance_kind FROM s WHERE n % 2 = 0""")
def reflected(spark, d):
    m = mem(spark, d)
    group = F.concat("tenant_id", F.lit("/"), "claim_key_predicate")
    sizes = lifecycle.one_each(m).where(group.isNotNull()).groupBy(group.alias("group_key")).agg(F.count("*").alias("n"))
    texts = sizes.select("group_key", F.when(F.col("n") % 2 == 0, F.concat(F.lit("About "), "group_key")).alias("content"), F.lit("").alias("digest"), F.lit(None).cast("array<string>").alias("tags"))
    return lifecycle.reflected(m, group, texts).select("group_key", "n_sources", "sources", "content", "content_hash", "digest", "occurred_at", "provenance_kind")


@query("corrected", f"SELECT m.id, 'new-' || substr(m.id, 1, 8) AS new_id, CASE WHEN status = 'active' THEN 'superseded' ELSE 'refused' END AS outcome FROM {MEM} m UNION ALL SELECT 'nobody', 'new', 'not_found'")
def corrected(spark, d):
    m = mem(spark, d)
    asked = m.select("id", F.concat(F.lit("new-"), F.substring("id", 1, 8)).alias("new_id")).unionByName(spark.range(1).selectExpr("'nobody' as id", "'new' as new_id"))
    return lifecycle.corrected(m, asked)


@query("recall_breakdown", _RECALL + f"""SELECT s.id, round(s.total, 9) AS total, round(pow(0.5, ((epoch_us({T})/1000.0 - epoch_us(coalesce(last_reinforced_at, recorded_at)) / 1000.0) / 3600000.0) / half_life_hours::DOUBLE), 9) AS decay, 1 + 0.1::DOUBLE * list_contains(tags, 'billing')::INT AS tag_match, strength::DOUBLE AS strength,
 round(CASE WHEN isnan(f.similarity) THEN 'nan'::DOUBLE ELSE greatest(f.similarity, f.lexical) END, 9) AS affinity, true AS measured FROM scored s JOIN {MEM} m USING (id) JOIN f USING (id)""")
def recall_breakdown(spark, d):
    s = F.col("score")
    return _scored(spark, d).select("id", F.round("total", 9).alias("total"), F.round(s["decay"], 9).alias("decay"), F.round(s["tag_match"], 6).alias("tag_match"), s["strength"].alias("strength"), F.round(s["affinity"], 9).alias("affinity"), s["affinity_measured"].alias("measured"))


@query("recall_truncation", _RECALL + """, b AS (SELECT coalesce(min(total) FILTER (part = 'returned'), 0.1) AS bar, (SELECT min(similarity) FILTER (NOT isnan(similarity)) FROM near) AS last FROM scored)
SELECT round(bar, 9) AS bar, round(last, 9) AS last_similarity, round(CASE WHEN last > 0 THEN bar / (last * 1.1::DOUBLE) END, 9) AS ratio, CASE WHEN NOT last > 0 THEN 'undecidable' WHEN bar / (last * 1.1::DOUBLE) >= 1 THEN 'provably_safe' ELSE 'loss_possible' END AS verdict FROM b""")
def recall_truncation(spark, d):
    found = _scored(spark, d).withColumn("score", F.col("score").withField("similarity", F.when(~F.isnan("score.similarity"), F.col("score.similarity"))))
    return recall.truncation(found, ["billing"]).withColumns({c: F.round(c, 9) for c in ("bar", "last_similarity", "ratio")})


@query("seed_neighbourhood", _RECALL + """, a AS (SELECT id, greatest(CASE WHEN isnan(similarity) THEN NULL ELSE similarity END, lexical) AS affinity FROM f), z AS (SELECT min(id) AS seed FROM f)
SELECT id, round(affinity, 9) AS affinity, place FROM (SELECT id, affinity, row_number() OVER (ORDER BY id = seed DESC, affinity DESC NULLS LAST, id) AS place FROM a, z WHERE affinity >= 0.4 OR id = seed) WHERE place <= 8""")
def seed_neighbourhood(spark, d):
    found = recall.candidates(mem(spark, d), vec(spark, d), QUERY, PHRASES, LIVE)
    seed = found.agg(F.min("id")).first()[0]  # one id
    return recall.neighbourhood(found, seed, 0.4, 8).withColumn("affinity", F.round("affinity", 9))


@query("correction_candidates", _RECALL + "SELECT id, place, round(total, 9) AS total FROM scored WHERE part = 'returned' AND place <> 2 ORDER BY place LIMIT 3")
def correction_candidates(spark, d):
    scored = _scored(spark, d)
    return recall.correction_candidates(scored, scored.where("place = 2 and part = 'returned'").select(F.upper("id").alias("id"))).withColumn("total", F.round("total", 9))


@query("pair_outcomes", "SELECT label AS pair, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS off_passed, count(*) FILTER (vec_id % 4 = 0) AS on_passed, count(*) FILTER (vec_id % 3 = 0)::DOUBLE / count(*) AS off_rate, count(*) FILTER (vec_id % 4 = 0)::DOUBLE / count(*) AS on_rate FROM embeddings GROUP BY 1")
def pair_outcomes(spark, d):
    e = table(spark, d, "embeddings").selectExpr("label as pair", "if(vec_id % 3 = 0, 'correct', 'wrong') as off_verdict", "case when vec_id % 4 = 0 then 'correct' when vec_id % 4 = 1 then 'indeterminate' end as on_verdict")
    return evaluation.pair_outcomes(e)


_REASON = "CASE WHEN provenance_kind = 'consolidated' THEN 'consolidated' WHEN contested_with_id IS NOT NULL THEN 'contested_resolved' WHEN provenance_kind = 'inferred' THEN 'reextract_superseded' END"


@query("superseded_groups", f"""WITH r AS (SELECT id, {_REASON} AS reason FROM {MEM} m WHERE status = 'superseded')
SELECT reason, CASE WHEN reason = 'contested_resolved' THEN id END AS group_key, count(*) AS n_rows, min(id) AS first_id, CASE reason WHEN 'consolidated' THEN 'structural' WHEN 'contested_resolved' THEN 'per_item' ELSE 'unknown' END AS confidence FROM r GROUP BY 1, 2""")
def superseded_groups(spark, d):
    rows = lifecycle.one_each(mem(spark, d).where("status = 'superseded'")).select("id", F.expr(_REASON).alias("reason"))
    return evaluation.superseded_groups(rows)


@query("intrusion_margins", "WITH c AS (SELECT vec_id // 10 AS probe, vec_id, vec_id % 7 <> 0 AND vec_id % 10 < 6 AS kept, (vec_id * 31 % 97) / 97.0::DOUBLE AS score FROM embeddings), p AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) AS place FROM c) SELECT probe, CASE WHEN bool_or(place = 1 AND kept) THEN max(score) FILTER (place = 1) - min(score) FILTER (kept) END AS intrusion_margin FROM p GROUP BY 1")
def intrusion_margins(spark, d):
    from pyspark.sql import Window as W

    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select(F.floor(v / 10).cast("bigint").alias("probe"), F.when(v % 7 != 0, v).alias("id"), (v % 10 < 6).alias("protected"), ((v * 31 % 97) / 97.0).alias("score"), "vec_id")
    return evaluation.intrusion(e.withColumn("place", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))))


_GRID = "(VALUES (0.0::DOUBLE), (0.02), (0.2)) s(sigma), (VALUES (1), (2)) n(seed)"
_FIG = lambda src: f"(SELECT sigma, seed, avg(1.0::DOUBLE / rank) AS mrr FROM (SELECT sigma, seed, probe_id, 1 + count(*) FILTER (noisy > best) AS rank FROM (SELECT *, max(noisy) FILTER (gold) OVER (PARTITION BY sigma, seed, probe_id) AS best FROM (SELECT sigma, seed, probe_id, gold, score * (1 + sigma * {_E('seed', 'probe_id', 'id')}) AS noisy FROM {src} r, {_GRID})) WHERE best IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_DENSE = "(SELECT vec_id // 20 AS probe_id, vec_id AS id, (vec_id * 31 % 97) / 97.0::DOUBLE AS score, vec_id % 20 = 7 AS gold FROM embeddings)"


@query("noise_grid", f"""WITH a AS (SELECT * FROM {_FIG(f"(SELECT * FROM {_DENSE} d WHERE id % 3 = 1 OR gold)")} x), b AS (SELECT * FROM {_FIG(_DENSE)} x), j AS (SELECT a.sigma, a.seed, a.mrr AS s, b.mrr AS d FROM a JOIN b ON a.sigma = b.sigma AND a.seed = b.seed)
SELECT j.sigma, j.seed, round(j.s, 9) AS sparse_mrr, round(j.d, 9) AS dense_mrr, abs(j.s - j.d) < 1e-12 AS mrr_match, (z.s - j.s >= 0.01) = (z.d - j.d >= 0.01) AS red_match FROM j JOIN j z ON z.seed = j.seed AND z.sigma = 0 WHERE j.sigma > 0""")
def noise_grid(spark, d):
    dense = table(spark, d, "embeddings").selectExpr("vec_id div 20 as probe_id", "vec_id as id", "(vec_id * 31 % 97) / 97.0d as score", "vec_id % 20 = 7 as gold")
    return evaluation.noise_grid(dense.where("id % 3 = 1 or gold"), dense, [0.02, 0.2], [1, 2], 0.01).withColumns({"sparse_mrr": F.round("sparse_mrr", 9), "dense_mrr": F.round("dense_mrr", 9)})


_PROBES = "(SELECT label AS arm, CASE WHEN vec_id % 4 > 0 THEN vec_id % 15 + 1 END AS rank, CASE WHEN vec_id % 5 = 1 THEN 'association' ELSE 'query' END AS via, vec_id % 11 AS returned, vec_id % 400 AS memory_chars, vec_id % 90 AS association_chars, CASE WHEN vec_id % 6 = 0 THEN 'off' END AS skipped FROM embeddings)"


@query("first_misses", "SELECT id, round(least(half_life_hours::DOUBLE * log2(strength::DOUBLE / 0.1), half_life_hours::DOUBLE * log2(20)), 6) AS hours FROM (SELECT DISTINCT ON (id) * FROM memories) m")
def first_misses(spark, d):
    """Hours until a memory that a query meets with its strength as relevance falls below either threshold; half lives differ by row."""
    return lifecycle.one_each(mem(spark, d)).select("id", F.round(decay.first_miss_hours(F.col("strength").cast("double"), F.col("half_life_hours").cast("double")), 6).alias("hours"))


@query("association_report", f"SELECT arm, count(*) AS n_probes, count(rank) AS gold_returned, count(*) FILTER (via = 'association') AS via_association, count(*) FILTER (rank = 1) AS hit1, count(*) FILTER (rank <= 10) AS hit10, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr, sum(returned)::BIGINT AS returned, sum(memory_chars)::BIGINT AS memory_chars, sum(association_chars)::BIGINT AS association_chars, count(skipped) AS n_skipped FROM {_PROBES} p GROUP BY 1")
def association_report(spark, d):
    p = table(spark, d, "embeddings").selectExpr("label as arm", "if(vec_id % 4 > 0, vec_id % 15 + 1, null) as rank", "if(vec_id % 5 = 1, 'association', 'query') as via", "vec_id % 11 as returned", "vec_id % 400 as memory_chars", "vec_id % 90 as association_chars", "if(vec_id % 6 = 0, 'off', null) as skipped")
    return evaluation.association_report(p, "arm")


@query("usage_mismatches", f"""WITH u AS (SELECT id AS usage_id, tenant_id, lower(memory_id) AS memory_id, id AS recall_id FROM {EVENTS} e WHERE kind = 'updated'), r AS (SELECT u.recall_id, o.tenant_id AS recall_tenant FROM u JOIN (SELECT DISTINCT ON (id) * FROM observations) o ON o.id = (SELECT lower(source_observation_id) FROM {MEM} m WHERE m.id = u.memory_id))
SELECT u.usage_id, r.recall_tenant <> u.tenant_id AS other_recall, m.tenant_id <> u.tenant_id AS other_memory FROM u JOIN r USING (recall_id) JOIN {MEM} m ON m.id = u.memory_id""")
def usage_mismatches(spark, d):
    """Uses with their recall and memory, and whether these are another tenant's; the use's observation stands for the recall."""
    m = lifecycle.one_each(mem(spark, d)).select(F.col("id").alias("memory_id"), F.col("tenant_id").alias("memory_tenant"), F.lower("source_observation_id").alias("source"))
    uses = lifecycle.one_each(table(spark, d, "memory_events")).where("kind = 'updated'").select(F.col("id").alias("usage_id"), "tenant_id", F.lower("memory_id").alias("memory_id"))
    o = lifecycle.one_each(table(spark, d, "observations")).select(F.col("id").alias("source"), F.col("tenant_id").alias("recall_tenant"))
    recalls = uses.join(m.select("memory_id", "source"), "memory_id").join(o, "source").select(F.col("usage_id").alias("recall_id"), "recall_tenant")
    return outcomes.usage_mismatches(uses.withColumn("recall_id", F.col("usage_id")), recalls, m.select("memory_id", "memory_tenant"))


_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(content, '([\\x00-\\x7f]+)', ' \\1 ', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("sql_token_lines", f"SELECT id, '|' || array_to_string({_TOKENS}, '||') || '|' AS line, len(list_filter({_TOKENS}, lambda x: x = 'user'))::INT AS n FROM {MEM} m")
def sql_token_lines(spark, d):
    register(spark)
    lifecycle.one_each(mem(spark, d)).createOrReplaceTempView("rg_memories")
    return spark.sql("SELECT id, rg_token_line(content) AS line, rg_occurrences(rg_token_line(content), 'user') AS n FROM rg_memories")


round_both(Q, S, {"pair_outcomes": ["off_rate", "on_rate"], "association_report": ["mrr"], "intrusion_margins": ["intrusion_margin"]})
QUERIES, ORACLES = Q, S
