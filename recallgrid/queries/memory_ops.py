"""Queries of the retrieval, scope, lifecycle, audit, queue and evaluation operators, with DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from recallgrid.functions import decay, scoring, text, vectors
from recallgrid.functions.time import epoch_micros
from recallgrid.operators import audit, evaluation, graph, lifecycle, outbox, scope, search
from recallgrid.operators.scope import Scope
from recallgrid.plans import recall
from recallgrid.queries import round_both
from recallgrid.sources.tables import table

NOW, TENANT, MODEL = "2018-02-20 00:00:00", "tenant-0042", "memo-embed-2"
LABELS = ["billing", "research", "archive"]
QUERY = [round(0.05 * ((i * 37) % 19 - 9), 2) for i in range(64)]
PHRASES = [["open", "items"], ["user"], ["project"]]
SCOPE = Scope(TENANT, valid_at=NOW, alive_at=NOW, since="2018-01-05 00:00:00", until="2018-02-18 00:00:00")
LIVE = Scope(TENANT)

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def sql_list(values) -> str:
    return "[" + ", ".join(str(v) if not isinstance(v, str) else f"'{v}'" for v in values) + "]"


MEM = "(SELECT DISTINCT ON (id) * FROM memories)"
T = f"TIMESTAMP '{NOW}'"
EFF = "coalesce(occurred_at, recorded_at)"
INSIDE = f"tenant_id = '{TENANT}' AND status IN ('active','contested') AND {EFF} >= TIMESTAMP '2018-01-05' AND {EFF} <= TIMESTAMP '2018-02-18' AND (valid_from IS NULL OR valid_from <= {T}) AND (valid_until IS NULL OR valid_until > {T}) AND decay_floor_at > {T}"
LIVE_SQL = f"tenant_id = '{TENANT}' AND status IN ('active','contested')"
VEC = f"(SELECT tenant_id, memory_id, arg_max(embedding, created_at) AS embedding FROM memory_vectors WHERE model = '{MODEL}' GROUP BY ALL)"


def _distance(a: str, b: str) -> str:
    n = f"sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {a}])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {b}]))"
    d = f"list_sum([x[1]::DOUBLE * x[2]::DOUBLE FOR x IN list_zip({a}, {b})])"
    return f"CASE WHEN len({a}) = len({b}) AND {n} > 0 THEN 1 - {d} / ({n}) ELSE 'nan'::DOUBLE END"


def mem(spark, d):
    return table(spark, d, "memories")


def vec(spark, d):
    return search.latest_vectors(table(spark, d, "memory_vectors"), MODEL)


@query("scope_filter", f"SELECT id, {EFF} AS at FROM {MEM} m WHERE {INSIDE}")
def scope_filter(spark, d):
    return lifecycle.one_each(mem(spark, d).where(SCOPE.filter())).select("id", scope.effective_time().alias("at"))


WIDE = Scope(TENANT, statuses=("active",), subject="subj-shared", include_subjectless=True, attributes={"channel": "chat"}, labels=LABELS, exclude_provenance=("imported",))


@query("scope_labels_attributes", f"SELECT id FROM {MEM} m WHERE tenant_id = '{TENANT}' AND status = 'active' AND (subject_id = 'subj-shared' OR subject_id IS NULL) AND attributes['channel'] = 'chat' AND list_has_any(tags, {sql_list(LABELS)}) AND provenance_kind <> 'imported'")
def scope_labels_attributes(spark, d):
    return lifecycle.one_each(mem(spark, d).where(WIDE.filter())).select("id")


@query("scope_activity_gate", f"SELECT id FROM {MEM} m WHERE tenant_id = '{TENANT}' AND status IN ('active','contested') AND (decay_floor_at > {T} OR decay_floor_seq IS NULL OR decay_floor_seq > 500)")
def scope_activity_gate(spark, d):
    return lifecycle.one_each(mem(spark, d).where(Scope(TENANT, alive_at=NOW, alive_seq=500, any_axis=True).filter())).select("id")


_P = f"({EFF} >= TIMESTAMP '2018-01-05' AND {EFF} <= TIMESTAMP '2018-02-18')"
_V = f"((valid_from IS NULL OR valid_from <= {T}) AND (valid_until IS NULL OR valid_until > {T}))"
_A = f"(decay_floor_at > {T})"
_L = "status IN ('active','contested')"


@query("scope_aggregate", f"""SELECT count(*) FILTER ({_L} AND {_P} AND {_V} AND {_A}) AS in_scope,
 count(*) FILTER ({_L} AND {_P} AND {_V} AND {_A} AND embedding_status='pending') AS not_indexed_pending, count(*) FILTER ({_L} AND {_P} AND {_V} AND {_A} AND embedding_status='failed') AS not_indexed_failed,
 count(*) FILTER ({_L} AND {_P} AND {_V} AND {_A} AND embedding_status='skipped') AS not_indexed_skipped, count(*) FILTER (status='archived') AS archived, count(*) FILTER (status='superseded') AS superseded, count(*) FILTER (status='forgotten') AS forgotten,
 count(*) FILTER ({_L} AND NOT {_P}) AS filtered_period, count(*) FILTER ({_L} AND {_P} AND valid_until <= {T}) AS filtered_expired, count(*) FILTER ({_L} AND {_P} AND NOT coalesce(valid_until <= {T}, false) AND valid_from > {T}) AS filtered_not_yet_valid,
 count(*) FILTER ({_L} AND {_P} AND {_V} AND NOT {_A}) AS filtered_decayed, count(*) FILTER ({_L} AND {_P} AND {_V} AND {_A} AND provenance_kind IN ('imported', 'inferred')) AS excluded_provenance FROM {MEM} m WHERE tenant_id = '{TENANT}'""")
def scope_aggregate(spark, d):
    return scope.scope_aggregate(mem(spark, d), replace(SCOPE, exclude_provenance=("imported", "inferred")))


@query("subject_groups", f"SELECT subject_id, count(*) AS n_rows FROM {MEM} m WHERE {LIVE_SQL} GROUP BY 1")
def subject_groups(spark, d):
    return scope.subject_groups(lifecycle.one_each(mem(spark, d).where(LIVE.filter())), LIVE)


@query("label_groups", f"""WITH r AS (SELECT list_intersect(tags, {sql_list(LABELS)}) AS h FROM {MEM} m WHERE {LIVE_SQL})
SELECT label, count(*) AS n_rows FROM (SELECT unnest(h) AS label FROM r UNION ALL SELECT NULL FROM r WHERE len(h) = 0) GROUP BY 1""")
def label_groups(spark, d):
    return scope.label_groups(lifecycle.one_each(mem(spark, d).where(LIVE.filter())), LIVE, LABELS)


@query("label_counts", f"SELECT tenant_id, label, count(*) AS n_rows FROM (SELECT tenant_id, unnest(tags) AS label FROM {MEM} m) GROUP BY ALL")
def label_counts(spark, d):
    return lifecycle.one_each(mem(spark, d)).select("tenant_id", F.explode("tags").alias("label")).groupBy("tenant_id", "label").agg(F.count("*").alias("n_rows"))


@query("memory_labels", "SELECT DISTINCT tenant_id, id, label FROM (SELECT tenant_id, id, unnest(tags) AS label FROM memories)")
def memory_labels(spark, d):
    return mem(spark, d).select("tenant_id", "id", F.explode("tags").alias("label")).distinct()


@query("claim_predicates", f"SELECT claim_key_predicate AS predicate, max(created_at) AS newest FROM memories WHERE tenant_id='{TENANT}' AND status='active' AND claim_key_predicate IS NOT NULL GROUP BY 1 ORDER BY newest DESC, predicate LIMIT 20")
def claim_predicates(spark, d):
    rows = mem(spark, d).where((F.col("tenant_id") == TENANT) & (F.col("status") == "active") & F.col("claim_key_predicate").isNotNull())
    return rows.groupBy(F.col("claim_key_predicate").alias("predicate")).agg(F.max("created_at").alias("newest")).orderBy(F.desc("newest"), "predicate").limit(20)


@query("digest_band", f"""WITH o AS (SELECT id FROM {MEM} m WHERE {INSIDE} ORDER BY {EFF} DESC, id LIMIT 10), r AS (SELECT id, {EFF} AS eff, substr(digest,1,120) AS dg FROM {MEM} m WHERE {INSIDE} AND id NOT IN (SELECT id FROM o) ORDER BY eff DESC, id DESC LIMIT 50),
c AS (SELECT id, row_number() OVER w AS place, sum(length(dg)+64) OVER w AS used FROM r WINDOW w AS (ORDER BY eff DESC, id DESC))
SELECT id, place, used::BIGINT AS used FROM c WHERE used <= 4000""")
def digest_band(spark, d):
    returned = lifecycle.one_each(mem(spark, d).where(SCOPE.filter())).orderBy(F.desc(scope.effective_time()), "id").limit(10)
    return scope.digest_band(mem(spark, d), SCOPE, returned=returned)


_MS = "epoch_us(coalesce(last_reinforced_at, recorded_at)) / 1000.0"


@query("decay_values", f"""SELECT id, round(strength::DOUBLE * pow(0.5, ((epoch_us({T})/1000.0 - {_MS}) / 3600000.0) / half_life_hours::DOUBLE), 9) AS strength_now,
 CASE WHEN strength::DOUBLE <= 0.05 THEN 0 ELSE round(half_life_hours::DOUBLE * log2(strength::DOUBLE / 0.05), 6) END AS offset_hours,
 CASE WHEN strength::DOUBLE <= 0.05 THEN decay_base_seq ELSE (decay_base_seq + ceil(half_life_recalls::DOUBLE * log2(strength::DOUBLE / 0.05)))::BIGINT END AS floor_seq FROM {MEM} m""")
def decay_values(spark, d):
    rows = lifecycle.one_each(mem(spark, d))
    ms = lambda c: epoch_micros(spark, c) / 1000.0
    s, h = F.col("strength").cast("double"), F.col("half_life_hours").cast("double")
    base = ms(F.coalesce("last_reinforced_at", "recorded_at"))
    now = ms(F.lit(NOW).cast("timestamp_ntz"))
    floor = F.when(F.col("decay_base_seq").isNotNull() & (F.col("half_life_recalls").isNotNull() | (s <= 0.05)), decay.activity_floor(s, F.col("decay_base_seq"), F.col("half_life_recalls").cast("double")))
    return rows.select("id", F.round(decay.wall_strength(s, base, now, h), 9).alias("strength_now"), F.round(decay.floor_offset(s, h), 6).alias("offset_hours"), floor.alias("floor_seq"))


_SEQ = "SELECT tenant_id, CASE WHEN kind = 'utterance' THEN subject_id END AS subject_id, count(*) AS seq FROM (SELECT DISTINCT ON (id) * FROM observations) GROUP BY ALL"


def counters(spark, d):
    o = lifecycle.one_each(table(spark, d, "observations"))
    return outbox.activity(o.select("tenant_id", F.when(F.col("kind") == "utterance", F.col("subject_id")).alias("subject_id")))


@query("scoring_decay", f"""WITH c AS ({_SEQ}),
r AS (SELECT m.*, s.decay_clock, coalesce(t.seq, 0) + coalesce(o.seq, 0) AS now_seq, pow(0.5, ((epoch_us({T})/1000.0 - {_MS}) / 3600000.0) / half_life_hours::DOUBLE) AS wall FROM {MEM} m LEFT JOIN tenant_settings s ON s.tenant_id = m.tenant_id
 LEFT JOIN c t ON t.tenant_id = m.tenant_id AND t.subject_id IS NULL LEFT JOIN c o ON o.tenant_id = m.tenant_id AND o.subject_id = m.subject_id),
a AS (SELECT *, pow(0.5, (now_seq - decay_base_seq) / half_life_recalls::DOUBLE) AS act FROM r)
SELECT id, decay_clock, now_seq::BIGINT AS now_seq, round(CASE WHEN decay_clock = 'activity' THEN coalesce(act, wall) WHEN decay_clock = 'either' THEN greatest(wall, coalesce(act, wall)) ELSE wall END, 9) AS decay,
 decay_floor_seq IS NULL OR decay_floor_seq > now_seq AS alive FROM a""")
def scoring_decay(spark, d):
    rows = recall.clocked(lifecycle.one_each(mem(spark, d)), table(spark, d, "tenant_settings"), counters(spark, d))
    return rows.select("id", "decay_clock", "now_seq", F.round(recall.scoring_decay(rows, NOW), 9).alias("decay"), decay.alive_on_activity(F.col("decay_floor_seq"), F.col("now_seq")).alias("alive"))


@query("validity_classes", f"SELECT coalesce(k, 'valid') AS class, count(*) AS n_rows FROM (SELECT CASE WHEN valid_until <= {T} THEN 'expired' WHEN valid_from > {T} THEN 'not_yet_valid' END AS k FROM {MEM} m) GROUP BY 1")
def validity_classes(spark, d):
    at = F.lit(NOW).cast("timestamp_ntz")
    k = scoring.validity_class(F.col("valid_from"), F.col("valid_until"), at)
    return lifecycle.one_each(mem(spark, d)).groupBy(F.coalesce(k, F.lit("valid")).alias("class")).agg(F.count("*").alias("n_rows"))


_VS = f"""WITH s AS (SELECT id, recorded_at FROM {MEM} m WHERE {LIVE_SQL}), q AS (SELECT {sql_list(QUERY)}::DOUBLE[] AS q),
d AS (SELECT id, recorded_at, {_distance('embedding', 'q')} AS distance FROM s JOIN {VEC} v ON v.memory_id = s.id AND v.tenant_id = '{TENANT}', q)"""


@query("vector_search", _VS + " SELECT id, round(distance, 9) AS distance, recorded_at FROM d ORDER BY isnan(d.distance), d.distance, recorded_at DESC, id LIMIT 40")
def vector_search(spark, d):
    return search.vector_search(mem(spark, d), vec(spark, d), QUERY, LIVE, 40).withColumn("distance", F.round("distance", 9))


@query("vector_search_many")
def vector_search_many(spark, d):
    """Every twentieth of the tenant's ids by CRC-32, against all its rows in scope."""
    own = vec(spark, d)
    asked = own.where((F.col("tenant_id") == TENANT) & (F.size("embedding") == 64) & (F.crc32("memory_id") % 20 == 0))
    queries = asked.select(F.col("memory_id").alias("key"), F.lit(0).alias("position"), F.col("embedding").alias("query"))
    return search.vector_search_many(mem(spark, d), own, queries, LIVE, 10).withColumn("distance", F.round("distance", 9))


_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace(content, '([\\x00-\\x7f]+)', ' \\1 ', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_LEX = f"""WITH s AS (SELECT id, recorded_at, '|' || array_to_string({_TOK}, '||') || '|' AS line FROM {MEM} m WHERE {LIVE_SQL}),
c AS (SELECT id, recorded_at, len(regexp_extract_all(line, '\\|open\\|\\|items\\|')) AS a, len(regexp_extract_all(line, '\\|user\\|')) AS b, len(regexp_extract_all(line, '\\|project\\|')) AS c FROM s),
l AS (SELECT id, recorded_at, ((a>0)::INT + (b>0)::INT + (c>0)::INT) / 3.0::DOUBLE AS coverage, (a+b+c)::BIGINT AS rank FROM c WHERE a+b+c > 0 ORDER BY coverage DESC, rank DESC, recorded_at DESC, id LIMIT 40)"""


@query("lexical_search", _LEX + " SELECT id, coverage, rank, recorded_at FROM l")
def lexical_search(spark, d):
    return search.lexical_search(mem(spark, d), PHRASES, LIVE, 40)


_RECALL = _VS + ", " + _LEX[5:].replace("s AS", "s2 AS", 1).replace("FROM s)", "FROM s2)") + f""",
near AS (SELECT id, 1 - distance AS similarity FROM (SELECT * FROM d ORDER BY isnan(d.distance), d.distance, recorded_at DESC, id LIMIT 40)),
f AS (SELECT coalesce(n.id, l.id) AS id, similarity, coverage AS lexical FROM near n FULL JOIN l ON n.id = l.id),
j AS (SELECT m.*, f.similarity, f.lexical FROM f JOIN {MEM} m ON m.id = f.id),
t AS (SELECT id, {EFF} AS eff, length(digest) AS digest_length,
  (CASE WHEN isnan(similarity) THEN 'nan'::DOUBLE ELSE greatest(similarity, lexical) END) * (0.5 + 0.5 * pow(0.5, ((epoch_us({T})/1000.0 - {_MS}) / 3600000.0) / half_life_hours::DOUBLE)
  * CASE WHEN occurred_at IS NULL THEN 1 ELSE least(1, pow(0.5, ((epoch_us({T}) - epoch_us(occurred_at)) / 3600000000.0) / half_life_hours::DOUBLE)) END) * (1 + 0.1 * list_contains(tags, 'billing')::INT) * strength::DOUBLE AS total FROM j),
p AS (SELECT *, CASE WHEN isnan(total) THEN 'not_comparable' WHEN total >= 0.1 THEN 'passed' ELSE 'below' END AS side FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY isnan(total), total DESC, eff DESC, id) AS place FROM p),
scored AS (SELECT id, total, CASE WHEN side = 'not_comparable' THEN side WHEN side = 'below' THEN 'below_threshold' WHEN place <= 10 THEN 'returned' ELSE 'over_limit' END AS part, place, digest_length FROM r)
"""


def _scored(spark, d):
    memories = mem(spark, d)
    found = recall.candidates(memories, vec(spark, d), QUERY, PHRASES, LIVE)
    return recall.rescored(found, memories.where(LIVE.tenant_filter()), NOW, ["billing"])


@query("recall", _RECALL + "SELECT id, round(total, 9) AS total, part, place FROM scored")
def recall_query(spark, d):
    return _scored(spark, d).select("id", F.round("total", 9).alias("total"), "part", "place")


@query("recall_omissions", _RECALL + "SELECT part AS kind, count(*) AS n_rows FROM scored WHERE part <> 'returned' GROUP BY 1")
def recall_omissions(spark, d):
    return recall.omissions(_scored(spark, d))


@query("recall_near_misses", _RECALL + "SELECT id, round(total, 9) AS total, place FROM scored WHERE part = 'below_threshold' AND place <= 5")
def recall_near_misses(spark, d):
    return recall.near_misses(_scored(spark, d)).withColumn("total", F.round("total", 9))


@query("recall_budget", _RECALL + "SELECT id, place, sum(digest_length) OVER (ORDER BY place) <= 400 AND sum(ceil(digest_length / 4.0)) OVER (ORDER BY place) <= 90 AS kept FROM scored WHERE part = 'returned'")
def recall_budget(spark, d):
    return recall.budget_cut(_scored(spark, d).where("part = 'returned'"), 400, 90)


@query("recall_associated", _RECALL + f""",
top AS (SELECT id AS key, place AS anchor_place, embedding AS q FROM scored JOIN {VEC} v ON v.memory_id = scored.id AND v.tenant_id = '{TENANT}' WHERE part = 'returned' AND place <= 3),
pairs AS (SELECT key, anchor_place, s.id, recorded_at, {_distance('embedding', 'q')} AS distance FROM s JOIN {VEC} v ON v.memory_id = s.id AND v.tenant_id = '{TENANT}', top),
near2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY isnan(distance), distance, recorded_at DESC, id) AS n FROM pairs) WHERE n <= 40 AND NOT isnan(distance) AND 1 - distance >= 0.3 AND id NOT IN (SELECT id FROM scored WHERE part = 'returned')),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY anchor_place) AS m FROM near2) WHERE m = 1),
own AS (SELECT id, (0.5 + 0.5 * pow(0.5, ((epoch_us({T})/1000.0 - {_MS}) / 3600000.0) / half_life_hours::DOUBLE)
  * CASE WHEN occurred_at IS NULL THEN 1 ELSE least(1, pow(0.5, ((epoch_us({T}) - epoch_us(occurred_at)) / 3600000000.0) / half_life_hours::DOUBLE)) END) * strength::DOUBLE AS total FROM {MEM} m),
ranked AS (SELECT id, key AS anchor_id, 1 - distance AS anchor_similarity, (1 - distance) * total AS rank_key, row_number() OVER (ORDER BY (1 - distance) * total DESC, id) AS place FROM first JOIN own USING (id))
SELECT id, anchor_id, round(anchor_similarity, 9) AS anchor_similarity, round(rank_key, 9) AS rank_key, place FROM ranked WHERE place <= 10""")
def recall_associated(spark, d):
    found = recall.associated(_scored(spark, d), mem(spark, d), vec(spark, d), LIVE, NOW, least=0.3)
    return found.withColumns({"anchor_similarity": F.round("anchor_similarity", 9), "rank_key": F.round("rank_key", 9)})


@query("contested_companions", f"""WITH s AS (SELECT DISTINCT id, lower(contested_with_id) AS other FROM {MEM} m WHERE contested_with_id IS NOT NULL)
SELECT a.id, a.other AS companion_id FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.id = a.other AND b.other = a.id)""")
def contested_companions(spark, d):
    memories = mem(spark, d)
    return recall.companions(lifecycle.one_each(memories), memories)


@query("one_sided_pairs", f"""WITH s AS (SELECT DISTINCT id, lower(contested_with_id) AS other FROM {MEM} m WHERE contested_with_id IS NOT NULL)
SELECT a.id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id = a.other AND b.other = a.id)""")
def one_sided_pairs(spark, d):
    return audit.one_sided_pairs(mem(spark, d))


_RULES = {"strength": "NOT (strength > 0 AND strength <= 1)", "half_life": "NOT (half_life_hours > 0 AND NOT isinf(half_life_hours))", "needs_source": "provenance_kind IN ('stated','inferred') AND source_observation_id IS NULL", "kind_matches": "coalesce(json_extract_string(provenance, '$.kind') <> provenance_kind, true)", "status": "status NOT IN ('active','superseded','contested','archived','forgotten')", "embedding_status": "embedding_status NOT IN ('pending','ready','failed','skipped')", "inverted_validity": "valid_until <= valid_from", "superseded_link": "status = 'superseded' AND superseded_by_id IS NULL"}


@query("integrity_rules", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({c}) AS n_rows FROM {MEM} m" for k, c in _RULES.items()))
def integrity_rules(spark, d):
    return audit.violations(mem(spark, d))


@query("foreign_references", " UNION ALL ".join(f"SELECT '{c}' AS kind, a.id, lower(a.{c}) AS other_id FROM {MEM} a JOIN (SELECT DISTINCT ON (id) * FROM {t}) b ON b.id = lower(a.{c}) WHERE a.tenant_id <> b.tenant_id" for c, t in (("superseded_by_id", "memories"), ("contested_with_id", "memories"), ("source_observation_id", "observations"))))
def foreign_references(spark, d):
    return audit.foreign_references(mem(spark, d), table(spark, d, "observations"))


@query("basis_lost", f"""WITH b AS (SELECT a.id, c.status, c.purged_at FROM {MEM} a JOIN {MEM} c ON c.tenant_id = a.tenant_id AND lower(c.source_observation_id) = lower(a.source_observation_id) AND c.provenance_kind = 'stated' WHERE a.provenance_kind = 'inferred')
SELECT id, count(*) AS n_basis, count(*) FILTER (status = 'forgotten' OR purged_at IS NOT NULL) AS n_lost FROM b GROUP BY 1 HAVING count(*) FILTER (status = 'forgotten' OR purged_at IS NOT NULL) > 0""")
def basis_lost(spark, d):
    m = mem(spark, d)
    return audit.basis_lost(m, audit.stated_basis(m))


@query("claim_conflicts", f"""WITH r AS (SELECT tenant_id, subject_id, claim_key_subject, claim_key_predicate, id, coalesce(epoch_us(valid_from), -4611686018427387904) AS a, coalesce(epoch_us(valid_until), 4611686018427387904) AS b FROM {MEM} m WHERE status IN ('active','contested'))
SELECT x.id, count(*) AS n_overlaps FROM r x JOIN r y ON x.tenant_id = y.tenant_id AND x.subject_id = y.subject_id AND x.claim_key_subject = y.claim_key_subject AND x.claim_key_predicate = y.claim_key_predicate AND x.id <> y.id AND x.a < y.b AND y.a < x.b WHERE x.a < x.b AND y.a < y.b GROUP BY 1""")
def claim_conflicts(spark, d):
    return audit.claim_conflicts(mem(spark, d))


@query("archive_sweep", f"SELECT id, decay_floor_at FROM {MEM} m WHERE status = 'active' AND decay_floor_at <= {T} ORDER BY decay_floor_at, id LIMIT 200")
def archive_sweep(spark, d):
    return lifecycle.archive_sweep(mem(spark, d), NOW, 200)


@query("requeue", f"SELECT id, updated_at FROM {MEM} m WHERE status IN ('active','contested') AND embedding_status <> 'ready' ORDER BY updated_at, id LIMIT 200")
def requeue(spark, d):
    return lifecycle.requeue(mem(spark, d), 200)


EVENTS = "(SELECT DISTINCT ON (id) * FROM memory_events)"


@query("expired_events", f"SELECT e.id, e.event_at FROM {EVENTS} e JOIN tenant_settings s USING (tenant_id) WHERE s.event_retention_days IS NOT NULL AND e.event_at < {T} - to_days(s.event_retention_days) AND e.kind <> 'events_purged'")
def expired_events(spark, d):
    return lifecycle.expired_events(table(spark, d, "memory_events"), table(spark, d, "tenant_settings"), NOW).select("id", "event_at")


@query("event_log", f"SELECT id, kind, event_at, seq FROM {EVENTS} e WHERE tenant_id='{TENANT}' AND kind IN ('archived','restored') AND event_at >= TIMESTAMP '2018-01-10' AND event_at <= TIMESTAMP '2018-02-10' ORDER BY event_at, seq LIMIT 100")
def event_log(spark, d):
    e = table(spark, d, "memory_events").where((F.col("tenant_id") == TENANT) & F.col("kind").isin("archived", "restored") & F.col("event_at").between(F.lit("2018-01-10").cast("timestamp_ntz"), F.lit("2018-02-10").cast("timestamp_ntz")))
    return lifecycle.one_each(e).orderBy("event_at", "seq").limit(100).select("id", "kind", "event_at", "seq")


_STEP = "CASE " + " ".join(f"WHEN state = '{a}' AND kind = '{k}' THEN '{b}'" for a, k, b in lifecycle.TRANSITIONS) + " ELSE state END"


@query("replayed_status", f"""WITH RECURSIVE e AS (SELECT lower(memory_id) AS memory_id, kind, row_number() OVER (PARTITION BY lower(memory_id) ORDER BY event_at, seq, kind) AS n FROM (SELECT DISTINCT ON (id) * FROM memory_events) WHERE memory_id IS NOT NULL),
w AS (SELECT DISTINCT memory_id, 'active' AS state, 0::BIGINT AS n FROM e UNION ALL SELECT memory_id, {_STEP} AS state, e.n FROM w JOIN e USING (memory_id) WHERE e.n = w.n + 1)
SELECT memory_id, arg_max(state, n) AS status, max(n) AS n_events FROM w GROUP BY 1""")
def replayed_status(spark, d):
    return lifecycle.replayed_status(table(spark, d, "memory_events"))


def _uses(spark, d):
    return table(spark, d, "memory_events").where("kind = 'updated'").select("memory_id", F.col("event_at").alias("used_at"))


@query("reinforced", f"""WITH u AS (SELECT lower(memory_id) AS id, max(event_at) AS used_at FROM memory_events WHERE kind = 'updated' AND memory_id IS NOT NULL GROUP BY 1)
SELECT m.id, u.used_at AS last_reinforced_at, floor(epoch_us(u.used_at) / 1000.0 + CASE WHEN strength::DOUBLE <= 0.05 THEN 0 ELSE half_life_hours::DOUBLE * log2(strength::DOUBLE / 0.05) END * 3600000.0)::BIGINT AS floor_ms
FROM {MEM} m JOIN u USING (id) WHERE m.last_reinforced_at IS NULL OR u.used_at > m.last_reinforced_at""")
def reinforced(spark, d):
    return lifecycle.reinforced(mem(spark, d), _uses(spark, d))


@query("purged_tombstones", f"SELECT id, tenant_id, subject_id, content_hash, '' AS content, '' AS digest, 'forgotten' AS status FROM {MEM} m WHERE id IN (SELECT lower(memory_id) FROM memory_events WHERE kind = 'purged')")
def purged_tombstones(spark, d):
    return lifecycle.purged_content(mem(spark, d), table(spark, d, "memory_events"))


@query("consolidated", f"""WITH r AS (SELECT *, tenant_id || '/' || claim_key_predicate AS g FROM {MEM} m WHERE claim_key_predicate IS NOT NULL),
s AS (SELECT g, count(*) AS n, CASE WHEN count(DISTINCT coalesce(subject_id, chr(0))) = 1 THEN max(subject_id) END AS subject_id, max(occurred_at) AS occurred_at, max(valid_from) AS valid_from, min(valid_until) AS valid_until FROM r GROUP BY 1),
u AS (SELECT g, recorded_at, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM r),
f AS (SELECT g, tag, row_number() OVER (PARTITION BY g, tag ORDER BY recorded_at, id, pos) AS k, recorded_at, id, pos FROM u),
t AS (SELECT g, list(tag ORDER BY recorded_at, id, pos) AS tags FROM f WHERE k = 1 GROUP BY 1),
a AS (SELECT g, e.key AS k, e.value AS v, count(*) AS n FROM (SELECT g, unnest(map_entries(attributes)) AS e FROM r) GROUP BY ALL),
c AS (SELECT a.g, list_sort(list(k || '=' || v)) AS attributes FROM a JOIN s ON s.g = a.g AND s.n = a.n GROUP BY 1)
SELECT s.g AS group_key, s.n AS n_sources, subject_id, occurred_at, valid_from, valid_until, coalesce(tags, []) AS tags, coalesce(attributes, []) AS attributes FROM s LEFT JOIN t USING (g) LEFT JOIN c USING (g) WHERE s.n >= 2""")
def consolidated(spark, d):
    return lifecycle.consolidated(mem(spark, d), F.concat("tenant_id", F.lit("/"), "claim_key_predicate"))


@query("chunked", f"""WITH p AS (SELECT id, tenant_id, (row_number() OVER (PARTITION BY tenant_id ORDER BY recorded_at, id) - 1) // 7 AS chunk FROM {MEM} m WHERE status = 'archived'),
n AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, chunk) AS n FROM p) SELECT id, tenant_id, chunk::BIGINT AS chunk FROM n WHERE n > 1""")
def chunked(spark, d):
    return lifecycle.chunks(lifecycle.one_each(mem(spark, d).where("status = 'archived'")), "tenant_id", "recorded_at", 7)


@query("vector_upsert", "SELECT tenant_id, memory_id, max(created_at) AS created_at FROM memory_vectors GROUP BY ALL")
def vector_upsert(spark, d):
    v = table(spark, d, "memory_vectors").select("tenant_id", "memory_id", "created_at")
    return lifecycle.upserted(v.where("created_at < timestamp_ntz'2018-01-20'"), v.where("created_at >= timestamp_ntz'2018-01-20'"), ["tenant_id", "memory_id"], "created_at")


@query("relations_insert", """WITH e AS (SELECT DISTINCT tenant_id, id AS from_id, lower(contested_with_id) AS to_id FROM memories WHERE contested_with_id IS NOT NULL)
SELECT tenant_id, to_id AS from_id, from_id AS to_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.tenant_id = e.tenant_id AND x.from_id = e.to_id AND x.to_id = e.from_id)""")
def relations_insert(spark, d):
    e = mem(spark, d).where("contested_with_id is not null").select("tenant_id", F.col("id").alias("from_id"), F.lower("contested_with_id").alias("to_id"))
    back = e.select("tenant_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return lifecycle.inserted_once(back, e, ["tenant_id", "from_id", "to_id"])


@query("superseded_roots", f"""WITH RECURSIVE l AS (SELECT id, lower(superseded_by_id) AS parent_id FROM {MEM} m WHERE superseded_by_id IS NOT NULL),
w AS (SELECT id, parent_id AS root_id, 1::BIGINT AS depth FROM l UNION ALL SELECT w.id, l.parent_id, w.depth + 1 FROM w JOIN l ON l.id = w.root_id WHERE w.depth < 60 AND l.parent_id <> w.root_id)
SELECT id, root_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS n FROM w) WHERE n = 1""")
def superseded_roots(spark, d):
    return graph.roots(lifecycle.one_each(mem(spark, d)).where("superseded_by_id is not null").select("id", F.lower("superseded_by_id").alias("parent_id")))


@query("contested_reach", f"""WITH RECURSIVE m AS (SELECT id, lower(contested_with_id) AS other, status FROM {MEM} x WHERE contested_with_id IS NOT NULL),
e AS (SELECT id AS from_id, other AS to_id FROM m UNION SELECT other, id FROM m), k AS (SELECT from_id, to_id FROM e WHERE to_id IN (SELECT id FROM m WHERE status = 'contested')),
w AS (SELECT id AS owner_id, id, 0 AS level FROM m UNION SELECT w.owner_id, k.to_id AS id, w.level + 1 FROM w JOIN k ON k.from_id = w.id WHERE w.level < 12),
b AS (SELECT owner_id, id, min(level) AS level FROM w GROUP BY 1, 2)
SELECT owner_id, id, level FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY level, id) AS n FROM b WHERE level > 0) WHERE n <= 10""")
def contested_reach(spark, d):
    m = lifecycle.one_each(mem(spark, d)).where("contested_with_id is not null")
    edges = m.select(F.col("id").alias("from_id"), F.lower("contested_with_id").alias("to_id"))
    both = edges.unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return graph.reachable(m.select("id"), both, m.where("status = 'contested'").select("id"), 10)


@query("related_lists", """WITH e AS (SELECT id AS from_id, lower(contested_with_id) AS to_id FROM memories WHERE contested_with_id IS NOT NULL UNION SELECT lower(contested_with_id), id FROM memories WHERE contested_with_id IS NOT NULL),
i AS (SELECT row_number() OVER (ORDER BY id) - 1 AS position, id FROM (SELECT DISTINCT id FROM memories WHERE id IS NOT NULL))
SELECT position::BIGINT AS position, i.id, coalesce(list_sort(list(DISTINCT to_id) FILTER (to_id IS NOT NULL)), []) AS related FROM i LEFT JOIN e ON e.from_id = i.id GROUP BY ALL""")
def related_lists(spark, d):
    m = mem(spark, d)
    e = m.where("contested_with_id is not null").select(F.col("id").alias("from_id"), F.lower("contested_with_id").alias("to_id"))
    both = e.unionByName(e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return graph.adjacency(graph.numbered(m.where("id is not null").select("id").distinct()), both)


# The queue is projected from the event stream: every row is a job.
JOBS = """(SELECT event_id AS job_id, ts AS available_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS claimed_at, event_id % 4 AS attempts,
 CASE WHEN event_type = 'signup' THEN ts + INTERVAL 2 HOUR END AS completed_at, CASE WHEN event_type = 'error' THEN ts + INTERVAL 2 HOUR END AS failed_at FROM events)"""
JOB_NOW = "2024-01-20 00:00:00"


def jobs(spark, d):
    e = table(spark, d, "events")
    return e.selectExpr("event_id as job_id", "ts as available_at", "case when event_id % 3 <> 0 then ts + interval 1 hour end as claimed_at", "event_id % 4 as attempts", "case when event_type = 'signup' then ts + interval 2 hours end as completed_at", "case when event_type = 'error' then ts + interval 2 hours end as failed_at")


@query("outbox_claim", f"""SELECT job_id, attempts + 1 AS attempt, CASE WHEN claimed_at IS NULL THEN available_at ELSE TIMESTAMP '{JOB_NOW}' END AS available_at FROM {JOBS} j
WHERE completed_at IS NULL AND failed_at IS NULL AND available_at <= TIMESTAMP '{JOB_NOW}' AND (claimed_at IS NULL OR claimed_at <= TIMESTAMP '{JOB_NOW}' - INTERVAL 600 SECOND) ORDER BY j.available_at, job_id LIMIT 100""")
def outbox_claim(spark, d):
    return outbox.claimable(jobs(spark, d), JOB_NOW, 600, 100)


@query("outbox_terminal", f"""WITH r AS (SELECT job_id, attempts + (job_id % 5 = 0)::INT AS attempt, available_at + INTERVAL 3 HOUR AS at, CASE WHEN job_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS kind FROM {JOBS} j)
SELECT j.job_id, r.attempt, CASE WHEN j.completed_at IS NOT NULL OR j.failed_at IS NOT NULL THEN 'already_ended' WHEN r.attempt <> j.attempts THEN 'conflict' ELSE r.kind END AS outcome FROM {JOBS} j JOIN r USING (job_id)""")
def outbox_terminal(spark, d):
    j = jobs(spark, d)
    reports = j.selectExpr("job_id", "attempts + cast(job_id % 5 = 0 as int) as attempt", "available_at + interval 3 hours as at", "case when job_id % 2 = 0 then 'completed' else 'failed' end as kind")
    return outbox.terminal_states(j, reports)


@query("outbox_purge", f"""WITH o AS (SELECT completed_at FROM {JOBS} j WHERE completed_at < TIMESTAMP '2024-01-25' ORDER BY 1 LIMIT 51), t AS (SELECT * FROM o ORDER BY 1 LIMIT 50)
SELECT count(*) AS n_purged, min(completed_at) AS oldest, max(completed_at) AS newest, (SELECT count(*) FROM o) > 50 AS reached_limit FROM t""")
def outbox_purge(spark, d):
    return outbox.purge_summary(jobs(spark, d), "completed_at", "2024-01-25", 50)


@query("activity_counters", "SELECT tenant_id, CASE WHEN kind = 'utterance' THEN subject_id END AS subject_id, count(*) AS seq FROM (SELECT DISTINCT ON (id) * FROM observations) GROUP BY ALL")
def activity_counters(spark, d):
    o = lifecycle.one_each(table(spark, d, "observations"))
    return outbox.activity(o.select("tenant_id", F.when(F.col("kind") == "utterance", F.col("subject_id")).alias("subject_id")))


@query("ingest_once", "SELECT tenant_id, record_key, min(recorded_at) AS first_at, count(DISTINCT id) AS deliveries FROM (SELECT *, coalesce(external_id, id) AS record_key FROM observations) GROUP BY 1, 2")
def ingest_once(spark, d):
    o = table(spark, d, "observations").withColumn("record_key", F.coalesce("external_id", "id"))
    return o.groupBy("tenant_id", "record_key").agg(F.min("recorded_at").alias("first_at"), F.count_distinct("id").alias("deliveries"))


def _said(k: str) -> str:
    return f"CASE WHEN json_type(payload,'$.{k}') = 'VARCHAR' THEN nullif(json_extract_string(payload,'$.{k}'), '') END"


_OTW = f"""CASE WHEN json_type(payload,'$.extractTitle') = 'BOOLEAN' AND json_extract_string(payload,'$.extractTitle') = 'true' AND trim({_said('title')}) <> '' THEN concat_ws(chr(10) || chr(10), {_said('title')}, {_said('content')})
 WHEN json_type(payload,'$.extractData') = 'BOOLEAN' AND json_extract_string(payload,'$.extractData') = 'true' AND {_said('name')} IS NOT NULL AND json_type(payload,'$.data') = 'OBJECT' AND json_extract(payload,'$.data')::VARCHAR <> '{{}}'
  THEN concat_ws(chr(10) || chr(10), {_said('name')}, json_extract(payload,'$.data')::VARCHAR)
 ELSE coalesce({_said('text')}, {_said('content')}, {_said('name')}, payload, 'null') END"""


@query("observation_text", f"SELECT id, {_OTW} AS said FROM (SELECT DISTINCT ON (id) * FROM observations)")
def observation_text(spark, d):
    return lifecycle.one_each(table(spark, d, "observations")).select("id", text.observation_text(F.col("payload")).alias("said"))


@query("heuristic_tokens", "SELECT doc_id, ((length(text) - o) * 18 + o * 5 + 19) // 20 AS n FROM (SELECT doc_id, text, length(regexp_replace(text, '[" + text.CJK + "]', '', 'g')) AS o FROM documents)")
def heuristic_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.heuristic_tokens(F.col("text")).alias("n"))


@query("token_counts", f"SELECT id, len({_TOK})::INT AS n_tokens FROM {MEM} m")
def token_counts(spark, d):
    return lifecycle.one_each(mem(spark, d)).select("id", F.size(text.tokens(F.col("content"))).alias("n_tokens"))


_WORDS = "list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(substr(content, 1, 600), '[^\\x00-\\x7f]+', ' ', 'g')), '\\s+'), lambda w: w <> ''), lambda w: substr(w, 1, 64))"


@query("query_words", f"SELECT id, list_filter(a, lambda w, i: list_position(a, w) = i)[1:32] AS w FROM (SELECT id, {_WORDS} AS a FROM {MEM} m)")
def query_words(spark, d):
    return lifecycle.one_each(mem(spark, d)).select("id", text.capped_words(F.col("content")).alias("w"))


@query("content_hashes", f"SELECT id, sha256(content) AS h, coalesce(lower(content_hash) = sha256(content), false) AS same FROM {MEM} m")
def content_hashes(spark, d):
    h = F.sha2("content", 256)
    return lifecycle.one_each(mem(spark, d)).select("id", h.alias("h"), F.coalesce(F.lower("content_hash") == h, F.lit(False)).alias("same"))


_CJK_SQL = "[\\p{Han}\\p{Hiragana}\\p{Katakana}]"
_N = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_CODE_SQL = "[`{}<>|\\\\]|&&|=>|(?:^|\\s)--[a-z]|(?:^|\\s)\\.{0,2}/[A-Za-z0-9_.-]+"
_LOWER_SQL = "^[a-z]+(?:''[a-z]+)?[.,!?;:]?$"


@query("language_mismatch", f"""WITH o AS (SELECT id AS source, {_OTW} AS said FROM (SELECT DISTINCT ON (id) * FROM observations)), j AS (SELECT m.id, source, said, content, regexp_replace(content, 'https?://\\S+', ' ', 'gi') AS prose FROM {MEM} m JOIN o ON o.source = lower(m.source_observation_id))
SELECT id, source FROM j WHERE {_N('said', _CJK_SQL)} >= 4 AND {_N('said', _CJK_SQL)} * 10 >= ({_N('said', _CJK_SQL)} + {_N('said', '\\p{Latin}')}) * 3 AND NOT regexp_matches(content, '{_CJK_SQL}') AND NOT regexp_matches(content, '{_CODE_SQL}')
 AND {_N('prose', '\\p{Latin}')} >= 20 AND {_N('prose', '\\p{Latin}')} * 10 >= {_N('prose', '\\p{L}')} * 9 AND len(list_filter(regexp_split_to_array(prose, '\\s+'), lambda w: regexp_matches(w, '{_LOWER_SQL}'))) >= 3""")
def language_mismatch(spark, d):
    o = lifecycle.one_each(table(spark, d, "observations")).select(F.col("id").alias("source"), text.observation_text(F.col("payload")).alias("said"))
    m = lifecycle.one_each(mem(spark, d)).select("id", "content", F.lower("source_observation_id").alias("source"))
    return m.join(o, "source").where(text.language_mismatch(F.col("said"), F.col("content"))).select("id", "source")


@query("space_names", "SELECT DISTINCT model, regexp_replace(lower('provider_' || model || '_64'), '[^a-z0-9]+', '_', 'g') AS name FROM memory_vectors")
def space_names(spark, d):
    return table(spark, d, "memory_vectors").select("model").distinct().select("model", text.space_name(F.lit("provider"), F.col("model"), F.lit(64)).alias("name"))


@query("deterministic_embedding")
def deterministic_embedding(spark, d):
    return lifecycle.one_each(mem(spark, d)).select("id", vectors.deterministic_embedding(F.col("content")).alias("v"))


RANKS = "(SELECT vec_id AS probe_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 23 + 1 END AS rank, label < 3 AS control FROM embeddings)"


@query("retrieval_quality", f"""SELECT count(*) AS n_probes, avg(coalesce(1.0::DOUBLE/rank, 0)) AS mrr, avg(coalesce(1.0::DOUBLE/rank, 0)) FILTER (control) AS mrr_control, avg(coalesce(1.0::DOUBLE/rank, 0)) FILTER (NOT control) AS mrr_other,
 count(*) FILTER (rank = 1) AS hit1, count(*) FILTER (rank <= 10) AS hit10 FROM {RANKS} r""")
def retrieval_quality(spark, d):
    e = table(spark, d, "embeddings")
    return evaluation.retrieval_quality(e.select(F.col("vec_id").alias("probe_id"), F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 23 + 1).alias("rank"), (F.col("label") < 3).alias("control")))


@query("detection_quality", f"""WITH r AS (SELECT provenance_kind AS category, status = 'contested' AS gold, contested_with_id IS NOT NULL AS found FROM {MEM} m),
c AS (SELECT category, count(*) FILTER (gold AND found) AS tp, count(*) FILTER (NOT gold AND found) AS fp, count(*) FILTER (gold AND NOT found) AS fn, count(*) FILTER (NOT gold AND NOT found) AS tn FROM r GROUP BY 1)
SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""")
def detection_quality(spark, d):
    rows = lifecycle.one_each(mem(spark, d)).select(F.col("provenance_kind").alias("category"), (F.col("status") == "contested").alias("gold"), F.col("contested_with_id").isNotNull().alias("found"))
    return evaluation.detection_quality(rows, "category")


@query("term_spread", " UNION ALL ".join(f"SELECT '{t}' AS term, count({t}) AS n, min({t})::DOUBLE AS least, max({t})::DOUBLE AS most, max({t})::DOUBLE - min({t})::DOUBLE AS spread, count(DISTINCT {t}) AS n_distinct FROM {MEM} m" for t in ("strength", "half_life_hours", "half_life_recalls")))
def term_spread(spark, d):
    return evaluation.term_spread(lifecycle.one_each(mem(spark, d)), ["strength", "half_life_hours", "half_life_recalls"])


@query("tie_runs", f"""WITH r AS (SELECT tenant_id, status AS coverage, strength AS rank, count(*) AS n FROM {MEM} m GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY tenant_id ORDER BY coverage DESC, rank DESC) AS upto FROM r)
SELECT tenant_id, coverage, rank, n, upto > 40 AND upto - n < 40 AS splits FROM u""")
def tie_runs(spark, d):
    return evaluation.tie_runs(lifecycle.one_each(mem(spark, d)).select("tenant_id", F.col("status").alias("coverage"), F.col("strength").alias("rank")), "tenant_id", 40)


@query("margin_statistics", f"SELECT count(x) AS n, avg(x) AS mean, stddev_samp(x) AS deviation, min(x) AS least, max(x) AS most FROM (SELECT strength::DOUBLE - 0.5 AS x FROM {MEM} m)")
def margin_statistics(spark, d):
    return evaluation.margin_statistics(lifecycle.one_each(mem(spark, d)), F.col("strength").cast("double") - 0.5)


@query("red_windows", "WITH r AS (SELECT event_id - (SELECT min(event_id) FROM events) AS position, event_type = 'error' AS red FROM events), w AS (SELECT position // 5 AS w, count(*) AS n, count(*) FILTER (red) AS reds FROM r GROUP BY 1) SELECT count(*) AS n_windows, count(*) FILTER (reds >= 2) AS n_red FROM w WHERE n = 5")
def red_windows(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_id").alias("m"))
    return evaluation.red_windows(e.join(F.broadcast(first)).select((F.col("event_id") - F.col("m")).alias("position"), (F.col("event_type") == "error").alias("red")), 5, 2)


_E = lambda seed, *key: "(('0x' || substr(md5(" + " || '|' || ".join([str(seed), *key]) + "), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1)"


@query("noisy_ranks", f"SELECT label AS probe_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY (vec_id % 97 / 97.0::DOUBLE) * (1 + 0.05::DOUBLE * {_E(7, 'label', 'vec_id')}) DESC, vec_id) AS place FROM embeddings")
def noisy_ranks(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("probe_id"), F.col("vec_id").alias("id"), (F.col("vec_id") % 97 / 97.0).alias("score"))
    return evaluation.noisy_ranks(e, 0.05, 7)


@query("list_difference", """WITH a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, vec_id AS id FROM embeddings), b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, vec_id AS id FROM embeddings WHERE vec_id % 11 <> 3),
j AS (SELECT position, a.id IS DISTINCT FROM b.id AS differs FROM a FULL JOIN b USING (position))
SELECT count(*) FILTER (differs) AS n_different, coalesce(min(position) FILTER (differs), count(*)) AS prefix, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS only_b FROM j""")
def list_difference(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return evaluation.list_difference(graph.numbered(e), graph.numbered(e.where("id % 11 <> 3")))


round_both(Q, S, {"lexical_search": ["coverage"], "retrieval_quality": ["mrr", "mrr_control", "mrr_other"], "detection_quality": ["precision", "recall", "f1"], "margin_statistics": ["mean", "deviation", "least", "most"]})
QUERIES, ORACLES = Q, S
