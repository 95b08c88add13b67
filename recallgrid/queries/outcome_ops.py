"""Queries of cleaning functions, classifications, verdicts and lifecycle requests, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import cleaning
from recallgrid.operators import evaluation, lifecycle, outcomes
from recallgrid.queries import round_both
from recallgrid.queries.memory_ops import LABELS, MEM, TENANT, sql_list
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
    return lifecycle.one_each(table(spark, d, "memories"))


@query("content_keys", f"SELECT id, regexp_replace(nfc_normalize(content), '^[\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+|[\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+$', '', 'g') AS k FROM {MEM} m")
def content_keys(spark, d):
    return mem(spark, d).select("id", cleaning.content_key(F.col("content")).alias("k"))


@query("cut_digests")
def cut_digests(spark, d):
    return mem(spark, d).select("id", cleaning.cut_col(F.col("digest"), 24).alias("cut"))


@query("stored_values", f"""SELECT id, half_life_recalls IS NOT NULL AND half_life_recalls::FLOAT <> 0 AND isfinite(half_life_recalls::FLOAT) AS fits, CASE WHEN valid_from IS NOT NULL THEN greatest(valid_from, TIMESTAMP '2018-01-15') END AS valid_from,
 list_filter(tags, lambda t: NOT contains(t, chr(0))) AS tags FROM {MEM} m""")
def stored_values(spark, d):
    return mem(spark, d).select("id", cleaning.fits_float(F.col("half_life_recalls")).alias("fits"), cleaning.clamped(F.col("valid_from"), "2018-01-15").alias("valid_from"), cleaning.clean_tags(F.col("tags")).alias("tags"))


_FAIL = "CASE WHEN n % 3 = 0 THEN 'boom' WHEN n % 3 = 1 THEN 'Failed query: select params: 1' || chr(10) || 'params: ' || payload ELSE 'see params: ' || coalesce(payload, '') END"


@query("failure_texts", f"""WITH r AS (SELECT id, payload, ascii(substr(id, 1, 1)) AS n FROM (SELECT DISTINCT ON (id) * FROM observations)), f AS (SELECT id, {_FAIL} AS said FROM r)
SELECT id, CASE WHEN contains(said, chr(10) || 'params: ') THEN substr(said, 1, instr(said, chr(10) || 'params: ') + 8) || '(omitted by recallgrid, ' || (length(said) - instr(said, chr(10) || 'params: ') - 8 + len(list_filter(string_split(said, ''), lambda c: unicode(c) > 65535))) || ' chars)' ELSE said END AS said FROM f""")
def failure_texts(spark, d):
    n = F.ascii("id") % 3
    o = lifecycle.one_each(table(spark, d, "observations"))
    raw = F.when(n == 0, "boom").when(n == 1, F.concat(F.lit("Failed query: select params: 1\nparams: "), "payload")).otherwise(F.concat(F.lit("see params: "), F.coalesce("payload", F.lit(""))))
    once = o.select("id", raw.alias("raw")).select("id", cleaning.failure_text(F.col("raw")).alias("once"))
    return once.select("id", cleaning.failure_text(F.col("once")).alias("said"))


@query("registered_labels", f"""WITH r AS (SELECT tenant_id, t AS label FROM (SELECT tenant_id, unnest(tags) AS t FROM {MEM} m) GROUP BY ALL HAVING count(*) >= 5)
SELECT DISTINCT m.id FROM (SELECT id, tenant_id, unnest(tags) AS label FROM {MEM} x) m JOIN r USING (tenant_id, label) WHERE label IN ('billing','research','archive')""")
def registered_labels(spark, d):
    m = mem(spark, d)
    registry = m.select("tenant_id", F.explode("tags").alias("label")).groupBy("tenant_id", "label").agg(F.count("*").alias("n")).where("n >= 5")
    return outcomes.in_registry(m, registry, LABELS)


_G = "(SELECT vec_id, label, vec_id % 10 < 4 AS returned, vec_id % 5 = 4 AS decayed, vec_id % 3 > 0 AS found, (vec_id % 50) / 100.0::DOUBLE AS score FROM embeddings)"


def _gold(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id", "label", "vec_id % 10 < 4 as returned", "vec_id % 5 = 4 as decayed", "vec_id % 3 > 0 as found", "(vec_id % 50) / 100.0d as score")


@query("gold_outcomes", f"SELECT label, CASE WHEN returned THEN 'returned' WHEN decayed THEN 'decayed' WHEN NOT found THEN 'not_reached' WHEN score < 0.1 THEN 'below_threshold' ELSE 'outranked' END AS outcome, count(*) AS n_rows FROM {_G} g GROUP BY ALL")
def gold_outcomes(spark, d):
    c = F.col
    return outcomes.outcome_counts(_gold(spark, d), outcomes.gold_outcome(c("returned"), c("decayed"), c("found"), c("score")), "label")


_N, _O = "CASE WHEN vec_id % 4 > 0 THEN vec_id % 9 END", "CASE WHEN vec_id % 3 > 0 THEN vec_id % 11 END"


@query("correction_orders", f"SELECT label, CASE WHEN n IS NULL AND o IS NULL THEN 'neither' WHEN o IS NULL THEN 'only_new' WHEN n IS NULL THEN 'only_old' WHEN n < o THEN 'new_first' ELSE 'old_first' END AS outcome, count(*) AS n_rows FROM (SELECT label, {_N} AS n, {_O} AS o FROM embeddings) GROUP BY ALL")
def correction_orders(spark, d):
    return outcomes.outcome_counts(table(spark, d, "embeddings"), outcomes.correction_order(F.expr(_N), F.expr(_O)), "label")


@query("pair_orders", "SELECT label, CASE WHEN abs(a - b) <= 2 THEN 'tie' WHEN a > b THEN 'newer' ELSE 'older' END AS outcome, count(*) AS n_rows FROM (SELECT label, vec_id % 17 AS a, vec_id % 13 AS b FROM embeddings) GROUP BY ALL")
def pair_orders(spark, d):
    return outcomes.outcome_counts(table(spark, d, "embeddings"), outcomes.pair_order(F.col("vec_id") % 17, F.col("vec_id") % 13, 2), "label")


@query("subject_crossing", f"""WITH t AS (SELECT status, claim_key_predicate AS trial, count(*) AS n, count(DISTINCT coalesce(subject_id, chr(0))) AS span FROM {MEM} m GROUP BY ALL)
SELECT status, count(*) AS n_trials, count(*) FILTER (n >= 2) AS n_two, count(*) FILTER (n >= 2 AND span > 1) AS n_mixed, count(*) FILTER (n >= 2 AND span > 1)::DOUBLE / nullif(count(*) FILTER (n >= 2), 0) AS mixed_share, avg(n) AS mean_eligible, max(span) AS widest FROM t GROUP BY 1""")
def subject_crossing(spark, d):
    return outcomes.crossing(mem(spark, d).select("status", F.col("claim_key_predicate").alias("trial"), F.col("subject_id").alias("subject")), "status")


_R = "(SELECT vec_id // 2 AS probe, CASE WHEN vec_id % 2 = 0 THEN 'gold' ELSE 'distractor' END AS role, (vec_id * 7919 % 1000) / 1000.0::DOUBLE AS similarity FROM embeddings WHERE vec_id % 31 <> 5)"


def _roles(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 31 <> 5").selectExpr("vec_id div 2 as probe", "if(vec_id % 2 = 0, 'gold', 'distractor') as role", "(vec_id * 7919 % 1000) / 1000.0d as similarity")


_M = f"(SELECT probe, max(similarity) FILTER (role = 'gold') - max(similarity) FILTER (role = 'distractor') AS margin FROM {_R} r GROUP BY 1)"


@query("margins", f"SELECT count(margin) AS n, avg(margin) AS mean, stddev_samp(margin) AS deviation, min(margin) AS least, max(margin) AS most FROM {_M} m")
def margins(spark, d):
    return evaluation.margin_statistics(outcomes.margins(_roles(spark, d)), F.col("margin"))


_CAND = "(SELECT vec_id // 10 AS probe, CASE WHEN vec_id % 7 <> 0 THEN vec_id END AS id, vec_id % 10 < 3 AS protected, (vec_id * 31 % 97) / 97.0::DOUBLE AS score FROM embeddings)"


@query("protection_margins", f"SELECT probe, min(score) FILTER (id IS NOT NULL AND protected) AS least_protected, max(score) FILTER (id IS NULL OR NOT protected) AS most_other, min(score) FILTER (id IS NOT NULL AND protected) - max(score) FILTER (id IS NULL OR NOT protected) AS protection_margin FROM {_CAND} c GROUP BY 1")
def protection_margins(spark, d):
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select(F.floor(v / 10).cast("bigint").alias("probe"), F.when(v % 7 != 0, v).alias("id"), (v % 10 < 3).alias("protected"), ((v * 31 % 97) / 97.0).alias("score"))
    return outcomes.protection(e)


@query("margin_drops", f"WITH b AS (SELECT * FROM {_M} x), m AS (SELECT probe, CASE WHEN probe % 9 = 0 THEN margin - 1 ELSE margin END AS margin FROM b), s AS (SELECT stddev_samp(margin) AS deviation FROM b) SELECT count(*) FILTER (b.margin - m.margin >= 1.5 * deviation) AS n_drops, count(*) FILTER (b.margin - m.margin >= 1.5 * deviation) >= 3 AS red FROM m JOIN b USING (probe), s")
def margin_drops(spark, d):
    base = outcomes.margins(_roles(spark, d))
    measured = base.select("probe", F.when(F.col("probe") % 9 == 0, F.col("margin") - 1).otherwise(F.col("margin")).alias("margin"))
    return outcomes.drop_verdict(measured, base, 1.5, 3)


@query("drift_verdicts", "WITH b AS (SELECT label AS group_key, count(*) FILTER (vec_id % 3 = 0) AS hit1, avg(1.0::DOUBLE / (vec_id % 5 + 1)) AS mrr FROM embeddings WHERE label < 8 GROUP BY 1), m AS (SELECT label AS group_key, count(*) FILTER (vec_id % 3 = 1) AS hit1, avg(1.0::DOUBLE / (vec_id % 6 + 1)) AS mrr FROM embeddings GROUP BY 1) SELECT m.group_key, coalesce(m.hit1 < b.hit1 OR b.mrr - m.mrr >= 0.05, false) AS red FROM m LEFT JOIN b USING (group_key)")
def drift_verdicts(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("label", "group_key")
    of = lambda x, r, k: x.groupBy("group_key").agg(F.count_if(F.col("vec_id") % 3 == r).alias("hit1"), F.avg(1.0 / (F.col("vec_id") % k + 1)).alias("mrr"))
    return outcomes.drift_verdict(of(e, 1, 6), of(e.where("group_key < 8"), 0, 5), 0.05)


@query("equal_terms", f"SELECT count(*) FILTER (half_life_hours = half_life_recalls) AS n_equal, count(*) AS n_rows FROM {MEM} m")
def equal_terms(spark, d):
    return outcomes.equal_terms(mem(spark, d), "half_life_hours", "half_life_recalls")


@query("footprints", f"SELECT tenant_id, count(*) AS n, sum(length(digest))::BIGINT AS chars, sum(ceil(length(digest) / 4.0))::BIGINT AS tokens, count(*) * 15.458::DOUBLE + 170.881::DOUBLE AS estimate, count(*) >= 50 AS saturated FROM {MEM} m GROUP BY 1")
def footprints(spark, d):
    return outcomes.footprint(mem(spark, d), "tenant_id")


@query("answers_preserved", f"SELECT id, content LIKE '%open items%' OR content LIKE '%user%' AS kept, CASE WHEN (content LIKE '%open items%' OR content LIKE '%user%') = (status = 'active') THEN (status = 'active')::VARCHAR ELSE 'indeterminate' END AS verdict FROM {MEM} m")
def answers_preserved(spark, d):
    kept = outcomes.preserved(F.col("content"), F.array(F.lit("open items"), F.lit("user")))
    return mem(spark, d).select("id", kept.alias("kept"), outcomes.reconciled(kept.cast("string"), (F.col("status") == "active").cast("string")).alias("verdict"))


_OPS = list(outcomes.REQUESTS)
_REQ = f"(SELECT id, {sql_list(_OPS)}[1 + (ascii(substr(id, 1, 1)) % 6)] AS operation FROM memories UNION SELECT 'none', 'forget')"
_APPLIES = " OR ".join(f"(operation = '{op}' AND status IN ({', '.join(repr(x) for x in b)}))" for op, (b, _) in outcomes.REQUESTS.items())
_TARGET = "CASE operation " + " ".join(f"WHEN '{op}' THEN '{a}'" for op, (_, a) in outcomes.REQUESTS.items()) + " END"


@query("lifecycle_requests", f"""WITH j AS (SELECT r.id, r.operation, m.status, {_TARGET} AS target FROM {_REQ} r LEFT JOIN {MEM} m ON m.id = r.id)
SELECT id, operation, CASE WHEN status IS NULL THEN 'not_found' WHEN {_APPLIES} THEN 'done' WHEN status = target THEN 'already' ELSE 'refused' END AS outcome, CASE WHEN {_APPLIES} THEN target ELSE status END AS status FROM j""")
def lifecycle_requests(spark, d):
    m = table(spark, d, "memories")
    op = F.element_at(F.array(*[F.lit(x) for x in _OPS]), (F.ascii("id") % 6 + 1).cast("int"))
    asked = m.select(F.upper("id").alias("id"), op.alias("operation")).unionByName(spark.createDataFrame([("none", "forget")], "id string, operation string"))
    return outcomes.requested(m, asked)


_NEW = f"(SELECT source_observation_id, content_hash FROM {MEM} m WHERE source_observation_id IS NOT NULL AND ascii(substr(id, 2, 1)) % 2 = 0)"


@query("reextracted", f"SELECT o.id, CASE WHEN status <> 'active' THEN 'skip' WHEN EXISTS (SELECT 1 FROM {_NEW} n WHERE n.source_observation_id = o.source_observation_id AND n.content_hash = o.content_hash) THEN 'unchanged' ELSE 'supersede' END AS decision FROM {MEM} o WHERE source_observation_id IN (SELECT source_observation_id FROM {_NEW} n)")
def reextracted(spark, d):
    m = mem(spark, d)
    return outcomes.reextracted(m, m.where("source_observation_id is not null and ascii(substr(id, 2, 1)) % 2 = 0").select("source_observation_id", "content_hash"))


@query("tenant_erasure", " UNION ALL ".join(f"SELECT '{t}' AS table_name, least(count(*), 300)::BIGINT AS n_rows, count(*) > 300 AS more FROM {t} WHERE tenant_id = '{TENANT}'" for t in ("memories", "memory_vectors", "memory_events", "observations")))
def tenant_erasure(spark, d):
    return outcomes.erasure({t: table(spark, d, t).select("tenant_id") for t in ("memories", "memory_vectors", "memory_events", "observations")}, TENANT, 300)


@query("expired_recalls", "WITH r AS (SELECT event_id AS recall_id, ts AS at FROM events WHERE event_type = 'view'), u AS (SELECT event_id // 10 AS recall_id FROM events WHERE event_type = 'click') SELECT r.recall_id, count(u.recall_id) AS n_uses FROM r LEFT JOIN u USING (recall_id) WHERE r.at < TIMESTAMP '2024-01-15' GROUP BY 1")
def expired_recalls(spark, d):
    e = table(spark, d, "events")
    return outcomes.expired_with_uses(e.where("event_type = 'view'").select(F.col("event_id").alias("recall_id"), F.col("ts").alias("at")), e.where("event_type = 'click'").selectExpr("event_id div 10 as recall_id"), "2024-01-15")


round_both(Q, S, {"subject_crossing": ["mixed_share", "mean_eligible"], "margins": ["mean", "deviation", "least", "most"], "footprints": ["estimate"]})
QUERIES, ORACLES = Q, S
