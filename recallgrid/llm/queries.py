"""Queries of the llm problems; those of problem 2 have SQL, the others are tested against brute force, round trips and held-out accuracy."""

from __future__ import annotations

from recallgrid.llm.bpe import token_ids
from recallgrid.llm.copies import copies, copy_counts
from recallgrid.llm.neighbours import Index, mutual, neighbours, twentieth, usable
from recallgrid.llm.packing import windows
from recallgrid.llm.pii import pii_spans, redacted
from recallgrid.llm.sentences import sentences
from recallgrid.sources.tables import table


def p2_found(spark, d):
    return copies(table(spark, d, "memories"))


def p2_counts(spark, d):
    return copy_counts(table(spark, d, "memories"))


MODEL, NEAREST, SIMILAR = "memo-embed-2", 5, 0.9
#: Cells that a query for similar vectors looks into at most, where a recall of 0.99 needs fewer; recall that is tried on the index's sample for all five neighbours.
PROBES_SIMILAR, RECALL_ALL = 16, 0.93


def p3_found(spark, d):
    vectors = table(spark, d, "memory_vectors")
    near = neighbours(Index(vectors, MODEL), usable(vectors, MODEL), None, NEAREST, PROBES_SIMILAR, SIMILAR)
    return mutual(near).selectExpr("a AS memory_id_a", "b AS memory_id_b")


def p3_neighbours(spark, d):
    """The five nearest of every twentieth memory, against all."""
    vectors = table(spark, d, "memory_vectors")
    base, index = usable(vectors, MODEL), Index(vectors, MODEL)
    near = neighbours(index, base, base.where(twentieth(base["id"])), NEAREST, index.probes_for(NEAREST, RECALL_ALL), asked=0.05)
    return near.selectExpr("a AS memory_id", "b AS neighbour_id", "similarity")


def p4_found(spark, d):
    contents = pii_spans(table(spark, d, "memories"), "id", "content", False, "memories")
    return contents.unionByName(pii_spans(table(spark, d, "observations"), "id", "payload", True, "observations"))


def p4_redacted(spark, d):
    contents = redacted(table(spark, d, "memories"), "id", "content", False, "memories")
    return contents.unionByName(redacted(table(spark, d, "observations"), "id", "payload", True, "observations"))


def p6_ids(spark, d):
    return token_ids(table(spark, d, "documents"))


def p7_windows(spark, d):
    return windows(table(spark, d, "documents"))


def p8_found(spark, d):
    return sentences(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_ids": p6_ids, "p7_windows": p7_windows, "p8_found": p8_found}

def _canonical(x: str) -> str:
    """Lower case without marks: those between two digits are bracketed twice (digits may belong to two), the others go."""
    between = "(\\p{Nd})(\\p{P})(\\p{Nd})', '\\1' || chr(57344) || '\\2' || chr(57345) || '\\3', 'g')"
    twice = f"regexp_replace(regexp_replace(lower({x}), '{between}, '{between}"
    return f"regexp_replace({twice}, '(\\x{{E000}}\\p{{P}}\\x{{E001}})|[\\p{{P}}\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]', '\\1', 'g')"


_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"
_CODED = f"""WITH m AS (SELECT DISTINCT ON (id) id, tenant_id, content, CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' ELSE false END AS is_object FROM memories WHERE id IS NOT NULL AND tenant_id IS NOT NULL AND content IS NOT NULL),
j AS (SELECT o.id, o.tenant_id, e.key AS name, CASE WHEN e.type = 'VARCHAR' THEN e.value ->> '$' ELSE e.value::VARCHAR END AS value FROM (SELECT * FROM m WHERE is_object) o, json_each(o.content) e),
pieces AS (SELECT id, tenant_id, unnest(list_filter(regexp_split_to_array(content, '[;|\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '')) AS piece FROM m WHERE NOT is_object),
f AS (SELECT id, tenant_id, regexp_extract(piece, '^([^:=]*)[:=]', 1) AS name, regexp_extract(piece, '^[^:=]*[:=]((?s:.*))$', 1) AS value FROM pieces),
lists AS (SELECT id FROM f GROUP BY 1 HAVING count(*) >= 2 AND bool_and(regexp_replace(name, '{_BLANK}', '', 'g') <> '' AND regexp_replace(value, '{_BLANK}', '', 'g') <> '' AND length(regexp_replace(name, '^{_BLANK}|{_BLANK}$', '', 'g')) <= 24)),
fields AS (SELECT * FROM j UNION ALL SELECT f.* FROM f JOIN lists USING (id)),
coded AS (SELECT id, tenant_id, true AS listed, list_sort(list_distinct(list({_canonical('name')} || chr(57346) || {_canonical('value')}))) AS code FROM fields GROUP BY ALL
 UNION ALL SELECT id, tenant_id, false, [{_canonical('content')}] FROM m WHERE id NOT IN (SELECT id FROM fields))"""

#: SQL of the queries that it can express, up to letters whose lower case depends on what is beside them.
ORACLES: dict[str, str] = {
    "p2_found": _CODED + " SELECT keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY tenant_id, listed, code) AS keep_id FROM coded) WHERE id <> keep_id",
    "p2_counts": _CODED + " SELECT tenant_id, min(id) AS keep_id, count(*) AS n_copies FROM coded GROUP BY tenant_id, listed, code",
}
