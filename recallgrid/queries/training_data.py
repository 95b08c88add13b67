"""Queries of the general training-data problems 1 and 5, with DuckDB SQL."""

from __future__ import annotations

from recallgrid.operators.intervals import claim_periods
from recallgrid.operators.late_events import daily_revisions
from recallgrid.sources.tables import table


def p1_found(spark, d):
    return claim_periods(table(spark, d, "memories"))


def p5_found(spark, d):
    return daily_revisions(table(spark, d, "observations"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found}

#: Compatibility forms of ASCII (NFKC has no DuckDB function); the tables' keys use only these.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "\u3000\u00a0"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "  "


def _key(col: str) -> str:
    return f"nullif(regexp_replace(lower(trim(translate({col}, '{_WIDE}', '{_ASCII}'), E' \\t\\n\\r')), '\\s+', '_', 'g'), '')"


ORACLES = {
    "p1_found": f"""
WITH k AS (
  SELECT tenant_id, subject_id, {_key("claim_key_subject")} AS claim_subject, {_key("claim_key_predicate")} AS claim_predicate,
         coalesce(epoch_us(valid_from), -9000000000000000000) AS a, coalesce(epoch_us(valid_until), 9000000000000000000) AS b
  FROM memories
), v AS (
  SELECT DISTINCT * FROM k WHERE tenant_id IS NOT NULL AND subject_id IS NOT NULL AND claim_subject IS NOT NULL AND claim_predicate IS NOT NULL AND a < b
), m AS (
  SELECT *, max(b) OVER (PARTITION BY tenant_id, subject_id, claim_subject, claim_predicate ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v
), i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, subject_id, claim_subject, claim_predicate ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m
), p AS (
  SELECT tenant_id, subject_id, claim_subject, claim_predicate, min(a) AS a, max(b) AS b FROM i GROUP BY ALL, island
), g AS (
  SELECT tenant_id, subject_id, claim_subject, claim_predicate, b AS a, lead(a) OVER (PARTITION BY tenant_id, subject_id, claim_subject, claim_predicate ORDER BY a) AS b FROM p
)
SELECT tenant_id, subject_id, claim_subject, claim_predicate, span_kind,
       CASE WHEN a = -9000000000000000000 THEN -1 ELSE a END AS from_us, CASE WHEN b = 9000000000000000000 THEN -1 ELSE b END AS until_us
FROM (SELECT *, 'period' AS span_kind FROM p UNION ALL SELECT *, 'gap' AS span_kind FROM g WHERE b IS NOT NULL)
""".replace("GROUP BY ALL, island", "GROUP BY tenant_id, subject_id, claim_subject, claim_predicate, island"),
    "p5_found": """
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, external_id IS NULL, coalesce(external_id, id) ORDER BY recorded_at, id) AS rn FROM observations WHERE recorded_at IS NOT NULL
), d AS (
  SELECT tenant_id, date_trunc('day', coalesce(occurred_at, recorded_at))::TIMESTAMP AS period, recorded_at FROM o WHERE rn = 1
), f AS (
  SELECT tenant_id, period, date_trunc('day', recorded_at)::TIMESTAMP AS arrived FROM d WHERE recorded_at < period + INTERVAL 96 HOUR
), r AS (SELECT DISTINCT tenant_id, period, arrived FROM f)
SELECT r.tenant_id, strftime(r.period, '%Y-%m-%d') AS period_day, strftime(r.arrived, '%Y-%m-%d') AS as_of_day, count(*) AS n_obs
FROM r JOIN f ON f.tenant_id IS NOT DISTINCT FROM r.tenant_id AND f.period = r.period AND f.arrived <= r.arrived
GROUP BY r.tenant_id, r.period, r.arrived
""",
}
