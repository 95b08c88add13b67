"""Daily counts by event time, corrected as late records arrive (problem 5); SQL only.

The cells of a triangle, event day by arrival day, are counted, and each event day's cells are summed cumulatively over the
arrival days: one row for every revision of the day's count. Records that arrive after the cut-off are filtered before.

The table reduces to its cells before the shuffle; a window has one tenant's day with at most as many cells as arrival days,
so the size of a tenant doesn't matter. Copies (same id, or same tenant and external id) are reduced by an aggregate that
combines before the shuffle, so a much repeated id doesn't matter either.

Defined results: recorded_at null never counts; occurred_at null takes recorded_at; external_id null means the record is
its own; of copies the first recorded counts, of equal moments the smallest id; tenant_id null is a tenant of its own;
an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

CUT_OFF_HOURS = 72

REVISIONS_SQL = """
WITH arrivals AS (
  SELECT tenant_id, external_id IS NULL AS own, coalesce(external_id, id) AS record_key,
         min(struct(recorded_at, id, occurred_at)) AS first
  FROM {observations}
  WHERE recorded_at IS NOT NULL
  GROUP BY tenant_id, external_id IS NULL, coalesce(external_id, id)
), dated AS (
  SELECT tenant_id, first.recorded_at AS recorded_at,
         date_trunc('DAY', coalesce(first.occurred_at, first.recorded_at)) AS period
  FROM arrivals
), cells AS (
  SELECT tenant_id, to_date(period) AS period_day, to_date(recorded_at) AS as_of_day, count(*) AS n
  FROM dated
  WHERE recorded_at < period + INTERVAL '1' DAY + INTERVAL '{cut_off}' HOUR
  GROUP BY tenant_id, to_date(period), to_date(recorded_at)
)
SELECT tenant_id, date_format(period_day, 'yyyy-MM-dd') AS period_day, date_format(as_of_day, 'yyyy-MM-dd') AS as_of_day,
       sum(n) OVER (PARTITION BY tenant_id, period_day ORDER BY as_of_day ROWS UNBOUNDED PRECEDING) AS n_obs
FROM cells
"""


def daily_revisions(observations: DataFrame, cut_off_hours: int = CUT_OFF_HOURS) -> DataFrame:
    """Rows ``(tenant_id, period_day, as_of_day, n_obs)``: every revision of every tenant's daily count."""
    return observations.sparkSession.sql(REVISIONS_SQL.replace("{cut_off}", str(int(cut_off_hours))), observations=observations)
