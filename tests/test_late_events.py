"""Problem 5 against brute force, with nulls, copies and an empty table."""

import random
from datetime import datetime, timedelta

from recallgrid.operators.late_events import daily_revisions

SCHEMA = "id string, tenant_id string, external_id string, occurred_at timestamp_ntz, recorded_at timestamp_ntz, n_obs int, first string"


def brute(rows):
    first = {}
    for i, t, x, o, r, *_ in rows:
        if r is not None:
            k = (t, x is None, x or i)
            if k not in first or (r, i) < first[k][:2]:
                first[k] = (r, i, o)
    cells = {}
    for (t, *_), (r, _, o) in first.items():
        p = (o or r).replace(hour=0, minute=0, second=0, microsecond=0)
        if r < p + timedelta(hours=96):
            cells.setdefault((t, p), []).append(r)
    out = []
    for (t, p), rs in cells.items():
        for day in {r.date() for r in rs}:
            out.append((t, p.strftime("%Y-%m-%d"), day.isoformat(), sum(r.date() <= day for r in rs)))
    return sorted(out, key=str)


def test_revisions(spark):
    rnd, base = random.Random(5), datetime(2018, 1, 10)
    rows = []
    for i in range(300):
        r = base + timedelta(hours=rnd.randrange(0, 400))
        o = rnd.choice([None, r - timedelta(hours=rnd.randrange(-30, 200)), datetime(1970, 1, 1)])
        rows.append((f"i{i}", rnd.choice(["a", "b", None]), rnd.choice([None, f"x{rnd.randrange(60)}"]), o, rnd.choice([r, r, r, r, None]), 9, "z"))
    rows += rows[:30]
    got = sorted((tuple(x) for x in daily_revisions(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    assert daily_revisions(spark.createDataFrame([], SCHEMA)).count() == 0
