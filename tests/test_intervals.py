"""Problem 1 against brute force, with nulls, clashing names, repeated rows and an empty table."""

import random
from datetime import datetime, timedelta

from recallgrid.operators.intervals import claim_periods, periods_and_gaps

BASE = datetime(2018, 1, 1)


def brute(rows):
    out, by = [], {}
    for k, a, b in rows:
        if k is None:
            continue
        a, b = (-(10**18) if a is None else a), (10**18 if b is None else b)
        if a < b:
            by.setdefault(k, []).append((a, b))
    side = lambda x: -1 if abs(x) == 10**18 else x
    for k, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(k, "period", side(a), side(b)) for a, b in merged]
        out += [(k, "gap", merged[i][1], merged[i + 1][0]) for i in range(len(merged) - 1)]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        a = r.choice([None] + [r.randrange(-5, 40) * 1_800_000_000 for _ in range(6)])
        b = r.choice([None] + [r.randrange(-5, 40) * 1_800_000_000 for _ in range(9)])
        rows.append((r.choice(["a", "b", "c", "d", "e", None]), a, b))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint").selectExpr("*", "a as _t", "'x' as _h")
    got = sorted(tuple(x) for x in periods_and_gaps(df, ["k"], "a", "b").collect())
    assert got == brute(rows)


def test_claims(spark):
    d = lambda n: BASE + timedelta(days=n)
    schema = "tenant_id string, subject_id string, claim_key_subject string, claim_key_predicate string, valid_from timestamp_ntz, valid_until timestamp_ntz, span_kind string"
    rows = [
        ("t", "s", "User", "Home  City", d(0), d(2), "x"),
        ("t", "s", " user", "home_city　", d(2), d(3), None),  # touches, other writing
        ("t", "s", "ｕｓｅｒ", "HOME CITY", d(5), None, None),
        ("t", "s", "user", "home city", d(4), d(4), None),  # empty
        ("t", "s", "user", "home city", d(9), d(1), None),  # inverted
        ("t", None, "user", "home city", d(0), d(1), None),
        ("t", "s", "  ", "home city", d(0), d(1), None),
        ("t", "s", "user", None, d(0), d(1), None),
    ]
    got = sorted(tuple(x) for x in claim_periods(spark.createDataFrame(rows, schema)).collect())
    us = lambda n: int((d(n) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    key = ("t", "s", "user", "home_city")
    assert got == [(*key, "gap", us(3), us(5)), (*key, "period", us(0), us(3)), (*key, "period", us(5), -1)]
    assert claim_periods(spark.createDataFrame([], schema)).count() == 0
