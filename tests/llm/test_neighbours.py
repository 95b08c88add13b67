"""Problem 3: recall against brute force, crowded and equal vectors, unusable rows."""

from datetime import datetime

import numpy as np

import recallgrid.llm.neighbours as module
from recallgrid.llm.neighbours import DIMENSIONS, Codes, Index, Queries, most_bits, mutual, neighbours, packed, rotation, twentieth, usable

T0, T1 = datetime(2018, 1, 1), datetime(2018, 1, 2)
SCHEMA = "memory_id string, embedding array<float>, model string, created_at timestamp_ntz, vec string, block int"


def test_estimates_bound_the_inner_products():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, DIMENSIONS)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, turn = x[:50].mean(0), rotation(DIMENSIONS)
    codes, queries = Codes(x, c, turn), Queries(x[:30], turn)
    assert codes.code.dtype == np.uint64 and codes.code.shape == (400,)
    i, j = (a.ravel() for a in np.indices((30, 400)))
    upper = queries.upper_bounds(i, codes, j, (x[:30] @ c)[i])
    assert (upper >= (x[:30] @ x.T).ravel() - 1e-5).mean() > 0.98
    estimate = upper - codes.error[j]
    other = i != j
    assert np.corrcoef(estimate[other], (x[:30] @ x.T).ravel()[other])[0, 1] > 0.75


def test_bits_that_differ_tell_the_angle():
    r = np.random.default_rng(3)
    a = r.standard_normal((4000, DIMENSIONS))
    b = a + r.uniform(0, 2, (4000, 1)) * r.standard_normal((4000, DIMENSIONS))
    cos = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    turn = rotation(DIMENSIONS)
    differ = np.bitwise_count(packed(a @ turn > 0) ^ packed(b @ turn > 0))
    assert (differ <= most_bits()[((cos + 1) * 500).astype(int)]).mean() > 0.99


def test_recall_with_many_fine_cells_parts_and_slices(spark, monkeypatch):
    """As many cells as a collection many times as large has, and tasks smaller than the blocks; a third of the vectors in one topic."""
    monkeypatch.setattr(module, "PART_ROWS", 700)
    monkeypatch.setattr(module, "SLICE_ROWS", 1500)
    monkeypatch.setattr(module, "SAMPLE", 2000)
    r = np.random.default_rng(4)
    topics = r.standard_normal((60, DIMENSIONS))
    of = np.where(np.arange(9000) % 3 == 0, 0, r.integers(0, 60, 9000))
    x = topics[of] + r.uniform(0.1, 0.5, (9000, 1)) * r.standard_normal((9000, DIMENSIONS))
    x[1::7] = x[r.integers(0, 9000, len(x[1::7]))] + 0.08 * r.standard_normal((len(x[1::7]), DIMENSIONS))
    df = spark.createDataFrame([(f"m{i:04}", [float(v) for v in x[i]], "m", T1, "", 0) for i in range(9000)], SCHEMA)
    index, base = Index(df, "m", cell_rows=12, block_rows=1000), usable(df, "m")
    assert len(index.cells.fine) > 1 and index.block_of.max() >= 6
    parts, slices = index.layout(12, 700, 1500, 1.0)
    assert parts.max() > 1 and slices.max() > 1
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = -np.sort(-s, axis=1)[:, 4]
    near = [(int(g.a[1:]), int(g.b[1:])) for g in neighbours(index, base, None, 5, 12, 0.9).collect()]
    assert len(set(near)) == len(near)
    want = sum(int((row[np.argsort(-row)[:5]] >= 0.9).sum()) for row in s)
    assert want > 2000 and sum(s[a, b] >= kth[a] - 2e-4 for a, b in near) >= 0.97 * want
    asked = base.where(twentieth(base["id"]))
    probes = index.probes_for(5, 0.93)
    assert 8 <= probes <= len(index.cells.coarse)
    got = [(int(g.a[1:]), int(g.b[1:])) for g in neighbours(index, base, asked, 5, probes, asked=0.05).collect()]
    assert sum(s[a, b] >= kth[a] - 2e-4 for a, b in got) >= 0.9 * 5 * asked.count()


def test_every_given_query_is_answered_though_equal_vectors_leave_the_index(spark):
    v = [1.0] + [0.0] * (DIMENSIONS - 1)
    df = spark.createDataFrame([(f"m{i:02}", v, "m", T1, "", 0) for i in range(20)], SCHEMA)
    base = usable(df, "m")
    got = neighbours(Index(df, "m"), base, base, 5, 4).collect()
    assert {g.a for g in got} == {f"m{i:02}" for i in range(20)} and len(got) == 100
    assert {g.b for g in got} == {f"m{i:02}" for i in range(6)}


def test_recall_and_pairs(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, DIMENSIONS))
    x[500:900] = x[0] + 0.02 * r.standard_normal((400, DIMENSIONS))  # crowded
    x[1000:1020] = x[1]  # equal
    x *= r.uniform(0.01, 50, (3000, 1))
    rows = [(f"m{i:04}", [float(v) for v in x[i]], "m", T1, "", 0) for i in range(3000)]
    rows += [("m0000", [9.0] * DIMENSIONS, "m", T0, "", 0), ("zero", [0.0] * DIMENSIONS, "m", T1, "", 0), ("nan", [float("nan")] * DIMENSIONS, "m", T1, "", 0), ("short", [1.0], "m", T1, "", 0), ("empty", [], "m", T1, "", 0), ("null", None, "m", T1, "", 0), ("other", [1.0] * DIMENSIONS, "n", T1, "", 0), (None, [1.0] * DIMENSIONS, "m", T1, "", 0)]
    rows += [("late", [1.0] * DIMENSIONS, "m", T0, "", 0), ("late", [1.0] * DIMENSIONS, "n", T1, "", 0), rows[5]]
    df = spark.createDataFrame(rows, SCHEMA)
    index, base = Index(df, "m"), usable(df, "m")
    assert base.count() == 3000
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = -np.sort(-s, axis=1)[:, 4]
    got = neighbours(index, base, base.where("pmod(crc32(id), 5) = 0"), 5, 4).collect()
    queries = {g.a for g in got}
    good = sum(s[int(g.a[1:]), int(g.b[1:])] >= kth[int(g.a[1:])] - 2e-4 for g in got)
    assert good >= 0.9 * 5 * len(queries) and all(g.a != g.b for g in got)
    pairs = {(p.a, p.b) for p in mutual(neighbours(index, base, None, 5, 4, 0.9)).collect()}
    equal = {1, *range(1000, 1020)}
    assert all(a < b and s[int(a[1:]), int(b[1:])] > 0.899 for a, b in pairs)
    assert {p for p in pairs if int(p[0][1:]) in equal} and all(int(b[1:]) in equal for a, b in pairs if int(a[1:]) in equal)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours(Index(df, "m"), usable(df, "m"), None, 5, 4).count() == 0
