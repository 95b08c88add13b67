"""Problem 2 against a character-by-character version."""

import unicodedata as U

from recallgrid.llm.copies import copies, copy_counts, split_fields

SCHEMA = "id string, tenant_id string, content string, keep_id string, tuple string"
CONTENTS = [
    "Room 12.5 is free!", "room 12.5 is free", "ROOM 12.5   is\tfree…", "Room 125 is free", "Room 12. 5 is free", "“Room” 12.5 is fr​ee", None, "", "  ", "...", "x" * 50_000,
    "city: Oslo; floor: 3", "floor=3 | city=OSLO", '{"city": "Oslo", "floor": 3}', '{"floor": "3", "city": "oslo!"}', "city: Oslo", "city: Oslo\nfloor: 3\nteam: a", "{not json", "a; b: c", "Straße; ẞ", "STRASSE", "１２．５ x", "é y", "é y",
]


def canon(s):
    out, s = [], s.lower()
    for i, c in enumerate(s):
        k = U.category(c)
        if k[0] == "P":
            if 0 < i < len(s) - 1 and U.category(s[i - 1]) == U.category(s[i + 1]) == "Nd":
                out.append(c)
        elif k[0] != "Z" and k not in ("Cc", "Cf"):
            out.append(c)
    return "".join(out)


def test_against_brute_force(spark):
    rows = [(f"m{i:02}{t}", t, c, "k", "u") for t in "ab" for i, c in enumerate(CONTENTS)] + [("n1", None, "x", "", ""), (None, "a", "x", "", "")]
    rows += rows[:9]
    groups = {}
    for i, t, c, *_ in rows:
        if i and t and c is not None:
            f = split_fields(c)
            groups.setdefault((t, f is None, canon(c) if f is None else frozenset((canon(a), canon(b)) for a, b in f)), set()).add(i)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(x) for x in copies(df).collect())
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert {(r.keep_id, r.n_copies) for r in copy_counts(df).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fields():
    assert split_fields("a: 1; b=2") == [("a", "1"), ("b", "2")] and split_fields("a: 1") is None and split_fields("a: 1; no field") is None
    assert split_fields("x" * 25 + ": 1; b: 2") is None and split_fields('{"a": [1, 2]}') == [("a", "[1, 2]")]
