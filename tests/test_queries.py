"""Every query that has SQL gives the rows of its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as e
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query(spark, con, name):
    assert ": equal," in compare(spark, con, FOLDER, name, e.queries()[name], e.oracle_sql()[name])


def test_cleaning(spark):
    from pyspark.sql import functions as F

    from recallgrid.functions import cleaning

    assert cleaning.cut("ab👩‍👩‍👧c", 4) == "ab" and cleaning.cut("e\u0301" * 3, 3) == "e\u0301" and cleaning.cut(None, 3) is None
    made = {"plain": ("boom params: 1,2,3", "boom params: 1,2,3"), "values": ("q\nparams: 1,😀\nparams: 2", "q\nparams: (omitted by recallgrid, 14 chars)"), "null": (None, None)}
    one = spark.createDataFrame([(k, t, ["a\0", "b", "b"]) for k, (t, _) in made.items()], "k string, t string, tags array<string>")
    rows = one.select("k", cleaning.failure_text(F.col("t")).alias("f"), cleaning.failure_text(cleaning.failure_text(F.col("t"))).alias("g"), cleaning.clean_tags(F.col("tags")).alias("c")).collect()
    assert {r.k: r.f for r in rows} == {r.k: r.g for r in rows} == {k: want for k, (_, want) in made.items()} and rows[0].c == ["b", "b"]
    long = spark.createDataFrame([("x" * 5000,)], "t string").select(cleaning.failure_text(F.col("t")).alias("f")).first().f
    assert long == "x" * 4096 + "… (truncated by recallgrid, original length 5000 chars)"
    keys = spark.createDataFrame([("\t e\u0301\u3000x\ufeff\n",), ("\x0ba b\x0b ",), ("",), (None,)], "t string").select(cleaning.content_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in keys] == ["é\u3000x", "a b", "", None]
