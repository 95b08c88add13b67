"""Streams over a folder of files, run to their end."""

from datetime import datetime

from recallgrid.streaming import jobs

D = "/root/testdata/sf0.001"


def test_streams_agree_with_batch(spark, tmp_path):
    o = spark.read.parquet(f"{D}/observations.parquet")
    o.write.parquet(str(tmp_path / "o"))
    read = lambda: spark.readStream.schema(o.schema).parquet(str(tmp_path / "o"))
    jobs.run_available(jobs.ingest_once(read()), "once", "append", str(tmp_path / "c1"))
    assert spark.table("once").count() == o.selectExpr("tenant_id", "coalesce(external_id, id)").distinct().count()
    jobs.run_available(jobs.activity_counters(read()), "counters", "complete", str(tmp_path / "c2"))
    assert {tuple(r) for r in spark.table("counters").collect()} == {tuple(r) for r in o.groupBy("tenant_id").count().collect()}


def test_uses_and_reports(spark, tmp_path):
    uses = spark.createDataFrame([("a", datetime(2018, 1, 2)), ("a", datetime(2018, 1, 1)), ("b", datetime(2018, 1, 3))], "memory_id string, used_at timestamp_ntz")
    uses.write.parquet(str(tmp_path / "u"))
    jobs.run_available(jobs.last_uses(spark.readStream.schema(uses.schema).parquet(str(tmp_path / "u"))), "uses", "complete", str(tmp_path / "c1"))
    assert {tuple(r) for r in spark.table("uses").collect()} == {("a", datetime(2018, 1, 2)), ("b", datetime(2018, 1, 3))}
    reports = spark.createDataFrame([(1, 1, 5, "failed"), (1, 1, 3, "completed"), (1, 2, 9, "failed")], "job_id int, attempt int, at int, kind string")
    reports.write.parquet(str(tmp_path / "r"))
    jobs.run_available(jobs.first_reports(spark.readStream.schema(reports.schema).parquet(str(tmp_path / "r"))), "reports", "complete", str(tmp_path / "c2"))
    assert {tuple(r) for r in spark.table("reports").collect()} == {(1, 1, 3, "completed"), (1, 2, 9, "failed")}


def test_arrival_cells_arent_thrown_by_a_wrong_clock(spark, tmp_path):
    at = lambda d, h=0: datetime(2018, 1, d, h)
    rows = [("t", "o1", "x", at(1), at(1, 5)), ("t", "o2", "x", at(1), at(1, 6)), ("t", "o3", None, datetime(2099, 1, 1), at(1, 7)), ("t", "o4", None, at(1), at(3)), ("t", "o5", None, at(1), at(5, 1)), ("t", "o6", None, None, at(4)), ("t", "end", None, at(20), at(20))]
    df = spark.createDataFrame(rows, "tenant_id string, id string, external_id string, occurred_at timestamp_ntz, recorded_at timestamp_ntz")
    for i, r in enumerate([df.where("id <> 'end'"), df.where("id = 'end'"), df.where("id = 'end'").withColumn("id", df.recorded_at.cast("string"))]):
        r.coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "o"))
    jobs.run_available(jobs.arrival_cells(stream), "cells", "append", str(tmp_path / "c"))
    got = {(r.period_day, r.arrival.start.day): r.n_obs for r in spark.table("cells").collect()}
    assert got == {(at(1), 1): 1, (datetime(2099, 1, 1), 1): 1, (at(1), 3): 1, (at(4), 4): 1}


def test_tick_goes_on_after_a_failed_handler(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "embed"), (1, 1, "embed"), (2, 1, "embed"), (3, 1, "extract"), (4, 1, "other")], "job_id int, attempt int, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "j"))
    seen, told = [], []

    def fails(rows):
        raise RuntimeError("no model")

    handlers = {"embed": lambda rows: seen.extend(r.job_id for r in rows.collect()), "extract": fails}
    q = jobs.tick(spark.readStream.schema(df.schema).parquet(str(tmp_path / "j")), handlers, lambda *a: told.append(a), str(tmp_path / "c"))
    q.awaitTermination()
    assert sorted(seen) == [1, 2] and told == [("embed", 2, None), ("extract", 1, "no model"), ("other", 1, "no handler")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_sql_run_and_have_unique_columns(spark):
    import __spark_entry__ as e

    for name in sorted(set(e.queries()) - set(e.oracle_sql())):
        df = e.queries()[name](spark, D)
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0, name
