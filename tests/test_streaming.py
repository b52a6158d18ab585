"""Streams over several files: late rows, several batches, repeated runs."""

import datetime as dt

from pyspark.sql import functions as F

from callstrata.streaming import jobs

CALLS = "FECHA timestamp_ntz, TELEFONO string, SENTIDO string, ATENDIDA string"


def day(d, h=12):
    return dt.datetime(2024, 1, d, h)


def file(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    jobs.land(df, path)
    return df.schema


def test_late_rows_are_dropped_and_closed_days_kept(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "job")
    schema = file(spark, src, [(day(1), "a", "in", "Si"), (day(2), "b", "in", "No"), (day(5), "c", "in", "Si")], CALLS)
    stream = lambda: jobs.daily_counts(jobs.landed(spark, src, schema, "FECHA"))
    first = jobs.run_to_table(stream(), root)
    assert {(r["desde"].day, r["y"], r["atendidas"]) for r in first.collect()} == {(1, 1, 1), (2, 1, 0)}
    file(spark, src, [(day(1), "late", "in", "Si"), (day(4), "d", "in", "Si"), (day(9), "e", "in", "Si")], CALLS)
    second = jobs.run_to_table(stream(), root)
    got = {r["desde"].day: r["y"] for r in second.collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 1}


def test_future_rows_go_aside_once(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "job")
    schema = file(spark, src, [(day(1), "a", "in", "Si"), (day(20), "b", "in", "No")], CALLS)
    for _ in range(2):
        kept, future = jobs.split_future(jobs.landed(spark, src, schema, "FECHA", files_per_batch=1), "2024-01-10", root)
        assert kept.count() == 1 and [r["TELEFONO"] for r in future.collect()] == ["b"]
    file(spark, src, [(day(10, 23), "c", "in", "Si")], CALLS)
    kept, future = jobs.split_future(jobs.landed(spark, src, schema, "FECHA"), "2024-01-10", root)
    assert kept.count() == 2 and future.count() == 1


def test_violations_add_up_over_batches(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "job")
    burst = lambda d, k, n: [(k, day(d) + dt.timedelta(seconds=i)) for i in range(n)]
    schema = file(spark, src, burst(1, "hot", 4) + burst(1, "calm", 1) + burst(2, "end", 1), "k string, ts timestamp_ntz")
    run = lambda: jobs.blocks(jobs.sliding_counts(jobs.landed(spark, src, schema, "ts"), "k", "ts", limit=3), root)
    first = run().where("clave = 'hot'").agg(F.max("acumulado"), F.max("minutos")).first()
    assert first[0] == 6 and first[1] == 15 * 2 ** 5
    file(spark, src, burst(3, "hot", 4) + burst(4, "end", 1), "k string, ts timestamp_ntz")
    out = run().where("clave = 'hot'").orderBy("desde").collect()
    assert [r["acumulado"] for r in out] == list(range(1, 13))
    assert [r["minutos"] for r in out][:3] == [None, None, 120]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "job")
    at = lambda m: day(1) + dt.timedelta(minutes=m)
    schema = file(spark, src, [("a", at(0)), ("a", at(20)), ("a", at(60)), ("b", at(5)), ("z", at(600))], "k string, ts timestamp_ntz")
    out = jobs.run_to_table(jobs.sessions(jobs.landed(spark, src, schema, "ts"), "k", "ts"), root)
    assert sorted((r["clave"], r["eventos"]) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]
