"""Streams against their batch forms."""

from __future__ import annotations

from dossierlake.operators import workqueue as W
from dossierlake.streaming import jobs


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_limiter(spark, tmp_path):
    times = [0.0, 10.0, 20.0, 65.0, 70.0, 71.0]
    s = source(spark, tmp_path, [("u", i, t) for i, t in enumerate(times)], "k string, i long, t double")
    got = run(spark, jobs.rate_limiter(s, "k", "t", "i", 60.0, 2), "limited").orderBy("i").collect()
    assert [r["allowed"] for r in got] == [x[0] for x in W.admit(times, 60.0, 2)]


def test_limiter_forgets_by_watermark(spark, tmp_path):
    from datetime import datetime, timedelta

    times = [0.0, 10.0, 20.0, 65.0, 70.0, 71.0]
    rows = [("u", i, datetime(2024, 1, 1) + timedelta(seconds=t)) for i, t in enumerate(times)] + [("v", 9, datetime(2024, 1, 2))]
    s = source(spark, tmp_path, rows, "k string, i long, t timestamp")
    got = run(spark, jobs.rate_limiter(s, "k", "t", "i", 60.0, 2, delay="1 minute"), "forgetful").orderBy("i").collect()
    assert [r["allowed"] for r in got] == [x[0] for x in W.admit(times, 60.0, 2)] + [True]


def test_status_machine(spark, tmp_path):
    s = source(spark, tmp_path, [("a", 1, "QUEUED"), ("a", 2, "REVIEWED"), ("a", 3, "PROCESSING")], "k string, i long, s string")
    got = run(spark, jobs.status_machine(s, "k", "i", "i", "s", {"QUEUED": ["PROCESSING"]}), "moves").orderBy("i").collect()
    assert [(r["from_state"], r["legal"]) for r in got] == [(None, True), ("QUEUED", False), ("QUEUED", True)]


def test_attempts_go_to_dead_letters(spark, tmp_path):
    s = source(spark, tmp_path, [("a", 1), ("b", 4)], "job string, attempt int")
    q = jobs.route_attempts(s, "attempt", str(tmp_path / "done"), str(tmp_path / "dead"), lambda b: b, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["job"] for r in spark.read.parquet(str(tmp_path / "done")).collect()] == ["a"]
    assert [r["job"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["b"]
