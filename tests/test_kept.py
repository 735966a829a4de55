"""Answers kept in state: reuse, another state of the application, restart, expiry."""

from __future__ import annotations

from datetime import datetime, timedelta

from dossierlake.streaming import kept

SCHEMA = "application string, id long, question string, updated string, answer string, t timestamp"


def test_answers_are_kept_and_expire(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)

    def feed(*rows):
        timed = [(*r[:-1], datetime(2024, 1, 1) + timedelta(seconds=r[-1])) for r in rows]
        spark.createDataFrame(timed, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = kept.kept_answers(spark.readStream.schema(SCHEMA).parquet(source), "t", 900)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        ids = {r[1] for r in rows}
        return {r.id: (r.answer, r.kept) for r in spark.read.parquet(out).collect() if r.id in ids}

    first = feed(("a", 1, "why", "t1", "one", 0), ("a", 2, "why", "t1", "two", 5), ("b", 3, "why", "t1", "three", 1), ("a", 4, "how", "t1", None, 2))
    assert first == {1: ("one", False), 2: ("one", True), 3: ("three", False), 4: (None, False)}
    # another start of the stream reads the state of the checkpoint
    assert feed(("a", 5, "why", "t1", "five", 900), ("a", 6, "why", "t2", "six", 30), ("a", 7, "how", "t1", "seven", 31)) == {5: ("one", True), 6: ("six", False), 7: ("seven", False)}
    assert feed(("a", 8, "why", "t1", "eight", 901), ("a", 9, "why", "t1", "nine", 1000)) == {8: ("eight", False), 9: ("eight", True)}
