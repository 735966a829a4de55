"""What is kept between runs: a tenant's replacement, repeated batches, overlays, splits by two keys."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import splits, state, tenant_index
from dossierlake.sources import versioned


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_tenant_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [("01", 1, "net pay of march"), ("01", 2, "closing balance"), ("b c", 3, "net pay of april"), (None, 4, "net pay"), ("b c", 5, None)]
    df = spark.createDataFrame(rows, "tenant string, id int, text string")
    tenant_index.replaced(df, path, "id", "text")
    before = files(path)
    tenant_index.replaced(spark.createDataFrame([("01", 9, "other pay")], "tenant string, id int, text string"), path, "id", "text")
    after = files(path)
    kept = {f for f in before if "tenant=b" in f}
    assert kept and all(after[f] == before[f] for f in kept) and not [f for f in before if "tenant=01" in f and f in after]
    asked = spark.createDataFrame([(1, "01", "net pay"), (2, "b c", "net pay"), (3, "none", "net pay")], "q int, tenant string, text string")
    got = tenant_index.search(spark, path, asked, "q", "text", 3, stop=[])
    assert {(r.q, r.key, r.rank) for r in got.collect()} == {(1, 9, 1), (2, 3, 1), (2, 5, 2)}
    words, posted = tenant_index.read(spark, path, ["01"])
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan and "tenant#" in plan and "= 01" in plan
    tenant_index.replaced(df.filter("tenant = 'x'"), path, "id", "text", tenants=["b c"])
    assert [r.tenant for r in tenant_index.read(spark, path)[0].collect()] == ["01"]


def test_pages_of_all_forms(spark):
    texts = {"a": " one ", "b": ["x", " ", {"page_number": 7, "text": "y"}, {"text": "z"}], "c": 5, "d": None, "e": []}
    rows = [("A1", json.dumps(texts)), ("policy", json.dumps({"a": "no"})), ("A2", "not json"), ("A3", None)]
    got = tenant_index.dossier_pages(spark.createDataFrame(rows, "app string, texts string"), "app", "texts").collect()
    assert sorted(tuple(r) for r in got) == [("A1", "a", 1, "one"), ("A1", "b", 1, "x"), ("A1", "b", 4, "z"), ("A1", "b", 7, "y")]


def test_repeated_batches_change_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k string, at int, v string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(tuple(r) for r in versioned.latest(spark, path, make().schema).collect())
    assert read() == []
    versioned.merge_batch(make(("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")), 0, path, "k", ["at"], 4)
    versioned.merge_batch(make(("b", 0, "later batch"), ("c", 1, "z")), 1, path, "k", ["at"], 4)
    want = [("a", 2, "new"), ("b", 0, "later batch"), ("c", 1, "z")]
    assert read() == want
    versioned.merge_batch(make(("a", 9, "again")), 0, path, "k", ["at"], 4)
    assert read() == want
    make(("a", 3, "broken off")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/batch=2")  # never committed
    assert read() == want


def test_merged_stream_restarts(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    for number, rows in enumerate(([("a", 1)], [("a", 2), ("b", 1)])):
        spark.createDataFrame(rows, "k string, at int").coalesce(1).write.mode("append").parquet(source)
        q = versioned.merged_stream(spark.readStream.schema("k string, at int").parquet(source), path, "k", ["at"], checkpoint)
        assert q.awaitTermination(120) and q.exception() is None, number
    schema = spark.createDataFrame([], "k string, at int").schema
    assert sorted(tuple(r) for r in versioned.latest(spark, path, schema).collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize(
    "a,b,kept,dropped",
    [
        ('{"x":{"y":1,"z":[1]},"w":null}', '{"x":{"y":null,"z":[2,3],"n":{"m":1}}}', '{"w":null,"x":{"n":{"m":1},"y":null,"z":[2,3]}}', '{"w":null,"x":{"n":{"m":1},"z":[2,3]}}'),
        ('{"x":1}', None, '{"x":1}', '{"x":1}'), (None, '{"x":1}', '{"x":1}', '{"x":1}'), ("[1]", '{"x":1}', '{"x":1}', '{"x":1}'), ('{"x":1}', "oops", '{"x":1}', '{"x":1}'), ('{"x":{"a":1}}', '{"x":"s"}', '{"x":"s"}', '{"x":"s"}'), ("bad", None, None, None),
    ],
)
def test_overlay(spark, a, b, kept, dropped):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert tuple(df.select(state.overlaid("a", "b"), state.overlaid("a", "b", drop_nulls=True)).first()) == (kept, dropped)


def test_initial_state(spark):
    got = spark.range(1).select(state.initial(state.new_id(F.lit("x")), F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0]
    found = json.loads(got)
    assert found["application_id"].startswith("APP-") and len(found["application_id"]) == 12 and found["applicant"] is None and found["findings"] == [] and found["status_history"][0]["timestamp"].startswith("2024-01-02T03:04:05")


def test_splits_share_no_key(spark):
    rows = [(f"p{i}", f"f{i // 3}") for i in range(3000)] + [("p0", "f1"), (None, "f7"), ("alone", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    got = [tuple(r) for r in splits.double_disjoint(df, "a", "b", {"train": 70, "dev": 15, "test": 15}).collect()]
    assert len(got) == len(rows)
    for at in (0, 1):
        seen = {}
        for r in got:
            if r[at] is not None:
                assert seen.setdefault(r[at], r[2]) == r[2]
    share = sum(r[2] == "train" for r in got) / len(got)
    assert 0.62 < share < 0.78 and {r[2] for r in got if r[:2] == (None, None)} == {None} and {r[2] for r in got if r[0]} == {"train", "dev", "test"}
    assert splits.double_disjoint(df.limit(0), "a", "b", {"train": 70, "dev": 30}).collect() == []
