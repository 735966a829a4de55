"""Readers and small operators on files and rows of their own, and streams of windows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from dossierlake.operators import classify, extraction, grounding, retrieval, rules
from dossierlake.sources import readers
from dossierlake.streaming import jobs


def test_policies_and_questions(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "credit.md").write_text("# One\n\ntext")
    (tmp_path / "p" / "notes.txt").write_text("no policy")
    assert [(r["doc_id"], r["text"]) for r in readers.policies(spark, f"file://{tmp_path}/p").collect()] == [("credit", "# One\n\ntext")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "question": "x?", "expected_citations": ["a", "b"]}, {"id": "q2"}]))
    assert [(r["id"], r["expected_citations"], r["split"]) for r in readers.questions(spark, f"file://{tmp_path}/q.json").orderBy("id").collect()] == [("q1", ["a", "b"], None), ("q2", None, None)]


def test_manifests(spark, tmp_path):
    new = {"application_id": "APP-1", "financial_ground_truth": {"gross_monthly_salary": 85000.5}, "applicant_facts": {"full_name": "Asha Rao"}, "expected_rule_outcomes": {"RULE-TAX-01": "flag", "RULE-INC-01": "pass"}}
    for name, content in (("a", new), ("b", {"application_id": "APP-2", "injected_anomaly": None})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "dossier_manifest.json").write_text(json.dumps(content, indent=1))
    got = readers.manifests(spark, f"file://{tmp_path}")
    assert {(r["application_id"], r["financial_ground_truth"] and r["financial_ground_truth"]["gross_monthly_salary"]) for r in got.collect()} == {("APP-1", Decimal("85000.50")), ("APP-2", None)}
    chunks = {r["chunk_id"]: r["text"] for r in readers.manifest_chunks(got).collect()}
    assert len(chunks) == 10 and "85,000.50" in chunks["APP-1_payslip"] and "UNKNOWN" in chunks["APP-2_payslip"] and chunks["APP-1_rules"].endswith("RULE-INC-01 pass, RULE-TAX-01 flag")


def test_seed_csv(spark, tmp_path):
    head = ",".join(f" {c.split()[0]}" for c in readers.SEED_CSV.split(", "))
    row = "1,2, Graduate,No,9600000,29900000,12,778,2400000,17600000,22700000,8000000,Approved"
    (tmp_path / "good.csv").write_text(f"﻿{head}\n{row}\n")
    (got,) = readers.seed_csv(spark, f"file://{tmp_path}/good.csv").collect()
    assert (got["loan_id"], got["education"], got["assets_total"]) == (1, "Graduate", 50_700_000.0)
    (tmp_path / "bad.csv").write_text(f"{head}\n{row.replace('778', 'many')}\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|cannot be parsed|Malformed"):
        readers.seed_csv(spark, f"file://{tmp_path}/bad.csv").collect()


def test_uploads_and_keys(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.png", b"\x89PNG\r\n"), ("c.exe", b"MZ"), ("d.jpg", b"")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rpartition("/")[2]: (r["media_type"], r["accepted"]) for r in readers.uploads(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.pdf": ("application/pdf", True), "b.png": ("image/png", True), "c.exe": (None, False)}
    keys = spark.createDataFrame([("t1/a/b.pdf",), ("t2/a.pdf",), ("t1/../t2/a.pdf",), ("t1//a",), ("/t1/a",)], "k string")
    from pyspark.sql import functions as F

    assert [r[0] for r in keys.select(readers.valid_key("k", F.lit("t1"))).collect()] == [True, False, False, False, False]


def test_span_box(spark):
    words = spark.createDataFrame([("d", 1, 10.0, 100.0, 20.0, 110.0), ("d", 1, 25.0, 101.5, 44.444, 111.0), ("d", 1, 5.0, 130.0, 9.0, 140.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in extraction.span_box(words, "doc", "page").collect()] == [("d", 1, 10.0, 100.0, 44.44, 111.0)]


def test_grounded_claims(spark):
    claims = spark.createDataFrame([(1, ["CHUNK-POLICY-SAL-02"]), (2, ["x"]), (3, []), (4, None), (5, ["credit_policy_v1_p1", "x"])], "i int, cited array<string>").selectExpr("*", "array('credit_policy_v1_p1') as allowed")
    assert [r["i"] for r in grounding.grounded(claims, "cited", "allowed").collect()] == [1]
    assert [r["i"] for r in grounding.grounded(claims, "cited", "allowed", keep=False).orderBy("i").collect()] == [2, 3, 4, 5]


def test_cascade(spark):
    first = spark.createDataFrame([(1, "UNKNOWN", 0.2), (2, "UNKNOWN", 0.1), (3, "payslip", 0.9), (4, "UNKNOWN", 0.39)], "k int, label_pred string, confidence double")
    second = spark.createDataFrame([(1, "id_card", 0.8), (2, "id_card", 0.8), (3, "id_card", 0.8)], "k int, label_pred string, confidence double")
    got = {r["k"]: (r["label_pred"], r["confidence"], r["escalated"]) for r in classify.cascade(first, second, "k").collect()}
    assert got == {1: ("id_card", 0.8, True), 2: ("UNKNOWN", 0.1, False), 3: ("payslip", 0.9, False), 4: ("UNKNOWN", 0.39, True)}


def test_all_clear(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(rules.all_clear(rules.findings(RULE_A=F.lit("pass"), RULE_B=F.lit("pass"))).alias("a"), rules.all_clear(rules.findings(RULE_A=F.lit("pass"), RULE_B=F.lit("unknown"))).alias("b")).first()
    assert (row["a"], row["b"]) == (True, False)


def test_hybrid_isolates_tenants(spark):
    passages = [("A", i, t) for i, t in enumerate(["salary credited in march", "closing balance of the account", "", "tax return of the year"])] + [("B", i, t) for i, t in enumerate(["salary salary salary", "salary march"])] + [("POLICY", 0, "salary tolerance of five percent")]
    asked = [("q1", "A", "salary in march"), ("q2", "POLICY", "salary"), ("q3", "C", "salary"), ("q4", "A", "  "), ("q5", "B", "nothing here")]
    p, q = spark.createDataFrame(passages, "tenant string, chunk int, text string"), spark.createDataFrame(asked, "q string, tenant string, question string")
    got = {}
    for r in retrieval.hybrid(p, q, "tenant", "chunk", "text", "q", "question", 3).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["tenant"], r["chunk"]))
    assert got["q1"][0] == ("A", 0) and len(got["q1"]) == 3 and {t for t, _ in got["q1"]} == {"A"}
    assert got["q2"] == [("POLICY", 0)] and got["q5"] == [("B", 0), ("B", 1)] and set(got) == {"q1", "q2", "q5"}
    assert [r["q"] for r in retrieval.unindexed(q, p, "tenant").collect()] == ["q3"]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_windows_sessions_and_duplicates(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    rows = [("u", at(0), "x"), ("u", at(60), "x"), ("u", at(400), "y"), ("v", at(30), "x"), ("u", at(0), "x")]
    schema = "k string, at timestamp, kind string"
    for sub in ("a", "b", "c"):
        (tmp_path / sub).mkdir()
    windows = _run(spark, jobs.windowed_counts(_stream(spark, tmp_path / "a", rows, schema), "at", "kind", "5 minutes"), "windows_", "complete")
    assert sorted((r["start"], r["kind"], r["n"]) for r in windows) == [(t0, "x", 4), (at(300), "y", 1)]
    runs = _run(spark, jobs.sessions(_stream(spark, tmp_path / "b", rows, schema), "at", "k"), "sessions_", "complete")
    assert sorted((r["k"], r["start"], r["n"]) for r in runs) == [("u", t0, 3), ("u", at(400), 1), ("v", at(30), 1)]
    once = _run(spark, jobs.deduplicated(_stream(spark, tmp_path / "c", [(1, at(0)), (1, at(5)), (2, at(9))], "job int, at timestamp"), "job", "at"), "once_", "append")
    assert sorted(r["job"] for r in once) == [1, 2]
