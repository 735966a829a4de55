"""Memos and their gate, children of parents, phrases and boxes on small given rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from dossierlake.operators import extraction, memo, positions

EVIDENCE = "struct<document_id:string,document_type:string,page_number:int,quoted_span:string>"


def dossier(spark, findings=(), evidence=(), passages=(), documents=(), facts=(), notes=None, apps=("A",)):
    make = spark.createDataFrame
    return {
        "applications": make([(a, "PROCESSING", None, None, None, None, "REJECTED" if notes else None, notes) for a in apps], "k string, status string, full_name string, dob string, pan string, aadhaar string, decision string, notes string"),
        "documents": make(list(documents), "k string, document_id string, doc_type string"), "missing": make([], "k string, doc_type string"),
        "facts": make(list(facts), f"k string, kind string, fact string, value string, amount decimal(18,2), evidence {EVIDENCE}"),
        "findings": make(list(findings), "k string, seq int, rule_id string, rule_name string, verdict string, reason string, policy_version string"),
        "evidence": make(list(evidence), "k string, rule_id string, document_id string, document_type string, page_number int, quoted_span string"), "passages": make(list(passages), "k string, seq int, chunk_id string"),
    }


def test_memo_without_children(spark):
    (row,) = memo.gated(memo.memos(key="k", **dossier(spark))).collect()
    assert [line for line in row.memo.split("\n") if line.startswith("## ")] == memo.SECTIONS
    assert "No deterministic rule findings" in row.memo and "Unknown Applicant" in row.memo and "Referenced guidelines: None" in row.memo
    assert not row.grounded and row.memo.endswith("missing or unverified.]") and row.cited == []
    assert memo.memos(key="k", **dossier(spark, apps=())).collect() == []


def test_memo_gate(spark):
    d = dossier(
        spark, [("A", 2, "RULE-TAX-01", "Tax", "odd", "why not", "v2"), ("A", 1, "RULE-INC-01", "Income", "flag", "40 % off", "v1.0")],
        [("A", "RULE-INC-01", "P2", "payslip", 1, "INR 2.00"), ("A", "RULE-INC-01", "P1", None, None, None)], [("A", 0, "credit_policy_v1_p1")], [("A", "P1", None), ("A", "P2", "payslip")],
        [("A", "payslip", "net_salary", None, Decimal(5), ("P2", "payslip", 3, "five")), ("A", "payslip", "net_salary", None, Decimal(4), ("P1", "payslip", 1, "four"))], "as [made_up_id] says",
    )
    (row,) = memo.gated(memo.memos(key="k", **d)).collect()
    lines = row.memo.split("\n")
    assert "- **Audit Verdict Summary:** 0 Passed | 1 Flagged | 1 Unknown" in lines and lines.index("### ⚠️ FLAG RULE-INC-01: Income") < lines.index("### ❓ UNKNOWN RULE-TAX-01: Tax")
    at = lines.index("- **Supporting Evidence Citations:**")
    assert lines[at + 1 : at + 3] == ['  - `[P1]` document (Page 1): ""', '  - `[P2]` payslip (Page 1): "INR 2.00"']
    assert "- **Net Take-Home Salary:** INR 4.00" in lines and '  - *Evidence:* `[P1]` payslip (Page 1): "four"' in lines
    assert row.cited == ["credit_policy_v1_p1", "made_up_id"] and not row.grounded
    assert "> ⚠️ [UNGROUNDED CLAIM DROPPED - Unauthorized citations: made_up_id]" in lines and "made_up_id] says" not in row.memo


def test_children(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, "x", 1)], "k int, name string, n int")
    rows = {r.k: [tuple(x) for x in r.c] for r in memo.nested(parent, "k", c=(child, ["n"])).collect()}
    assert rows == {1: [(1, "a"), (2, "b")], 2: []}
    assert [tuple(r) for r in memo.without_children({"c": child}, "k", parent)["c"].collect()] == [(3, "x", 1)]


def test_phrases_on_pages(spark):
    text = "Total income: INR 5\n\nThe  net\tpay, Net Pay is due\nnet pay"
    words = positions.laid_out(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc string, t string"), "doc", "t")
    placed = {(r.pos, r.word): (r.x0, r.y0, r.x1, r.y1) for r in words.collect()}
    assert placed[(1, "Total")] == (50.0, 50.0, 80.0, 62.0) and placed[(3, "INR")] == (134.0, 50.0, 152.0, 62.0) and placed[(5, "The")][1] == 78.0
    scanned = words.filter("word = 'due'").select("doc", F.lit(9).alias("page"), "pos", "word", "x0", "y0", "x1", "y1", F.lit(positions.OCR).alias("method"))
    asked = spark.createDataFrame([(1, "total INCOME"), (2, "net pay"), (3, "is due"), (4, " "), (5, "pay income"), (6, "due"), (7, "nowhere due")], "i int, p string")
    found = {(r.i, r.page): (r.hits, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in positions.phrase_evidence(words.union(scanned), asked, "i", "p").collect()}
    assert found[(1, 1)] == (1, 50.0, 50.0, 128.0, 62.0, 1.0)
    assert found[(2, 1)][0] == 2 and found[(2, 1)][2] == 78.0 and found[(2, 1)][4] == 104.0  # the third line's hit starts within a line of the second's
    assert found[(6, 9)][5] == positions.OCR_CONFIDENCE and found[(6, 1)][5] == 1.0
    assert set(found) == {(1, 1), (2, 1), (3, 1), (6, 1), (6, 9)}


def test_boxes_of_facts(spark):
    words = positions.laid_out(spark.createDataFrame([("d", "pay 5,00 now 5,00")], "doc string, t string"), "doc", "t")
    facts = spark.createDataFrame([("d", 1, "5,00"), ("d", 1, "gone"), ("d", None, None)], "doc string, page int, value string")
    got = {r.value: (r.x0, r.y0, r.x1, r.y1) for r in positions.with_boxes(facts, words, "doc", "page", "value").collect()}
    assert got == {"5,00": (74.0, 50.0, 152.0, 62.0), "gone": positions.FALLBACK_BOX, None: (None,) * 4}


def test_first_facts(spark):
    rows = [("a", "d2", 2, 1, "PAYSLIP Net Pay: 900"), ("a", "d1", 1, 2, "Net Pay: 700"), ("a", "d1", 1, 1, "Payslip. Jailbreak"), ("a", "d3", 3, 1, "nothing to see"), ("b", "d4", 1, 1, None)]
    got = extraction.first_facts(spark.createDataFrame(rows, "app string, doc string, o int, page int, t string"), "app", "doc", "o", "page", "t")
    (row,) = got.filter("fact = 'net_salary'").collect()
    assert (row.app, row.doc, str(row.amount), row.page_number, row.defused) == ("a", "d1", "700.00", 2, True)
    assert got.filter("app = 'b'").count() == 0
