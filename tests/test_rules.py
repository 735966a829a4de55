"""Edges of the rules: tolerances are inclusive, and missing values are unknown."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import rules as R
from dossierlake.operators import workqueue as W
from dossierlake.sources import synth


def verdict(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def d(x):
    return F.lit(x).cast("decimal(18,2)")


@pytest.mark.parametrize(("net", "credits", "want"), [("100", ["95"], "pass"), ("100", ["94.99"], "flag"), ("100", ["105", "105"], "pass"), ("100", [], "unknown"), (None, ["1"], "unknown"), ("100", ["0"], "unknown"), ("100", ["100", None], "unknown"), ("0", ["1"], "unknown")])
def test_income(spark, net, credits, want):
    array = F.array(*map(d, credits)) if credits else F.array().cast("array<decimal(18,2)>")
    assert verdict(spark, R.income(d(net), array)) == want


@pytest.mark.parametrize(("closing", "tolerance", "want"), [("1150.10", "0.05", "pass"), ("1150.11", "0.05", "flag"), ("1150.15", "0.10", "pass"), (None, "0.05", "unknown")])
def test_bank(spark, closing, tolerance, want):
    assert verdict(spark, R.bank_balance(d("1000.00"), d(closing), d("250.33"), d("100.28"), tolerance)) == want


def test_tax(spark):
    assert verdict(spark, R.tax(d("1080"), d(None), d("100"))) == "pass"
    assert verdict(spark, R.tax(d("1079.99"), d(None), d("100"))) == "flag"
    assert verdict(spark, R.tax(d(None), d("1"), d(None))) == "unknown"


def test_completeness(spark):
    rows = spark.createDataFrame([("a", "payslip"), ("a", "salary_slip"), ("a", "kyc"), ("b", "unreadable"), ("c", "kyc"), ("d", None)], "k string, t string")
    got = {r["k"]: (r["verdict"], r["missing"]) for r in R.completeness(rows, {"payslip": 2, "id_card": 1}, "k", "t").collect()}
    assert got["a"] == ("pass", "") and got["b"][0] == "unknown" and got["c"] == ("flag", "payslip") and got["d"][0] == "unknown"


def test_identity(spark):
    rows = [("same", "Asha Rao", "ABCDE1234F", "RAO ASHA", None), ("pan", "Asha Rao", "ABCDE1234F", "Asha Rao", "ABCDE1234G"), ("other", "Asha Rao", None, "Vikram Joshi", None), ("none", "Asha Rao", None, None, None), ("noname", "", None, "x", None), ("nopan", "Asha Rao", "ABCDE1234F", "Asha Rao", "unknown")]
    got = {r["k"]: r["verdict"] for r in R.identity(spark.createDataFrame(rows, "k string, applicant string, applicant_pan string, other string, other_pan string"), "k").collect()}
    assert got == {"same": "pass", "pan": "flag", "other": "flag", "none": "unknown", "noname": "unknown", "nopan": "unknown"}


def test_dossiers_meet_their_outcomes(spark):
    from dossierlake.plans.ledger_queries import dossier_findings

    rows = dossier_findings(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["verdict"] == r["expected"] for r in rows)
    assert {r["scenario"] for r in rows} == set(synth.SCENARIOS)


def test_limiter():
    assert W.admit([0, 1, 2, 61, 62], 60, 2) == [(True, 1, 0), (True, 0, 0), (False, 0, 59), (True, 1, 0), (True, 0, 0)]


def test_limiter_in_spark(spark):
    times = [0.0, 10.0, 20.0, 65.0, 70.0, 71.0, 200.0]
    rows = spark.createDataFrame([(k, i, t) for k in ("a", "b") for i, t in enumerate(times)], "k string, i long, t double")
    got = W.rate_limited(rows, "k", "t", "i", 60.0, 2).orderBy("k", "i").collect()
    assert [r["allowed"] for r in got] == [x[0] for x in W.admit(times, 60.0, 2)] * 2


def test_slots(spark):
    rows = spark.createDataFrame([("u", 1, 0.0, "reserve"), ("u", 2, 1.0, "reserve"), ("u", 3, 2.0, "reserve"), ("u", 1, 3.0, "release"), ("u", 4, 4.0, "reserve"), ("u", 5, 2000.0, "reserve")], "k string, j long, t double, a string")
    got = {r["j"]: r["granted"] for r in W.slots(rows, "k", "t", "j", "a").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_money_is_exact(spark):
    assert verdict(spark, R.within(d("100.00"), d("95.00"), 0.05)) == "pass"
    assert spark.range(1).select(R.poisoned_sum(d("1")).alias("x")).first()["x"] == Decimal("1.00")


@pytest.mark.parametrize(("stated", "yearly", "period", "is_monthly", "want"), [("1200", "100", None, None, "pass"), ("1200", "1200", None, None, "pass"), ("1200", "100", "annual", None, "flag"), ("1200", "1200", "monthly", None, "flag"), ("1200", "1200", "annual", True, "flag"), ("1200", "100", "monthly", False, "flag"), ("1200", "100", "annual", True, "pass")])
def test_tax_period(spark, stated, yearly, period, is_monthly, want):
    assert verdict(spark, R.tax(d(stated), d(yearly), period=F.lit(period), is_monthly=F.lit(is_monthly))) == want
    assert verdict(spark, R.tax(d("1080"), d("1200"), tolerance=-1.0, period=F.lit("annual"))) == "pass"


@pytest.mark.parametrize(("decision", "notes", "n", "typed", "want"), [("REJECTED", " abcd ", 0, None, "notes_too_short"), ("REJECTED", "abcde", 50, " A1 ", None), ("APPROVED", None, 51, None, "too_many_corrections"), ("APPROVED", "x" * 5001, 0, None, "notes_too_long"), ("APPROVED", None, 0, "a1", "id_differs")])
def test_review_problem(spark, decision, notes, n, typed, want):
    assert verdict(spark, R.review_problem(F.lit(decision), F.lit(notes), F.array_repeat(F.lit(1), n), F.lit(typed), F.lit("A1"))) == want


def test_choice_precision_and_policy_queries(spark):
    from dossierlake.operators import metrics, retrieval

    assert [verdict(spark, metrics.chosen(F.lit(0.90), F.lit(x))) for x in (0.92, 0.94)] == ["BASELINE", "CHALLENGER"]
    rows = spark.createDataFrame([("dev", True), ("dev", False), ("held_out", True)], "split string, mine boolean")
    assert {r["split"]: r["precision"] for r in retrieval.grounding_precision(rows, "split", F.col("mine")).collect()} == {"dev": 0.5, "held_out": 1.0, "overall": 0.6667}
    found = R.findings(**{"RULE_INC_01": F.lit("flag"), "RULE_COMP_01": F.lit("pass")})
    assert len(verdict(spark, retrieval.policy_queries(found))) == 3
    assert verdict(spark, retrieval.with_backstop(F.array(F.lit("x"), F.lit("CHUNK-POLICY-SAL-02")), found)) == ["x", "CHUNK-POLICY-SAL-02", "credit_policy_v1_p1", "kyc_guidelines_v1_p1", "CHUNK-POLICY-REQ-01", "CHUNK-POLICY-TAX-03"]


def test_counts_are_damped(spark):
    import math

    from dossierlake.operators import classify

    pages = spark.createDataFrame([("pay pay pay", "a"), ("tax", "b")], "text string, label string")
    model = classify.fit(pages)
    rows = classify.featured(pages)
    for stage in model.stages[1:3]:
        rows = stage.transform(rows)
    assert {round(float(x), 6) for r in rows.select("_ws").collect() for x in r["_ws"].values if x} == {1.0, round(1 + math.log(2), 6), round(1 + math.log(3), 6)}
