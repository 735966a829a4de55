"""What small tables don't show: rows that only turn up in larger ones, and tables made to hold them."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossierlake.functions import text as T
from dossierlake.operators import classify, grounding, positions
from dossierlake.plans import catalog, extraction_queries

SF = "/root/testdata/sf0.001"


def both(spark, at, name, **changed):
    """A query's rows and its SQL's, over the smallest tables with some of them changed by SQL."""
    con = duckdb.connect()
    at.mkdir()
    for t in ("customer", "orders", "part", "lineitem", "events", "documents", "benchmark", "conversations"):
        con.execute(f"copy ({changed.get(t, 'select * from {0}').format(f"'{SF}/{t}.parquet'")}) to '{at}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    got = catalog.queries()[name](spark, str(at))
    columns = ", ".join(sorted(got.columns))
    con.execute(f"select {columns} from ({catalog.oracle_sql()[name]})")
    return sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str), sorted(con.fetchall(), key=str)


def test_evidence_whose_ids_begin_with_each_other(spark, tmp_path):
    orders = "select * replace (case when o_orderkey % 2 = 0 then 12 else 123 end as o_orderkey, 7 as o_custkey, case when o_orderkey % 2 = 0 then '1-URGENT' else '2-HIGH' end as o_orderpriority) from {0} where o_orderkey < 2"
    ours, sql = both(spark, tmp_path / "t", "appraisal_memos", orders=orders)
    assert ours == sql
    memo = next(r[2] for r in ours if r[0] == 7)
    assert memo.count("  - `[ORD-123]` bank_statement") == 1 and memo.index("  - `[ORD-123]` bank_statement") < memo.index("  - `[ORD-12]` payslip", memo.index("RULE-INC-01: "))


def test_holder_who_is_called_like_a_bank(spark, tmp_path):
    orders = "select * replace (7352 as o_custkey, '2-HIGH' as o_orderpriority) from {0} where o_orderkey < 2"
    ours, sql = both(spark, tmp_path / "t", "bank_activity", orders=orders)
    assert ours == sql and {r[0] for r in ours} == {""}


@pytest.mark.parametrize("name", ["bm25_topk", "tf_overlap_topk", "rrf_fusion"])
def test_pairs_of_query_and_passage_are_not_shuffled(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # a sum over query and passage that is followed by a shuffle on both would move every pair
    assert not re.search(r"Exchange hashpartitioning\(item_id[^\n]*doc_id[^\n]*\n[^\n]*HashAggregate[^\n]*partial_sum", plan)


def test_common_subsequence_is_linear_in_rows_of_its_table():
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcdé ", k=rng.randint(1, 90))) for _ in "ab")
        assert T.common_subsequence(a, b) == plain(a, b)
    assert T.common_subsequence("ab" * 5000, "ba" * 5000) == 9999


def test_words_are_placed_where_their_text_is_read(spark):
    texts = spark.createDataFrame([(1, "a  bb\n" * 52 + "c"), (2, None), (3, ""), (4, "é𝒳 z")], "d long, t string")
    placed = positions.laid_out(texts, "d", "t")
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r)[:8] for r in placed.orderBy("doc", "page", "pos").collect()]
    assert len(rows) == 107 and rows[1] == (1, 1, 2, "bb", 68.0, 50.0, 80.0, 62.0) and rows[104] == (1, 2, 1, "c", 50.0, 50.0, 56.0, 62.0)
    assert rows[105:] == [(4, 1, 1, "é𝒳", 50.0, 50.0, 62.0, 62.0), (4, 1, 2, "z", 68.0, 50.0, 74.0, 62.0)]


def test_pages_are_judged_on_all_cores(spark):
    assert catalog.queries()["page_classifier"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_memos_read_and_shuffle_orders_once(spark):
    plan = catalog.queries()["appraisal_memos"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[o_", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?:o_custkey|app)#", plan)) == 1


def test_gate_takes_only_bad_texts_apart(spark):
    """The lines' gate as it is defined, line by line, on texts with and without bad lines; what a line needs of its text is computed outside of the lines."""
    texts = ["a [ok]\nb [DOC-7]\n", "a [x]\n\nb [x] [y] [ok]", "[PASS]\n[x][x]", "none", "", None, "a [o\nk] [kyc_guidelines_v1_p1_c0]", "\n[ok]\n"]

    def plain(t, allowed):
        bad = lambda s: list(dict.fromkeys(c for c in re.findall(r"\[([a-zA-Z0-9_\-]+)\]", s) if c not in allowed and not c.upper().startswith(tuple(grounding.EXEMPT))))
        if not t:
            return grounding.EMPTY_ANSWER
        if not allowed:
            return t + "\n\n" + grounding.NO_EVIDENCE
        if not re.findall(r"\[([a-zA-Z0-9_\-]+)\]", t):
            return grounding.NONE_CITED
        lines = [f"{grounding.DROPPED_LINE}{', '.join(bad(x))}]" if bad(x) else x for x in t.split("\n")]
        return "\n".join(lines) + ("\n\n" + grounding.SOME_DROPPED if bad(t) else "")

    for ids in (["ok", "CHUNK-POLICY-KYC-01"], []):
        df = spark.createDataFrame([(i, t, ids) for i, t in enumerate(texts)], "i int, t string, a array<string>")
        allowed = [*ids, *(["kyc_guidelines_v1_p1_c0"] if ids else [])]
        gated = df.select("i", grounding.sanitised(F.col("t"), F.col("a")).alias("t"))
        assert [r.t for r in gated.orderBy("i").collect()] == [plain(t, allowed) for t in texts]
        assert gated._jdf.queryExecution().optimizedPlan().toString().count("arrays_overlap") == 3  # one for each group of aliases


def test_pages_are_judged_as_by_the_models_stages(spark, monkeypatch):
    """Probabilities of pages, turns, blank and long texts are those that the model's own stages give, however many are counted at a time."""
    from pyspark.ml.functions import vector_to_array

    pages = extraction_queries.pages(spark, SF).select("doc", F.col("kind").alias("label"), "text")
    (grams,) = spark.createDataFrame([("a bcd",)], "t string").select(classify.char_ngrams("t")).first()
    assert sorted(grams) == sorted([" a ", " bc", "bcd", "cd ", " a ", " bcd", "bcd ", " a ", " bcd "]) == sorted(x for w in ("a", "bcd") for x in classify._runs_of(w))
    model = classify.fit(classify.sample(pages, "label", 40, 1, "doc"))
    other = [("a", ""), ("b", " \n"), ("c", "a"), ("d", "pay"), ("e", "Pay PAY pay"), ("f", "é𝒳 _x_ 12"), ("g", "monthly payslip " * 3000), ("h", "zzz qqq")]
    rows = pages.select("doc", "text").unionByName(spark.createDataFrame(other, "doc string, text string")).unionByName(spark.createDataFrame([("t", "Bank statement of the bank")], "doc string, text string"))
    staged = classify.featured(rows)
    for stage in model.stages[1:]:
        staged = stage.transform(staged)
    want = {r.doc: r.p for r in staged.select("doc", vector_to_array("_p").alias("p")).collect()}
    for chunk in (classify._Judge.CHUNK, 50):
        monkeypatch.setattr(classify._Judge, "CHUNK", chunk)
        judge, texts = classify._Judge(classify._weights(model)), rows.select("doc", T.words("text").alias("w")).collect()
        got = judge.probabilities(np.array([len(r.w) for r in texts]), pa.array([w for r in texts for w in r.w], pa.string()))
        assert len(want) == len(got) > 1000 and max(abs(x - y) for r, p in zip(texts, got, strict=True) for x, y in zip(want[r.doc], p, strict=True)) < 1e-9
    found = {r.doc: r for r in classify.predict(model, rows.unionByName(spark.createDataFrame([("n", None)], "doc string, text string"))).collect()}
    assert all(r.confidence == round(max(want[d]), 6) or not (r.text or "").strip(" ") for d, r in found.items() if d != "n")
    assert [tuple(found[d])[2:] for d in "an"] == [("UNKNOWN", 0.0, "empty_text")] * 2


def test_judging_pages_leaves_no_ngrams_in_the_plan(spark):
    plan = catalog.queries()["page_classifier"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan and "WindowGroupLimit" not in plan
