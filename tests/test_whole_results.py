"""Queries that must give the whole result, against plain Python on small fixtures."""

from __future__ import annotations

import random

import pytest


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("chars", [None, 150])
def test_offline_answers(spark, tmp_path, monkeypatch, chars):
    """Also when the questions are too long for one pass over the passages."""
    from dossierlake.operators import retrieval
    from dossierlake.plans.ops_queries import offline_answers

    if chars:
        monkeypatch.setattr(retrieval, "ASKED_CHARS", chars)

    pick = random.Random(1)
    words = ["a", "the", "loan", "loans", "Salary", "ratio", "irrational", "policy", "POLICY-3", "éclair", "extraordinarily"]
    asked = [(i, " ".join(pick.choices(words, k=3))) for i in range(20)] + [(20, "a the"), (21, None), (22, "nowhere"), (23, "tabs\tand\nlines"), (3, "extra")]
    docs = [(i, pick.choice([" ", "\n", "\t"]).join(pick.choices(words, k=pick.randint(0, 4)))) for i in range(60)]
    docs += [(5, "a second text of tabs"), (None, "loan nowhere"), (60, None), (61, ""), (62, "xnowheres")]
    want = {}
    for item, text in asked:
        terms = [w for w in (text or "").lower().split() if len(w) > 3]
        held = {d for d, t in docs if d is not None and any(w in (t or "").lower() for w in terms)}
        want[item] = want.get(item, set()) | held
    got = offline_answers(spark, put(spark, tmp_path, benchmark=(asked, "item_id long, text string"), documents=(docs, "doc_id long, text string"))).collect()
    assert {r["item_id"]: (r["passages"], r["first"]) for r in got} == {k: (len(v), min(v)) for k, v in want.items() if v}
    assert want[22] == {62}


def test_sanitised_answers(spark, tmp_path):
    import re

    from dossierlake.operators import grounding
    from dossierlake.plans.text_queries import sanitised_answers

    texts = ["short", "a first line of more than forty characters [made_up_2] and more\nthe second [DOC-7] line\nthe third", "x" * 60 + "\n[other_1] [other_2]\n\nend of it", "", None]
    rows = [(i, t, x) for i in range(3) for t, x in enumerate(texts)]
    allowed = {"credit_policy_v1_p1", *grounding.POLICY_ALIASES["credit_policy_v1_p1"]}

    def judged(conv, text):
        if text is None:
            return "> ⚠️ [ABSTENTION: Summary empty or missing.]"
        out, dropped = [], False
        for line in (text + " [CHUNK-POLICY-SAL-02]\nsecond " + {0: "[credit_policy_v1_p1]", 1: "[made_up_1]", 2: ""}[conv]).split("\n"):
            bad = [c for c in dict.fromkeys(re.findall(grounding.CITATION, line)) if c not in allowed and not c.upper().startswith(tuple(grounding.EXEMPT))]
            out.append(f"> ⚠️ [UNGROUNDED CLAIM DROPPED - Unauthorized citations: {', '.join(bad)}]" if bad else line)
            dropped |= bool(bad)
        return "\n".join(out) + ("\n\n> ⚠️ [ABSTENTION: One or more claims were dropped due to lack of verified citation grounding.]" if dropped else "")

    got = sanitised_answers(spark, put(spark, tmp_path, conversations=(rows, "conv_id long, turn int, text string"))).collect()
    assert {(r["conv_id"], r["turn"]): r["answer"] for r in got} == {(c, t): judged(c, x) for c, t, x in rows}


def test_history_merge(spark, tmp_path):
    from datetime import datetime, timedelta

    from dossierlake.plans.ops_queries import history_merge

    pick = random.Random(2)
    rows = [(i, pick.choice([1, 2, 3, 4]), pick.choice("abcdef"), datetime(2024, 1, 1) + timedelta(hours=pick.randint(0, 40))) for i in range(60)] + [(60, 5, "a", datetime(2024, 1, 1)), (61, None, "b", datetime(2024, 1, 1))]
    want = {}
    for user in {r[1] for r in rows}:
        kinds = [r[2] for r in sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0]))]
        want[user] = ",".join(kinds[:3] + [k for k in kinds[3:] if k not in kinds[:3]])
    got = history_merge(spark, put(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string, ts timestamp"))).collect()
    assert {r["user_id"]: r["history"] for r in got} == want


def test_term_df(spark, tmp_path):
    from dossierlake.plans.text_queries import term_df

    docs = [(1, "One word, one MORE"), (2, "more of it"), (3, ""), (4, None)]
    got = term_df(spark, put(spark, tmp_path, documents=(docs, "doc_id long, text string"))).collect()
    assert {r["term"]: r["df"] for r in got} == {"one": 1, "word": 1, "more": 2, "of": 1, "it": 1}


def test_rrf_fusion_ranks_by_vectors(spark, tmp_path):
    import math
    from collections import Counter

    from dossierlake.plans.retrieval_queries import rrf_fusion

    pick = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(pick.choices(words, [1 / (j + 1) for j in range(300)], k=pick.randint(20, 60)) + ["the", "and"])) for i in range(60)]
    asked = [(i, " ".join(pick.choices(words[:60], k=4)) + " the and the") for i in range(6)] + [(6, " "), (7, "unheard")]
    terms = {d: [w for w in t.split() if w not in ("the", "and")] for d, t in docs}
    total = Counter(w for ws in terms.values() for w in ws)
    kept = sorted(total, key=lambda w: (-total[w], w))[:256]
    idf = {w: math.log(61 / (1 + sum(w in ws for ws in terms.values()))) + 1 for w in kept}

    def unit(ws):
        v = {w: n * idf[w] for w, n in Counter(ws).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    held = {d: unit(ws) for d, ws in terms.items()}
    ranks = {}
    for item, text in asked:
        q = unit(text.split())
        order = sorted(held, key=lambda d: (-round(sum(x * held[d].get(w, 0) for w, x in q.items()), 6), d))[:15]
        ranks |= {(item, d): n for n, d in enumerate(order, 1)} if text.strip() else {}
    got = rrf_fusion(spark, put(spark, tmp_path, benchmark=(asked, "item_id long, text string"), documents=(docs, "doc_id long, text string"))).collect()
    assert all(r["dense_rank"] == ranks.get((r["item_id"], r["doc_id"])) for r in got)
    assert Counter(r["item_id"] for r in got) == dict.fromkeys([0, 1, 2, 3, 4, 5, 7], 5)
    assert any(r["lex_rank"] is not None and r["dense_rank"] is not None for r in got)
