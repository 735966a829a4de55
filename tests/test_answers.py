"""Answers, abstentions and refusals over two scopes."""

from __future__ import annotations

from dossierlake.operators import answers


def test_every_question_has_a_row(spark):
    make = spark.createDataFrame
    questions = make([(1, "a", "net  pay\nof March"), (2, "b", "net pay"), (3, "a", " "), (4, "a", "x" * 1001), (5, "c", "net pay"), (6, "a", None)], "question_id int, app string, question string")
    columns = "chunk_id string, document_id string, page_number int, text string"
    dossiers = make([("p1", "D1", 1, "net pay is 5 " + "y" * 400, "a"), ("p2", "D1", 2, "of March", "a"), ("p3", "D2", 1, "net pay of b", "b")], columns + ", app string")
    findings = make([("c", 2, "R2", "Two", "pass", "fine"), ("c", 1, "R1", "One", "flag", "not fine")], "app string, seq int, rule_id string, rule_name string, verdict string, reason string")
    hits = answers.scoped_passages(questions, make([], columns), dossiers, stop=[])
    got = {r.question_id: r for r in answers.answers(questions, hits, findings).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "answered", 2: "answered", 3: "refused", 4: "refused", 5: "answered", 6: "refused"}
    first = got[1].answer.split("\n")
    assert first[0] == "Top passages relevant to: net pay of March (2 from dossier, 0 from policy)" and set(got[1].cited) == {"p1", "p2"}
    assert any(line.endswith("] (Document D1) net pay is 5 " + "y" * 387 + "...") for line in first)
    assert got[2].cited == ["p3"]  # another application's passages stay unseen
    assert got[5].answer.split("\n") == [answers.FINDINGS, "- [R1] One (verdict=flag): not fine", "- [R2] Two (verdict=pass): fine"] and got[5].cited == ["R1", "R2"]
    evidence = make([("c", "R1", "D9"), ("a", "R1", "D1")], "app string, rule_id string, document_id string")
    assert [tuple(r) for r in answers.cited_evidence(answers.answers(questions, hits, findings), evidence).collect()] == [(5, "c", "R1", "D9")]
    alone = answers.answers(questions.filter("question_id = 5"), hits, findings.limit(0)).collect()
    assert [(r.status, r.answer, r.cited) for r in alone] == [("abstained", answers.ABSTAINED, [])]
    assert answers.answers(questions.limit(0), hits, findings).collect() == []
