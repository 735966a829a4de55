"""What a document is, by given types, votes of its pages, and words, against plain Python."""

from __future__ import annotations

import random

from dossierlake.functions import text as T
from dossierlake.operators import classify

WORDS = ["payslip", "Salary", "bank", "statement", "tax", "itr", "PAN", "kyc", "idle", "form", "apple", "nothing", "here", "\n"]


def first_type(text):
    return next((name for name, words in T.TYPE_WORDS if any(w in text.lower() for w in words)), None)


def judged(text):
    counts = [sum((text or "").lower().count(w) for w in words) for _, words in T.TYPE_WORDS]
    best = max(counts)
    p = round(best / (best + 2), 6)
    return ("UNKNOWN" if p < 0.4 else T.TYPE_WORDS[counts.index(best)][0]), p


def by_hand(given, name, pages):
    """Type, confidence, method, triage, pages and first probability; ``pages`` in order."""
    full = [(t, *judged(t)) for t in pages if (t or "").strip()]
    if given:
        return given, None, "given", None, len(full), None
    votes = {}
    for _, label, p in full:
        if label != "UNKNOWN":
            votes.setdefault(label, []).append(p)
    if votes:
        best = max(votes, key=lambda v: round(sum(votes[v]), 9))  # the first of equals, as labels are kept by their first page
        return best, round(sum(votes[best]) / len(votes[best]), 4), "model", False, len(full), full[0][2]
    guess = first_type(" ".join([name, *[t for t, *_ in full]]))
    return guess or "unknown", 0.5 if guess else 0.0, "heuristic", True, len(full), None


def test_document_types(spark):
    pick = random.Random(5)
    docs, pages, want = [], [], {}
    for i in range(120):
        doc, place = f"{pick.choice(['d', 'scan', 'tax', 'kyc'])}-{i}", pick.choice([None, "s/x", "forms/x", "bank/x"])
        given = pick.choice([None, None, "unknown", "UNKNOWN", "payslip"])
        texts = [pick.choice([None, "", " \t", " ".join(pick.choices(WORDS, k=pick.randint(1, 9)))]) for _ in range(pick.randint(0, 4))]
        docs.append((doc, place, given))
        pages += [(doc, n, t) for n, t in enumerate(texts)]
        want[doc] = by_hand(given if given == "payslip" else None, f"{doc} {place or ''}", texts)
    docs += [(None, "bank", None), docs[0]]
    pages += [("of no document", 0, "bank bank bank"), (None, 0, "tax tax tax")]
    pick.shuffle(pages)
    files = spark.createDataFrame(docs, "doc string, place string, given string")
    told = classify.by_word_counts(spark.createDataFrame(pages, "doc string, page int, text string").repartition(3))
    got = {r["doc"]: tuple(r)[1:] for r in classify.document_types(files, told, "doc", "place", "given", "page", "text").collect()}
    assert got == want
    assert {w[2] for w in want.values()} == {"given", "model", "heuristic"} and any(w[0] == "unknown" for w in want.values())
    reasons = {r["text"]: r["reason"] for r in told.collect()}
    assert reasons[""] == "empty_text" and reasons["bank bank bank"] is None
    none = classify.document_types(files.limit(0), told.limit(0), "doc", "place", "given", "page", "text")
    assert none.count() == 0
