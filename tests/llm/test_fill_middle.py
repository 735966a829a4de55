"""Fill-in-the-middle against a plain cut at regular-expression matches; chunk borders, odd texts and columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    x, y, z = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(tokens), form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


def odd_text(rng):
    return "".join(rng.choice(["a", "é", "漢", "😀", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\xa0", "<", "P>", "<S", ">", " "]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_cuts_do_not_depend_on_chunks(chunk):
    rng = random.Random(chunk)
    texts = [odd_text(rng) for _ in range(300)] + [None, "", " ", "\n\n", "a", "a ", " a"]
    u, v = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    n, prefix, middle = fill_middle.cuts(pa.array(texts), u, v, np.ones(len(texts), bool), chunk)
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text or "")
        a, b = sorted((u[i] % (len(tokens) + 1), v[i] % (len(tokens) + 1)))
        assert (n[i], prefix[i], middle[i]) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[a:b])))


def test_whole_tables_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, odd_text(rng)) for i in range(400)] + [(None, "x y z"), (None, None), (7, None), (8, "same text here"), (8, "same text here"), (9, "has <P> in it"), (10, "<S"), (11, "  ")]
    rows.append((12, "".join(rng.choice(["wort ", "é\n", "  ", "漢字 ", "x"]) for _ in range(900_000))))  # several windows of chunks
    rows.append((14, "y" * 3_000_000))
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, form string, digest int")
    got = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored())
    assert got.columns == ["doc_id", "text", "digest", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    out = got.collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out], key=key) == sorted([brute(*r) for r in rows], key=key)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "spm", "psm"}


def test_shares_follow_the_parameters(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    forms = {r.form: r["count"] for r in fill_middle.fill_in_middle(df, percent=90, spm_percent=10).groupBy("form").count().collect()}
    assert 140 < forms["plain"] < 260 and 110 < forms["spm"] < 250
    assert {r.form for r in fill_middle.fill_in_middle(df, percent=0).collect()} == {"plain"}


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
