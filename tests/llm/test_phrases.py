"""Collocations against a plain count over n-grams, by broadcast names and by joins."""

from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from dossierlake.llm import phrases


def brute(rows, max_words, least, cover, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    found = []
    for (lang, g), a in candidates.items():
        inside = lambda t: any(t[i : i + len(g)] == g for i in range(len(t) - len(g) + 1))  # noqa: E731, B023
        if any(x == lang and len(t) > len(g) and 100 * b >= cover * a and inside(t) for (x, t), b in candidates.items()):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, g[:i]] * f[lang, g[i:]]), i, f[lang, g[:i]], f[lang, g[i:]]) for i in range(1, len(g)))
        found.append((lang, -score, -a, " ".join(g).encode(), l, r, n[lang]))
    out, rank = [], Counter()
    for lang, s, a, p, l, r, m in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, m, -s))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "new", "York", "city", "é", "É", "漢", "x\xa0y", "-", "of", "the", "<br>", "d\x85e"]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", ".", "\n", "\t", "!", "\r x"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "en"])) for _ in range(150)]
    rows += [("new York city " * 40, "fr")] * 3 + [(None, "en"), ("", None), (" .,; ", "xx"), ("the", "yy"), ("one two three four five", "zz")]
    return rows + [("same thing here. " * 5, "en")] * 4


@pytest.mark.parametrize("bound", [phrases.NAME_BOUND, 0, 12])
@pytest.mark.parametrize("max_words,least,cover,top", [(3, 10, 50, 2000), (5, 3, 80, 7), (2, 1, 50, 30)])
def test_equals_brute_force(spark, bound, max_words, least, cover, top):
    rows = corpus(max_words)
    df = spark.createDataFrame([(*r, 1, "left") for r in rows], "text string, lang string, name int, left string").repartition(3)
    got = phrases.collocations(df, max_words=max_words, least=least, cover_percent=cover, top=top, name_bound=bound)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, max_words, least, cover, top)


def test_one_very_long_text(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdefg") for _ in range(800_000)), "en")]
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 10, 50, 2000)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_more_phrases_than_the_bound_make_no_rows_of_places(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(400)), rng.choice(["en", "de"])) for _ in range(60)]
    monkeypatch.setattr(phrases, "_by_joins", lambda *_: pytest.fail("places became rows"))
    monkeypatch.setattr(phrases, "PART_BYTES", 5_000)
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=5, name_bound=40)  # 40 words, over 700 pairs
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 5, 50, 2000)


def runs(rows, known, filters, k, bits):
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], ["text", "lang"])
    got = [c for c in phrases._gram_keys(SimpleNamespace(value=known), [SimpleNamespace(value=f) for f in filters], k, bits)([batch])]
    return [np.concatenate(c) for c in zip(*got, strict=True)]


def test_keys_of_several_columns_and_a_filter_that_lets_all_through(monkeypatch):
    rows = [("a b c d a b c. d c b a, a a a a a", "en"), ("b a d c b a d", "de")]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], ["text", "lang"])
    known = np.unique(np.concatenate([c[0] for c in phrases._word_keys([batch])]))
    full = np.full(16, -1, np.int64).view(np.uint64)
    want = Counter(zip(*[c.tolist() for c in runs(rows, known, [full] * 3, 4, 3)], strict=True))
    assert all(len(x) == 1 for x in want) and sum(want.values()) == 4 + 1 + 2 + 4
    monkeypatch.setattr(phrases, "KEY_BITS", 6)
    assert {(x << 6 | y): n for (x, y), n in Counter(zip(*[c.tolist() for c in runs(rows, known, [full] * 3, 4, 3)], strict=True)).items()} == {x: n for (x,), n in want.items()}
    assert not len(runs(rows, known, [np.zeros(16, np.uint64), full, full], 4, 3)[0])


def test_blocks_keep_every_count_and_are_small(monkeypatch):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 40, 50_000)
    pairs = [[rng.integers(-(1 << 63), 1 << 63, 500), rng.integers(0, 3, 500)] for _ in range(3)]
    for runs_, held in (([[k] for k in np.split(keys, 10)] * 2, 1 << 20), ([[k] for k in np.split(keys, 10)] * 2, 9_000), (pairs * 2, 700)):
        monkeypatch.setattr(phrases, "HELD", held)
        got, size = Counter(), 0
        for batch in phrases._blocks(iter(runs_), 7):
            for part, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                *columns, n = phrases._unpack(body, len(runs_[0]))
                assert (phrases._hash(columns) % np.uint64(7) == part).all()
                size += len(pa.compress(body, "lz4_raw", asbytes=True))
                for key, many in zip(zip(*[c.tolist() for c in columns], strict=True), n.tolist(), strict=True):
                    got[key] += many
        assert got == Counter(x for c in runs_ for x in zip(*[y.tolist() for y in c], strict=True))
        if held == 1 << 20:
            assert size < 5 * len(got)


def test_words_of_one_key_are_told_apart(monkeypatch):
    real = phrases.tn.word_hashes
    lengths = lambda data, starts, ends: (ends - starts).astype(np.uint64) if (data < 128).all() else real(data, starts, ends)
    monkeypatch.setattr(phrases.tn, "word_hashes", lengths)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two one three"]), pa.array(["en"])], ["text", "lang"])
    known = np.unique(next(phrases._word_keys([batch]))[0])
    rows = [r for b in phrases._word_texts(SimpleNamespace(value=known))([batch]) for r in b.to_pylist()]
    assert sorted(r["word"] for r in rows if r["word"]) == ["one", "three", "two"]
    assert len({r["name"] for r in rows if r["word"] in ("one", "two")}) == 1
    assert [(r["lang"], r["n"]) for r in rows if r["word"] is None] == [("en", 4)]
