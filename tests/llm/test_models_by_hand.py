"""Scores of the fitted models recomputed word by word, gradients by differences, runs of code-switched words."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa

from dossierlake.llm import crf_langid, quality_mil, toxicity
from dossierlake.llm import textnum as tn

WORD = re.compile(rb"[^\x20\t-\r]+")
TEXTS = ["One Short text.", "", "  \n", "Ünïcödé words, and 42 numbers; " * 30, " ".join(f"w{i % 37} The end." for i in range(400))]
EN, ES = "the cat and the dog of it was with this house".split(), "el perro que la casa de los con una pero muy".split()


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def word_hash(word):
    return int(tn.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def passage_features(words):
    """Of a passage's words, by the definition in the module."""
    raw = b"".join(words)
    is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    x = np.zeros(quality_mil.WIDTH)
    for c in raw:
        x[c] += 1 / len(raw)
    seen = set()
    for w in words:
        bucket = (word_hash(lower(w)) >> 40) % quality_mil.WORD_BUCKETS
        x[256 + bucket] += 1 / len(words)
        seen.add(bucket)
    x[: 256 + quality_mil.WORD_BUCKETS] **= 0.5
    n, size, letters = len(words), len(raw), sum(map(is_letter, raw))
    x[-6:] = [
        math.log1p(n) / 5, math.log1p(size / max(n, 1)) / 3, letters / max(size, 1), sum(65 <= c <= 90 for c in raw) / max(letters, 1),
        sum(not is_letter(w[-1]) for w in words) / max(n, 1), len(seen) / max(min(n, quality_mil.WORD_BUCKETS), 1),
    ]
    return x if words else np.zeros(quality_mil.WIDTH)


def by_hand(w, text):
    words = WORD.findall(text.encode())
    bag = [passage_features(words[i : i + quality_mil.PASSAGE]) for i in range(0, max(1, len(words)), quality_mil.PASSAGE)]
    hidden = [np.tanh((x - w["mean"]) * w["scale"] @ w["W"] + w["b"]) for x in bag]
    gates = [np.exp((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]) for h in hidden]
    z = sum(g * h for g, h in zip(gates, hidden, strict=True)) / sum(gates)
    return 1 / (1 + math.exp(-(z @ w["c"] + w["d"])))


def bags(seed=2, n=60):
    rng = np.random.default_rng(seed)
    begin = np.concatenate([[0], np.cumsum(rng.integers(1, 5, n))])
    return rng.random((begin[-1], quality_mil.WIDTH)).astype(np.float32), begin, (np.arange(n) % 2).astype(np.float32)


def test_quality_word_by_word(spark):
    w = quality_mil.fit(*bags(), epochs=3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_mil.score_only(docs, w).collect()}
    assert all(abs(got[i] - by_hand(w, t)) < 1e-4 for i, t in enumerate(TEXTS))
    assert len({round(s, 3) for s in got.values()}) > 2


def test_quality_gradient_by_differences():
    """The first step of the fit goes down along every weight whose difference quotient isn't tiny."""
    x, begin, y = bags()
    start, after = quality_mil.fit(x, begin, y, epochs=0), quality_mil.fit(x, begin, y, epochs=1, decay=0.0)
    start, after = ({k: np.asarray(v, np.float64) for k, v in w.items()} for w in (start, after))

    def loss(w):
        q = quality_mil.score(w, x.astype(np.float64), begin)
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    rng, judged = random.Random(4), 0
    for name in ("W", "b", "V", "U", "a", "c", "d"):
        for _ in range(40):
            at = tuple(rng.randrange(s) for s in start[name].shape)
            quotient = 0.0
            for sign in (1, -1):
                moved = start[name].copy()
                moved[at] += sign * 1e-4
                quotient += sign * loss(start | {name: moved}) / 2e-4
            if abs(quotient) > 1e-5:
                judged += 1
                assert np.sign(start[name][at] - after[name][at]) == np.sign(quotient), (name, at, quotient)
    assert judged > 100


def emission(w, word):
    """The label scores of a word: n-grams, affixes, lexicon."""
    b = [0, *[c + 2 for c in lower(word)], 1]
    hashed = lambda v, bits: (v * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)
    grams = [hashed(b[i] * 257 + b[i + 1] + (1 << 20), 15) for i in range(len(b) - 1)]
    grams += [hashed((b[i] * 257 + b[i + 1]) * 257 + b[i + 2] + (1 << 30), 15) for i in range(len(b) - 2)]
    e = sum(w["feat"][g].astype(float) for g in grams) / len(grams)
    for k in (3, 4, 5):
        for kind, part in ((0, b[:k]), (1, b[-k:])):
            if len(b) >= k:
                v = 7 + 2 * k + kind
                for c in part:
                    v = (v * 1_000_003 + c) % 2**64
                e = e + 0.25 * w["feat"][(1 << 15) + hashed(int(tn.mix(np.array([v], np.uint64))[0]), 14)]
    known = w["known"].tolist()
    h = word_hash(lower(word))
    return e + w["lex"][known.index(h) if h in known else len(known)]


def language_by_hand(w, text):
    words, share = WORD.findall(text.encode()), np.zeros(len(w["names"]))
    t = np.exp(w["trans"].astype(float))
    for i in range(0, len(words), crf_langid.CHAIN):
        run = words[i : i + crf_langid.CHAIN]
        x = [np.exp(emission(w, v)) for v in run]
        forth, back = [x[0] / x[0].sum()], [np.ones(len(share))]
        for v in x[1:]:
            forth.append((forth[-1] @ t) * v)
            forth[-1] /= forth[-1].sum()
        for v in x[:0:-1]:
            back.insert(0, t @ (v * back[0]))
            back[0] /= back[0].sum()
        for f, g, v in zip(forth, back, run, strict=True):
            if any(97 <= c <= 122 or c >= 128 for c in lower(v)):
                share += f * g / (f * g).sum()
    return w["names"][int(share.argmax())], share.max() / share.sum()


def learned():
    rng = random.Random(9)
    return crf_langid.fit([" ".join(rng.choices(EN if i % 2 else ES, k=30)) for i in range(120)], ["en" if i % 2 else "es" for i in range(120)])


def test_language_word_by_word():
    with np.errstate(over="ignore"):
        w, rng = learned(), random.Random(1)
        texts = ["The DOG", "la casa 42 !", " ".join(rng.choices(EN + ES, k=700)), "mañana über alles xyz", "q"]
        names, scores = crf_langid.predict(w, pa.array(texts))
        for text, name, score in zip(texts, names, scores, strict=True):
            want, share = language_by_hand(w, text)
            assert name == want and abs(score - share) < 1e-3


def test_runs_of_switched_languages(spark):
    """Texts spliced of two languages: nearly all words get their own, and the runs tile every text, one of over 1 MB too."""
    rng, docs, truth = random.Random(6), [(900, None), (901, " "), (902, "the the")], {902: ["en"] * 2}
    for i in range(30):
        parts = [(name, rng.choices(EN if name == "en" else ES, k=rng.randint(8, 30))) for name in rng.sample(["en", "es"], 2)]
        truth[i] = [name for name, part in parts for _ in part]
        docs.append((i, " ".join(v for _, part in parts for v in part)))
    truth[950] = ["es"] * 260_000
    docs.append((950, " ".join(rng.choices(ES, k=260_000))))
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string")
    assert len(docs[-1][1]) > 1_000_000
    with np.errstate(over="ignore"):
        runs = crf_langid.language_runs(df, learned()).collect()
    right = {i: 0 for i in truth}
    tiles = {i: [] for i in truth}
    for r in runs:
        at = range(r["first_word"], r["first_word"] + r["n_words"])
        tiles[r["doc_id"]].append((at.start, at.stop))
        right[r["doc_id"]] += sum(truth[r["doc_id"]][k] == r["lang"] for k in at)
        assert 0 < r["score"] <= 1.0001
    for i, spans in tiles.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(truth[i]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(right.values()) > 0.97 * sum(map(len, truth.values()))
    assert sum(right[i] for i in range(30)) > 0.95 * sum(len(truth[i]) for i in range(30))
    assert crf_langid.language_runs(df, None).count() == 0 and crf_langid.language_runs(df.limit(0), learned()).count() == 0


def chain_by_hand(chain, text):
    """Each category's probability, from a document's distinct words and word beginnings."""
    plain = lower(bytes(32 if 33 <= c < 127 and not chr(c).isalnum() else c for c in text.encode()))
    seen = set()
    for w in WORD.findall(plain):
        seen.add(word_hash(w))
        with np.errstate(over="ignore"):
            seen |= {int(tn.mix(np.array([word_hash(w[:n])], np.uint64) + np.uint64(n))[0]) for n in toxicity.BEGINNINGS if len(w) > n}
    found = []
    for model in chain:
        s = sum(float(model["w"][h >> (64 - toxicity.BITS)]) for h in seen) + sum(p * d for p, d in zip(found, model["dense"], strict=True)) + model["bias"]
        found.append(1 / (1 + math.exp(-s)))
    return found


def labelled_texts(n=240):
    """Clean texts, and toxic ones of two kinds whose words have endings."""
    pick = random.Random(9)
    texts, label = [], []
    for i in range(n):
        words = pick.choices("some plain words of every day, and a little more.".split(), k=12)
        if i % 3 == 0:
            words += pick.choices(["vermins", "Vermin!", "verminous"] if i % 2 else ["scummy", "SCUM", "scumbags"], k=4)
        texts.append(" ".join(words))
        label.append(float(i % 3 == 0))
    return texts, np.array(label)


def test_toxicity_chain_word_by_word(spark):
    texts, label = labelled_texts()
    with np.errstate(over="ignore"):
        parts = [toxicity.distinct_words(data, off) for _, _, data, off in tn.slices(pa.chunked_array([pa.array(texts)]))]
    ids, begin = np.concatenate([p[0] for p in parts]), np.concatenate([[0], *[p[1][1:] for p in parts]])
    chain = toxicity.fit_chain(ids, begin, np.column_stack([toxicity.kinds(ids, begin, label), label]))
    assert len(chain) == len(toxicity.CATEGORIES) and not any("constant" in m for m in chain)
    rows = list(enumerate([*texts[:40], *TEXTS, "x" * 5000 + " verminous"]))
    got = {r["doc_id"]: [r[c] for c in toxicity.CATEGORIES] for r in toxicity.probabilities(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    for i, text in rows:
        assert np.allclose(got[i], chain_by_hand(chain, text), atol=1e-5)
    assert all((got[i][-1] > 0.5) == (label[i] > 0) for i in range(40))


def test_earlier_probabilities_are_out_of_fold(monkeypatch):
    """With models that only know the share of the rows that they saw, each row's earlier probability is the share among the other folds."""
    n = 41
    y = np.column_stack([np.arange(n) % 2, np.arange(n) % 3 == 0]).astype(float)
    calls = []

    def fit(ids, begin, extra, y):
        calls.append((len(y), extra))
        return {"constant": float(y.mean())}

    monkeypatch.setattr(toxicity, "_fit_one", fit)
    toxicity.fit_chain(np.arange(n), np.arange(n + 1), y)
    fold = np.random.default_rng(3).permutation(n) % toxicity.FOLDS
    assert [c[0] for c in calls] == [n, *[int((fold != f).sum()) for f in range(toxicity.FOLDS)], n]
    want = [np.mean([y[j, 0] for j in range(n) if fold[j] != fold[i]]) for i in range(n)]
    assert np.allclose(calls[-1][1][:, 0], want)
