"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's features are its character n-grams (two and three bytes,
with borders), its affixes (first and last two to four bytes) and its entry in a lexicon of words that the training
texts of one language use far more than the others. Transitions between the labels of neighbouring words are learned
too, on chains that splice runs of words of different languages (code-switching). Forward-backward gives each word's
label probabilities; a document's language has the largest share of them over all its words that hold letters.

A chain is a run of up to ``CHAIN`` words of a text; all chains of all texts are labelled (whole texts, no prefix).
Fitting takes a bounded sample of the labelled rows (``fit_rows``, those with the smallest hash of the id) in one
task. Only text and lang of those rows teach; a prediction sees the text alone.

Defined results: null texts, empty ones and those without a letter get ``und`` and score 0; a document's score is its
language's share; ties go to the language that sorts first; without labelled rows everything is ``und``. Null ids are
scored as others. Repeated rows are scored each, very long texts whole; an empty table gives no rows. A column of the
input that is called as a result is replaced by it (``with_language``); ``languages`` returns the id and its results only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import fitted, schema_with, scratch

CHAIN = 256
#: Forms of words whose features are worked out at once.
FORMS = 1 << 15
GRAM_BITS, AFFIX_BITS, LEXICON = 15, 14, 20_000
UNDETERMINED = "und"
_U = np.uint64


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words, their values, and each word's first; n-grams share a weight of one, affixes too."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)
    length = ends - starts
    size = length + 2
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    word = np.repeat(np.arange(n), size)
    place = np.arange(begin[-1]) - begin[word]
    at = np.clip(starts[word] + place - 1, 0, len(data) - 1)
    b = data[at].astype(_U) + _U(2)
    b[begin[:-1]] = 0
    b[begin[1:] - 1] = 1
    b1 = np.append(b[1:], _U(0))
    b2 = np.append(b[2:], [_U(0), _U(0)])
    two = _hash(b * _U(257) + b1 + _U(1 << 20), GRAM_BITS)
    three = _hash((b * _U(257) + b1) * _U(257) + b2 + _U(1 << 30), GRAM_BITS)
    has_two, has_three = place < size[word] - 1, place < size[word] - 2
    # affixes: prefixes and suffixes of up to four bytes with the border, numbered by kind and length
    affixes = []
    for k in (3, 4, 5):
        for kind in (0, 1):
            first = begin[:-1] if kind == 0 else begin[1:] - k
            ok = size >= k
            x = np.full(n, 7 + 2 * k + kind, _U)
            for j in range(k):
                x = x * _U(1_000_003) + b[np.clip(first + j, 0, len(b) - 1)]
            affixes.append((np.flatnonzero(ok), _hash(tn.mix(x), AFFIX_BITS)[ok] + (1 << GRAM_BITS)))
    grams = size - 1 + np.maximum(size - 2, 0)
    words = np.concatenate([word[has_two], word[has_three], *[w for w, _ in affixes]])
    ids = np.concatenate([two[has_two], three[has_three], *[i for _, i in affixes]])
    value = np.concatenate([(1 / grams[word[has_two]]), (1 / grams[word[has_three]]), *[np.full(len(w), 0.25) for w, _ in affixes]]).astype(np.float32)
    order = np.argsort(words, kind="stable")
    return ids[order].astype(np.int32), value[order], np.searchsorted(words[order], np.arange(n + 1))


class Words:
    """The words of a slice, their unique forms and the features of those."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = tn.LOWER[data]
        self.starts, self.ends, self.first = tn.word_bounds(data, off)
        hashes = tn.word_hashes(data, self.starts, self.ends)
        self.unique, at, self.form = np.unique(hashes, return_index=True, return_inverse=True)
        parts = [word_features(data, self.starts[a], self.ends[a]) for a in (at[i : i + FORMS] for i in range(0, max(1, len(at)), FORMS))]
        self.ids, self.value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 128) | ((data >= 97) & (data <= 122)), out=letters[1:])
        self.lettered = letters[self.ends] > letters[self.starts]

    def lexicon(self, known: np.ndarray) -> np.ndarray:
        """The place of each unique form in the sorted lexicon, or its length."""
        if not len(known):
            return np.zeros(len(self.unique), np.int64)
        at = np.minimum(np.searchsorted(known, self.unique), len(known) - 1)
        return np.where(known[at] == self.unique, at, len(known))

    def emissions(self, w: dict) -> np.ndarray:
        """The label scores of all words."""
        if not len(self.unique):
            return np.zeros((0, w["trans"].shape[0]), np.float32)
        e = np.add.reduceat(w["feat"][self.ids] * self.value[:, None], self.begin[:-1])
        e += w["lex"][self.lexicon(w["known"])]
        return e[self.form]


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all texts' runs of up to CHAIN words."""
    words = np.diff(first)
    per = -(-words // CHAIN)
    text = np.repeat(np.arange(len(words)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = first[text] + k * CHAIN
    return start, np.minimum(CHAIN, first[text + 1] - start)


def forward_backward(e: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Label probabilities of all words and, if asked for, the expected number of label pairs, and the log likelihood's normaliser."""
    labels = e.shape[1]
    if not len(start):
        return np.zeros_like(e), np.zeros((labels, labels)), 0.0
    top = e.max(1, keepdims=True)
    x = np.exp(e - top)
    a, scale = np.zeros_like(x), np.ones(len(x), np.float32)
    t = np.exp(trans).astype(np.float32)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    prev = None
    for i, m in enumerate(live):
        at = start[:m] + i
        cur = x[at] if prev is None else (prev[:m] @ t) * x[at]
        z = cur.sum(1)
        cur = cur / z[:, None]
        a[at], scale[at] = cur, z
        prev = cur
    beta, post, expected = np.ones((len(start), labels), np.float32), np.zeros_like(x), np.zeros((labels, labels))
    for i in range(len(live) - 1, -1, -1):
        m = live[i]
        at = start[:m] + i
        post[at] = a[at] * beta[:m]
        if i:
            back = beta[:m] * x[at] / scale[at][:, None]
            if pairs:
                expected += t * (a[at - 1].T @ back)
            beta[:m] = back @ t.T
    norm = float(np.log(scale).sum() + top.sum()) if pairs else 0.0
    return post / np.maximum(post.sum(1, keepdims=True), 1e-30), expected, norm


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, chains_a_step: int = 64) -> dict | None:
    """Weights by AdaGrad on the conditional log likelihood of spliced chains; the same data gives the same weights."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(5)
    label_of = {x: i for i, x in enumerate(names)}
    forms, first, ids, value, size, unique = [], [0], [], [], [], []
    for _, _, data, off in tn.slices(pa.array(texts, pa.string())):
        w = Words(data, off)
        forms.append(w.form + sum(map(len, unique)))
        first += (w.first[1:] + first[-1]).tolist()
        for to, x in ((ids, w.ids), (value, w.value), (size, np.diff(w.begin)), (unique, w.unique)):
            to.append(x)
    # one entry a form over all slices
    hashes, at, merged = np.unique(np.concatenate(unique), return_index=True, return_inverse=True)
    form = merged[np.concatenate(forms)]
    all_ids, all_values, sizes = np.concatenate(ids), np.concatenate(value), np.concatenate(size)
    ends = np.cumsum(sizes)
    lens = sizes[at]
    begin = np.concatenate([[0], np.cumsum(lens)])
    rows = np.arange(begin[-1]) + np.repeat(ends[at] - lens - begin[:-1], lens)
    feat_ids, feat_values = all_ids[rows], all_values[rows]
    del ids, value, all_ids, all_values, rows, forms, merged
    y = np.repeat([label_of[x] for x in langs], np.diff(first))
    n, k = len(y), len(names)
    # lexicon: words seen at least three times of which one language has nine in ten, the most frequent first
    counts = np.stack([np.bincount(form[y == c], minlength=len(hashes)) for c in range(k)], 1).astype(float)
    freq = counts / np.maximum(counts.sum(0), 1)
    good = np.flatnonzero((counts.sum(1) >= 3) & (freq.max(1) >= 0.9 * freq.sum(1)))
    good = good[np.argsort(-counts.sum(1)[good], kind="stable")[:LEXICON]]
    known = np.sort(hashes[good])
    w = {"feat": np.zeros(((1 << GRAM_BITS) + (1 << AFFIX_BITS), k), np.float32), "lex": np.zeros((len(known) + 1, k), np.float32), "trans": np.zeros((k, k), np.float32), "known": known, "names": names}
    if not n:
        return w
    place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    lex = np.where(known[place] == hashes, place, len(known)) if len(known) else np.zeros(len(hashes), np.int64)
    # splice: runs of 4 to 60 words of one text each, in random order
    cuts, i = [], 0
    while i < n:
        cuts.append(i)
        i += int(rng.integers(4, 60))
    cuts = np.array([*cuts, n])
    seen = {name: np.full_like(w[name], 1e-2) for name in ("feat", "lex", "trans")}
    for _ in range(epochs):
        order = rng.permutation(len(cuts) - 1)
        spliced = np.concatenate([np.arange(cuts[j], cuts[j + 1]) for j in order])
        for i in range(0, n, CHAIN * chains_a_step):
            pick = spliced[i : i + CHAIN * chains_a_step]
            start, length = chains(np.array([0, len(pick)]))
            some, inv = np.unique(form[pick], return_inverse=True)
            lens = begin[some + 1] - begin[some]
            b = np.concatenate([[0], np.cumsum(lens)])
            rows = np.arange(b[-1]) + np.repeat(begin[some] - b[:-1], lens)
            ids, value = feat_ids[rows], feat_values[rows]
            e = (np.add.reduceat(w["feat"][ids] * value[:, None], b[:-1]) + w["lex"][lex[some]])[inv]
            post, expected, _ = forward_backward(e.astype(np.float32), start, length, w["trans"], True)
            post[np.arange(len(pick)), y[pick]] -= 1
            by_form = np.stack([np.bincount(inv, post[:, c], len(some)) for c in range(k)], 1)
            inner = np.ones(len(pick), bool)
            inner[start] = False
            at = np.flatnonzero(inner)
            np.add.at(expected, (y[pick[at - 1]], y[pick[at]]), -1)
            spread = np.repeat(by_form, lens, axis=0) * value[:, None]
            grads = {"feat": np.stack([np.bincount(ids, spread[:, c], len(w["feat"])) for c in range(k)], 1), "lex": np.stack([np.bincount(lex[some], by_form[:, c], len(known) + 1) for c in range(k)], 1), "trans": expected}
            grads["lex"][-1] = 0
            for name, g in grads.items():
                g = (g / chains_a_step + 1e-5 * w[name]).astype(np.float32)
                seen[name] += g * g
                w[name] -= rate * g / np.sqrt(seen[name])
    return w


def predict(w: dict | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = [], []
    for a, b, data, off in tn.slices(texts):
        if w is None:
            names += [UNDETERMINED] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        words = Words(data, off)
        post, _, _ = forward_backward(words.emissions(w).astype(np.float32), *chains(words.first), w["trans"])
        k = len(w["names"])
        total = np.zeros((len(post) + 1, k))
        np.cumsum(np.where(words.lettered[:, None], post, 0), axis=0, out=total[1:])
        share = total[words.first[1:]] - total[words.first[:-1]]
        share = share / np.maximum(share.sum(1, keepdims=True), 1e-12)
        best = np.round(share, 9).argmax(1)
        ascii_letters = np.add.reduceat(np.append(((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)), False), off[:-1]) * (np.diff(off) > 0)
        for i in range(b - a):
            if not ascii_letters[i] and not any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode(errors="replace")):
                names.append(UNDETERMINED)
                share[i] = 0
            else:
                names.append(w["names"][best[i]])
        scores.append(np.clip(share[np.arange(b - a), best], 0, 1))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def label_runs(w: dict | None, texts: pa.Array) -> Iterator[tuple]:
    """For each slice of texts: its first text, and each run's text, first word, words, language and mean probability of its label."""
    for a, b, data, off in tn.slices(texts):
        words = Words(data, off)
        if w is None or not len(words.starts):
            continue
        post, _, _ = forward_backward(words.emissions(w).astype(np.float32), *chains(words.first), w["trans"])
        best = np.round(post, 9).argmax(1)
        text = np.repeat(np.arange(b - a), np.diff(words.first))
        at = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1])))
        size = np.diff(np.append(at, len(best)))
        mean = np.add.reduceat(post[np.arange(len(best)), best].astype(np.float64), at) / size
        yield a, text[at], at - words.first[text[at]], size, [w["names"][i] for i in best[at]], mean


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 800) -> dict | None:
    """Weights from the ``fit_rows`` rows with a lang whose id's hash is smallest."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang")).filter("id is not null and lang is not null").select("id").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null").join(F.broadcast(ids), "id")
    got = scratch(rows, "fit").orderBy("id", F.xxhash64("text"), "lang").limit(2 * fit_rows)
    return fitted(got, lambda t: fit(t["text"].to_pylist(), t["lang"].to_pylist()))


def languages(docs: DataFrame, weights: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)  # bounded by the numbers of features, languages and lexicon entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                names, scores = predict(sent.value, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, weights: dict | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the language and its score, in place of columns of those names."""
    spark = docs.sparkSession
    docs = docs.drop(lang_col, score_col)
    sent = spark.sparkContext.broadcast(weights)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                names, scores = predict(sent.value, batch.column(where))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, lang_col, score_col])

    return docs.mapInArrow(run, schema_with(docs, **{lang_col: "string", score_col: "double"}))


def language_runs(docs: DataFrame, weights: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words, lang, score): the runs of neighbouring words of one language, which tile every whole text.

    Words are counted from 0; score is the mean probability of the label, which a word without letters gets from its neighbours.
    Texts without words, null ones among them, have no runs, and neither has anything where no language was learned; repeated rows have theirs each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, text, first, size, names, mean in label_runs(sent.value, batch.column(1)):
                    columns = [batch.column(0).take(pa.array(text + a)), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(names, pa.string()), pa.array(mean)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "first_word", "n_words", "lang", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, first_word long, n_words long, lang string, score double").withColumnRenamed("id", id_col)
