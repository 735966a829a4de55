"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words; whole texts, no prefix). Each passage becomes a feature
vector: shares of byte values, shares of hashed words, and a few measures of form. An encoder turns it into h = tanh(W x);
gated attention w . (tanh(V h) * sigmoid(U h)), softmaxed over the bag, weighs the passages; the score is the logistic of
a linear form of the weighted h. Document labels alone teach all weights.

Fitting takes a bounded sample of the labelled rows (``fit_rows``, those with the smallest hash of the id) in one
task; scoring takes every row. Labels, language, source and id are no inputs of a score.

Defined results: null or empty texts, and texts of white space, are a bag of one empty passage and get a score as any
other. Without labelled rows every score is 0.5; with one class alone, the score is 0.99 or 0.01. A row with a null id
gets held_out false. Repeated ids in the labels count as labelled rows each,
and so do repeated documents; among equal hashes the smaller id comes first. Very long texts are scored whole. An empty
table gives no rows. A column of the input that is called as the score is replaced by it; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import fitted, schema_with, scratch

PASSAGE = 128
WORD_BUCKETS = 256
SHAPES = 6
WIDTH = 256 + WORD_BUCKETS + SHAPES
HIDDEN, GATE = 32, 16


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a slice, and each text's first passage."""
    starts, ends, first = tn.word_bounds(data, off)
    words = np.diff(first)
    bags = np.maximum(1, -(-words // PASSAGE))
    begin = np.zeros(len(bags) + 1, np.int64)
    np.cumsum(bags, out=begin[1:])
    n = int(begin[-1])
    x = np.zeros((n, WIDTH), np.float32)
    if not len(starts):
        return x, begin
    text = np.repeat(np.arange(len(words)), words)
    passage = begin[text] + (np.arange(len(starts)) - first[text]) // PASSAGE
    length = ends - starts
    size = np.bincount(passage, length, n)
    count = np.bincount(passage, minlength=n)
    # Bytes of words, each with its word's passage.
    inside = np.repeat(passage, length)
    at = np.arange(len(inside)) + np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    x[:, :256] = np.bincount(inside * 256 + data[at], minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    lower = tn.LOWER[data]
    bucket = (tn.word_hashes(lower, starts, ends) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    hist = np.bincount(passage * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    x[:, 256 : 256 + WORD_BUCKETS] = hist / np.maximum(count, 1)[:, None]
    x[:, : 256 + WORD_BUCKETS] = np.sqrt(x[:, : 256 + WORD_BUCKETS])
    alpha = np.zeros(256, bool)
    alpha[65:91] = alpha[97:123] = alpha[128:] = True
    letters = np.bincount(inside, alpha[data[at]], n)
    capitals = np.bincount(inside, (data[at] >= 65) & (data[at] <= 90), n)
    odd_end = np.bincount(passage, ~alpha[data[ends - 1]], n)
    x[:, -6] = np.log1p(count) / 5
    x[:, -5] = np.log1p(size / np.maximum(count, 1)) / 3
    x[:, -4] = letters / np.maximum(size, 1)
    x[:, -3] = capitals / np.maximum(letters, 1)
    x[:, -2] = odd_end / np.maximum(count, 1)
    x[:, -1] = (hist > 0).sum(1) / np.maximum(np.minimum(count, WORD_BUCKETS), 1)
    return x, begin


def _forward(w: dict, x: np.ndarray, begin: np.ndarray):
    at = begin[:-1]
    h = np.tanh(((x - w["mean"]) * w["scale"]) @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["a"]
    bag = np.repeat(np.arange(len(at)), np.diff(begin))
    p = np.exp(e - np.maximum.reduceat(e, at)[bag])
    p = p / np.add.reduceat(p, at)[bag]
    z = np.add.reduceat(h * p[:, None], at)
    return 1 / (1 + np.exp(-(z @ w["c"] + w["d"]))), (h, t, s, p, z, bag)


def score(w: dict | None, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if "constant" in w:
        return np.full(len(begin) - 1, w["constant"])
    return _forward(w, x, begin)[0].astype(np.float64)


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, batch: int = 256) -> dict:
    """Adam on the log loss over bags; the same data gives the same weights."""
    if len(set(y.tolist())) < 2:
        return {"constant": 0.5 if not len(y) else 0.99 if y[0] else 0.01}
    rng = np.random.default_rng(7)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    mean, square = np.zeros(WIDTH, np.float64), np.zeros(WIDTH, np.float64)
    for i in range(0, len(x), 1024):  # x may be of half precision, to halve the driver's memory
        part = x[i : i + 1024].astype(np.float64)
        mean, square = mean + part.sum(0), square + (part * part).sum(0)
    mean = (mean / len(x)).astype(np.float32)
    spread = np.sqrt(np.maximum(square / len(x) - mean.astype(np.float64) ** 2, 0))
    w = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.float32(0)}
    fixed = {"mean": mean, "scale": (1 / (spread + 0.01)).astype(np.float32)}
    m, v, step = {k: 0 * p for k, p in w.items()}, {k: 0 * p for k, p in w.items()}, 0
    order = np.arange(len(y))
    for epoch in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            n = begin[pick + 1] - begin[pick]
            b = np.concatenate([[0], np.cumsum(n)])
            rows = np.arange(b[-1]) + np.repeat(begin[pick] - b[:-1], n)
            xs = x[rows].astype(np.float32)
            q, (h, t, s, p, z, bag) = _forward(w | fixed, xs, b)
            g = ((q - y[pick]) / len(pick)).astype(np.float32)
            gz = g[:, None] * w["c"]
            gh = gz[bag] * p[:, None]
            gp = (gz[bag] * h).sum(1)
            ge = p * (gp - np.add.reduceat(p * gp, b[:-1])[bag])
            gt, gs = ge[:, None] * w["a"] * s * (1 - t * t), ge[:, None] * w["a"] * t * s * (1 - s)
            gh = (gh + gt @ w["V"].T + gs @ w["U"].T) * (1 - h * h)
            xn = (xs - fixed["mean"]) * fixed["scale"]
            grads = {"W": xn.T @ gh + decay * w["W"], "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "a": (t * s).T @ ge, "c": z.T @ g + decay * w["c"], "d": g.sum()}
            step += 1
            r = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, gk in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = (w[k] - r * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return w | fixed


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, n, x): the passages' rows in half precision."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b, data, off in tn.slices(batch.column(2)):
                x, begin = passages(data, off)
                raw = [x[begin[i] : begin[i + 1]].astype(np.float16).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(raw, pa.binary())], ["id", "label", "x"])


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 3000) -> dict:
    """Weights from the ``fit_rows`` rows of ``labelled`` (id, label 0 or 1) with the smallest hash of their id."""
    some = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(labelled.columns[1]).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    some = some.orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(some), F.col("key") == F.col("id")).select("id", "label", "text")  # fit_rows bounds it
    got = scratch(rows.mapInArrow(_features, "id long, label int, x binary"), "fit").orderBy("id", "label", F.xxhash64("x")).limit(2 * fit_rows)
    return fitted(got, _fit_table)


def _fit_table(got: pa.Table) -> dict:
    xs = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got["x"].to_pylist()]
    begin = np.zeros(len(xs) + 1, np.int64)
    np.cumsum([len(b) for b in xs], out=begin[1:])
    return fit(np.concatenate(xs) if xs else np.zeros((0, WIDTH), np.float16), begin, got["label"].to_numpy().astype(np.float32))


def with_score(docs: DataFrame, weights: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and every whole text's score, in place of a column of that name."""
    spark = docs.sparkSession
    docs = docs.drop(score_col)
    sent = spark.sparkContext.broadcast(weights)  # of one fixed size
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = [score(sent.value, *passages(data, off)) for _, _, data, off in tn.slices(batch.column(where))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema_with(docs, **{score_col: "double"}))


def score_only(docs: DataFrame, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; the texts don't come back from the workers."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = [score(sent.value, *passages(data, off)) for _, _, data, off in tn.slices(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
