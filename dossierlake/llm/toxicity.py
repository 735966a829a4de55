"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over a document's distinct words and word beginnings
(hashed); each model also sees the probabilities that the chain gave the categories before. While fitting, those are out-of-fold: models of
the other folds predict them, so that a later model learns how far to trust an earlier one. The last category is the
label itself; the earlier ones are kinds of toxic documents that the labelled rows themselves show: the fitted toxic
documents are clustered by the words that set them apart (two clusters by cosine, none for a document without such words).

A word takes part if at least ``LEAST_DOCS`` of the fitted documents have it and its share of positive ones stands out.
Fitting takes a bounded sample of the
labelled rows (``fit_rows``, those with the smallest hash of the id, ties by id and label) in one task; scoring takes every whole text.

Defined results: null and empty texts have no words and get the models' base rates; without labelled rows, or with one
class alone, every probability is the share of that class (0 without rows). Repeated rows are scored each, very long
texts whole, null ids as others; an empty table gives no rows. The result holds the id and the probabilities only, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import fitted, scratch

BITS, FOLDS, LEAST_DOCS = 20, 4, 5
#: Standard deviations by which a word's share of positive documents must differ from the share of all.
APART = 5.0
#: Bytes of the beginnings of longer words that count as words too, for families with many endings.
BEGINNINGS = (4, 5)
KINDS = 2
CATEGORIES = [*[f"kind_{k + 1}" for k in range(KINDS)], "toxic"]


def distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's distinct words and word beginnings, and borders. Marks around a word don't count."""
    data = np.where(_MARK[data], np.uint8(32), tn.LOWER[data])
    starts, ends, first = tn.word_bounds(data, off)
    parts = [tn.word_hashes(data, starts, ends)]
    for n in BEGINNINGS:
        parts.append(np.where(ends - starts > n, tn.mix(tn.word_hashes(data, starts, np.minimum(ends, starts + n)) + np.uint64(n)), parts[0]))
    k = len(parts)
    h, begin = tn.distinct(np.stack(parts, 1).ravel() if len(starts) else np.zeros(0, np.uint64), first * k)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), begin


_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _linear(w: np.ndarray, dense: np.ndarray, bias: np.ndarray, ids: np.ndarray, begin: np.ndarray, extra: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(w[ids])])
    s = total[begin[1:]] - total[begin[:-1]] + extra @ dense + bias
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _apart(ids: np.ndarray, row: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """How many documents have each word, and by how many standard deviations its positive ones exceed their share."""
    docs, hits = np.bincount(ids, minlength=1 << BITS), np.bincount(ids, y[row], 1 << BITS)
    return docs, (hits - docs * share) / np.sqrt(np.maximum(docs, 1) * share * (1 - share))


def kinds(ids: np.ndarray, begin: np.ndarray, y: np.ndarray, steps: int = 20) -> np.ndarray:
    """A column a kind: the cluster of each positive row, by the words that positive rows have more than their share of."""
    out, share = np.zeros((len(y), KINDS)), float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return out
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(begin))
    docs, apart = _apart(ids, row, y, share)
    used = (docs >= LEAST_DOCS) & (apart >= APART)
    to, keep = np.cumsum(used) - 1, used[ids] & (y[row] > 0)
    member, place = np.unique(row[keep], return_inverse=True)
    x = np.zeros((len(member), int(used.sum())), np.float32)  # fitted rows by words that stand out, both bounded by the fitted rows
    x[place, to[ids[keep]]] = 1
    if len(x) < KINDS:
        return out
    x *= np.log(len(x) / np.maximum(x.sum(0), 1) + 1).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[int((x @ x.mean(0)).argmax())]]
    while len(centres) < KINDS:  # the document that is least like the centres so far
        centres.append(x[int(np.max([x @ c for c in centres], axis=0).argmin())])
    for _ in range(steps):
        near = np.stack([x @ c for c in centres], 1).argmax(1)
        centres = [x[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)]
        centres = [c / max(float(np.linalg.norm(c)), 1e-9) for c in centres]
    out[member, near] = 1
    return out


def _fit_one(ids: np.ndarray, begin: np.ndarray, extra: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-4, rate: float = 0.1) -> dict:
    """Logistic regression by Adam over all rows, on the words whose share of positive rows stands out; rarer classes weigh more."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return {"constant": share}
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(begin))
    docs, apart = _apart(ids, row, y, share)
    used = (docs >= LEAST_DOCS) & (np.abs(apart) >= APART)
    known, to, keep = np.flatnonzero(used), np.cumsum(used) - 1, used[ids]
    row, col = row[keep], to[ids[keep]]
    w, d, b = np.zeros(len(known)), np.zeros(extra.shape[1]), np.log(share / (1 - share))
    m, v = np.zeros(len(w) + len(d) + 1), np.zeros(len(w) + len(d) + 1)
    weight = np.where(y > 0, np.sqrt((1 - share) / share), 1.0)
    weight /= weight.sum()
    for step in range(1, steps + 1):
        s = np.bincount(row, w[col], len(y)) + extra @ d + b
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * weight
        grad = np.concatenate([np.bincount(col, g[row], len(w)) + decay * w, extra.T @ g + decay * d, [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, d, b = w - move[: len(w)], d - move[len(w) : -1], b - move[-1]
    full = np.zeros(1 << BITS, np.float32)
    full[known] = w
    return {"w": full, "dense": d, "bias": b}


def _apply(model: dict, ids: np.ndarray, begin: np.ndarray, extra: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(begin) - 1, model["constant"])
    return _linear(model["w"], model["dense"], model["bias"], ids, begin, extra)


def _pick(ids: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = begin[rows + 1] - begin[rows]
    b = np.concatenate([[0], np.cumsum(n)])
    return ids[np.arange(b[-1]) + np.repeat(begin[rows] - b[:-1], n)], b


def fit_chain(ids: np.ndarray, begin: np.ndarray, y: np.ndarray) -> list[dict]:
    """One model a column of ``y``, in order; earlier columns' probabilities are out-of-fold."""
    n, chain = len(y), []
    fold = np.random.default_rng(3).permutation(n) % FOLDS
    extra = np.zeros((n, 0))
    for k in range(y.shape[1]):
        chain.append(_fit_one(ids, begin, extra, y[:, k]))
        if k + 1 < y.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS):
                inner, outer = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                out[outer] = _apply(_fit_one(*_pick(ids, begin, inner), extra[inner], y[inner, k]), *_pick(ids, begin, outer), extra[outer])
            extra = np.column_stack([extra, out])
    return chain


def chain_probabilities(chain: list[dict], ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    extra = np.zeros((len(begin) - 1, 0))
    for model in chain:
        extra = np.column_stack([extra, _apply(model, ids, begin, extra)])
    return extra


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 4000) -> list[dict]:
    """The chain's models from the ``fit_rows`` labelled rows whose id's hash is smallest."""
    some = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # fit_rows bounds this side and the rows that reach the driver
    got = scratch(texts.join(F.broadcast(some), F.col("key") == F.col("id")).select("id", "label", "text"), "fit").orderBy("id", "label", F.xxhash64("text")).limit(2 * fit_rows)
    return fitted(got, _fit_table)


def _fit_table(got: pa.Table) -> list[dict]:
    parts, begin = [], [0]
    with np.errstate(over="ignore"):
        for _, _, data, off in tn.slices(got["text"]):
            ids, b = distinct_words(data, off)
            parts.append(ids.astype(np.int32))
            begin += (b[1:] + begin[-1]).tolist()
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin, label = np.array(begin, np.int64), got["label"].to_numpy().astype(float)
    return fit_chain(ids, begin, np.column_stack([kinds(ids, begin, label), label]))


def probabilities(docs: DataFrame, chain: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and one probability a category of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(chain)  # 4 MB a category, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = [chain_probabilities(sent.value, *distinct_words(data, off)) for _, _, data, off in tn.slices(batch.column(1))]
                p = np.concatenate(out) if out else np.zeros((0, len(CATEGORIES)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(len(CATEGORIES))]], ["id", *CATEGORIES])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in CATEGORIES)).withColumnRenamed("id", id_col)
