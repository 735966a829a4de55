"""Page classification with an abstain outcome: n-gram TF-IDF and a logistic model of pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from . import metrics

UNKNOWN = "UNKNOWN"
THRESHOLD, WORD_FEATURES, CHAR_FEATURES = 0.40, 12_000, 18_000


def word_ngrams(text: str) -> Column:
    """Words and pairs of neighbouring words."""
    w = T.words(text)
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_ngrams(text: str, low: int = 3, high: int = 5) -> Column:
    """Runs of characters within each word, padded with blanks."""
    padded = F.transform(T.words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(n: int) -> Column:  # n is no parameter of the lambda, to which Spark would give the word's place
        return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array(w))))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


class Sublinear(Transformer, HasInputCol, HasOutputCol):
    """Counts n as 1 + ln(n); a page's vector stays as long as its different n-grams, whatever the vocabulary's size."""

    def __init__(self, inputCol: str, outputCol: str) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        at, name = dataset.columns.index(self.getInputCol()), self.getOutputCol()

        def damp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(at)  # a struct of type, size, indices and values; sparse, as counts are
                kind, size, indices, values = (v.field(i) for i in range(4))
                flat = values.values.slice(values.offsets[0].as_py(), values.offsets[-1].as_py() - values.offsets[0].as_py())
                damped = pa.ListArray.from_arrays(pc.subtract(values.offsets, values.offsets[0]), pc.add(pc.ln(flat), 1.0))
                out = pa.StructArray.from_arrays([kind, size, indices, damped], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

        return dataset.mapInArrow(damp, StructType([*dataset.schema.fields, StructField(name, VectorUDT())]))


def fit(pages: DataFrame, text: str = "text", label: str = "label", word_features: int = WORD_FEATURES, char_features: int = CHAR_FEATURES, c: float = 10.0) -> PipelineModel:
    """A model of balanced classes on features of ``featured`` pages."""
    rows = featured(pages, text)
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, kinds = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    rows = rows.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(total)) / (kinds * F.col("_n")))  # one row a class
    stages = [StringIndexer(inputCol=label, outputCol="_y", handleInvalid="error", stringOrderType="alphabetAsc")]
    for name, size in (("w", word_features), ("c", char_features)):
        stages += [CountVectorizer(inputCol=f"_{name}", outputCol=f"_{name}n", vocabSize=size), Sublinear(inputCol=f"_{name}n", outputCol=f"_{name}s"), IDF(inputCol=f"_{name}s", outputCol=f"_{name}i"), Normalizer(inputCol=f"_{name}i", outputCol=f"_{name}u")]
    stages += [VectorAssembler(inputCols=["_wu", "_cu"], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", probabilityCol="_p", predictionCol="_k", rawPredictionCol="_r", regParam=1.0 / (c * total), standardization=False, family="multinomial", maxIter=60)]
    return Pipeline(stages=stages).fit(rows)


def featured(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn("_w", word_ngrams(text)).withColumn("_c", char_ngrams(text))


def _weights(model: PipelineModel) -> dict:
    """The fitted numbers as arrays: vocabularies, weights by class (IDF included), IDF and intercepts."""
    words_, _, idf_w, _, chars, _, idf_c, _, _, lr = model.stages[1:]
    idf, coefficients = [idf_w.idf.toArray(), idf_c.idf.toArray()], lr.coefficientMatrix.toArray()
    n = len(words_.vocabulary)
    return {"words": words_.vocabulary, "chars": chars.vocabulary, "idf": idf, "by_class": [coefficients[:, :n] * idf[0], coefficients[:, n:] * idf[1]], "base": lr.interceptVector.toArray()}


def _runs_of(word: str, low: int = 3, high: int = 5) -> list[str]:
    """``char_ngrams`` of one word."""
    w = f" {word} "
    return [x for n in range(low, high + 1) for x in ([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w])]


class _Judge:
    """Scores many pages at once as the model's stages do. A word's n-grams are looked up once a task (or each time it comes up after ``KNOWN`` other words)."""

    KNOWN, CHUNK = 200_000, 150_000  # words that are remembered, and n-grams that are counted at a time

    def __init__(self, weights: dict) -> None:
        self.base, self.idf, self.by_class = weights["base"], weights["idf"], weights["by_class"]
        self.chars = {g: i for i, g in enumerate(weights["chars"])}
        self.single = {g: i for i, g in enumerate(weights["words"]) if " " not in g}
        pairs = [(*g.split(" "), i) for i, g in enumerate(weights["words"]) if " " in g]
        self.part = {w: i for i, w in enumerate(dict.fromkeys(x for p in pairs for x in p[:2]))}
        keys = np.array([self.part[x] * len(self.part) + self.part[y] for x, y, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_at = keys[order], np.array([i for *_, i in pairs], np.int64)[order]
        self.known: dict[str, tuple] = {}

    def _entry(self, word: str) -> tuple:
        if len(self.known) >= self.KNOWN:
            self.known.clear()
        self.known[word] = out = (self.single.get(word, -1), self.part.get(word, -1), [i for g in _runs_of(word) if (i := self.chars.get(g)) is not None])
        return out

    def _block(self, k: int, n: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(n, classes): the scores of n pages by one block of features, whose occurrences are given by page (in order) and place."""
        idf, by_class = self.idf[k], self.by_class[k]
        out = np.zeros((n, len(by_class)))
        if not len(rows):
            return out
        size = len(idf)
        key = (rows * size + at).astype(np.int32 if n * size < 1 << 31 else np.int64)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.concatenate([first[1:], [len(key)]]) - first
        damped = np.log(np.arange(1, times.max() + 1))[times - 1] + 1.0
        row = key[first] // size
        at = key[first] - row * size
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        norm = np.sqrt(np.add.reduceat(np.square(damped * idf.take(at)), starts))
        total = np.stack([np.add.reduceat(of.take(at) * damped, starts) for of in by_class], axis=1)
        out[row[starts]] = total / np.where(norm > 0, norm, 1.0)[:, None]
        return out

    def probabilities(self, lengths: np.ndarray, flat: pa.Array) -> np.ndarray:
        """(pages, classes) of pages of so many words each."""
        coded = flat.dictionary_encode()
        code, entries = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [self.known.get(w) or self._entry(w) for w in coded.dictionary.to_pylist()]
        single, part = (np.array([e[j] for e in entries], np.int64) for j in (0, 1))
        size = np.array([len(e[2]) for e in entries], np.int64)
        grams, begin = np.fromiter(chain.from_iterable(e[2] for e in entries), np.int64, size.sum()), np.cumsum(size) - size
        ends, many = np.cumsum(lengths), np.cumsum(size[code] + 2)
        scores = np.tile(self.base, (len(lengths), 1))
        lo = 0
        while lo < len(lengths):
            first = ends[lo] - lengths[lo]
            below = many[first - 1] if first else 0
            hi = max(lo + 1, int(np.searchsorted(ends, np.searchsorted(many, below + self.CHUNK), "right")))
            own = code[first : ends[hi - 1]]
            row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            near = np.flatnonzero((row[1:] == row[:-1]) & (part[own[1:]] >= 0) & (part[own[:-1]] >= 0)) if len(own) else row
            key = part[own[near]] * len(self.part) + part[own[near + 1]] if len(near) else near
            at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            met = self.pairs[at] == key if len(near) else np.zeros(0, bool)
            alone = single[own] >= 0
            scores[lo:hi] += self._block(0, hi - lo, np.concatenate([row[alone], row[near[met]]]), np.concatenate([single[own[alone]], self.pair_at[at[met]] if len(near) else near]))
            take = size[own]
            within = np.arange(take.sum()) + np.repeat(begin.take(own) - (np.cumsum(take) - take), take)
            scores[lo:hi] += self._block(1, hi - lo, np.repeat(row, take), grams.take(within))
            lo = hi
        top = scores.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):  # a model of a single class has an infinite intercept
            p = np.exp(np.where(np.isinf(top), np.where(scores == top, 0.0, -np.inf), scores - top))
        return p / p.sum(axis=1, keepdims=True)


def predict(model: PipelineModel, pages: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with label_pred, confidence and reason; UNKNOWN for blank pages and below the threshold.

    The model's stages would write each n-gram of each page as a string and hand vectors from stage to stage; here a page's words are handed
    to NumPy once, where pages are scored together by the same numbers. A text without words has the classes' intercepts only.
    """
    sent, own = pages.sparkSession.sparkContext.broadcast(_weights(model)), []

    @F.arrow_udf("struct<k: int, p: double>")
    def judged(words: pa.Array) -> pa.Array:
        if not own:
            own.append(_Judge(sent.value))
        p = own[0].probabilities(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(words))
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(p[np.arange(len(p)), best])], ["k", "p"])

    names = F.array(*map(F.lit, model.stages[0].labels))
    rows = pages.withColumn("_q", judged(T.words(text))).withColumn("confidence", F.round("_q.p", 6)).withColumn("_best", F.get(names, F.col("_q.k")))
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return rows.select(
        *pages.columns, F.when(blank | (F.col("confidence") < threshold), UNKNOWN).otherwise(F.col("_best")).alias("label_pred"), F.when(blank, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(blank, "empty_text").when(F.col("confidence") < threshold, F.concat(F.lit("LOW_CONFIDENCE_"), F.format_number("confidence", 2))).alias("reason"),
    )


def by_word_counts(pages: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with label_pred, confidence and reason as ``predict`` gives them, without a model: the type whose words the text holds most often.

    n occurrences give a confidence of n / (n + 2), so a single one abstains. Words count within longer words too; ties go to the type that is tried first.
    """

    def most(t: Column) -> Column:
        uses = lambda w: ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("int")
        return F.array_max(F.array(*[F.struct(sum((uses(w) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, words) in enumerate(T.TYPE_WORDS)]))

    t = F.coalesce(F.col(text), F.lit(""))
    best = T.let(F.lower(t), most)
    p, blank = F.round(F.col("_best.n") / (F.col("_best.n") + 2), 6), F.trim(t) == ""
    rows = pages.withColumn("_best", best).withColumn("_p", p)
    return rows.select(
        *pages.columns, F.when(F.col("_p") < threshold, UNKNOWN).otherwise(F.col("_best.name")).alias("label_pred"), F.col("_p").alias("confidence"),
        F.when(blank, "empty_text").when(F.col("_p") < threshold, F.concat(F.lit("LOW_CONFIDENCE_"), F.format_number("_p", 2))).alias("reason"),
    )


def document_types(documents: DataFrame, pages: DataFrame, doc: str, place: str, given: str, page: str, text: str) -> DataFrame:
    """(doc, doc_type, confidence, method, triage, pages, first_probability): what each document is, and how that is known.

    A type that was given and isn't unknown stays ("given"; nothing was observed, so confidence and triage are null). Else the pages, which
    have label_pred and confidence, vote ("model"; pages without text have no vote). Where all abstain, or there are none, the first type of
    which a word lies in the document's id, its place or any page ("heuristic", confidence 0.50, to triage); without any, unknown with 0.

    ``pages`` counts those with text; ``first_probability`` is the confidence of the first of them, if the model told the type. Pages of no
    document are left out, repeated documents are one (the smallest type that was given, all places). No text is gathered: the words
    of a whole document are met if they are met on a page, so each page gives the place of its first type, of which the smallest counts.
    """
    names = F.array(*[F.lit(name) for name, _ in T.TYPE_WORDS])
    rank = lambda t: T.let(t, lambda x: F.coalesce(F.nullif(F.array_position(names, T.type_by_words(x)), F.lit(0)) - 1, F.lit(len(T.TYPE_WORDS))).cast("int"))
    told = F.lower(F.col(given))
    docs = documents.filter(F.col(doc).isNotNull()).groupBy(doc).agg(
        F.min(F.when(told.isNotNull() & (told != "unknown"), F.col(given))).alias("_given"), F.min(rank(F.concat_ws(" ", F.col(doc).cast("string"), place))).alias("_at")
    )
    full = pages.filter(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "") != "")
    seen = full.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"), F.min(rank(F.col(text))).alias("_in"), F.min(F.struct(page, "confidence"))["confidence"].alias("_first"))
    voted = metrics.vote(full, doc, page, "label_pred", "confidence").select(doc, F.col("label").alias("_label"), F.col("confidence").alias("_c"))
    rows = docs.join(seen, doc, "left").join(voted, doc, "left")
    guess = F.get(names, F.least("_at", F.coalesce("_in", F.lit(len(T.TYPE_WORDS)))))
    is_given, is_model = F.col("_given").isNotNull(), F.coalesce(F.col("_label") != UNKNOWN, F.lit(False))
    of = lambda given_, model, heuristic, none: F.when(is_given, given_).when(is_model, model).when(guess.isNotNull(), heuristic).otherwise(none)
    return rows.select(
        doc,
        of(F.col("_given"), F.col("_label"), guess, F.lit("unknown")).alias("doc_type"),
        of(F.lit(None), F.col("_c"), F.lit(0.50), F.lit(0.0)).cast("double").alias("confidence"),
        of(F.lit("given"), F.lit("model"), F.lit("heuristic"), F.lit("heuristic")).alias("method"),
        of(F.lit(None), F.lit(False), F.lit(True), F.lit(True)).cast("boolean").alias("triage"),
        F.coalesce("_n", F.lit(0)).alias("pages"),
        of(F.lit(None), F.col("_first"), F.lit(None), F.lit(None)).cast("double").alias("first_probability"),
    )


def sample(rows: DataFrame, strata: str | None, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows of each stratum (of all rows, without one) without replacement: those with the smallest MD5 of ``seed|key``; ties go by the key.

    The same rows come out however they are dealt. The window's limit keeps n rows a stratum in each task before any row moves, so a hot
    stratum's window has n rows a task.
    """
    by = F.lit(0) if strata is None else F.col(strata)
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), *key))
    return rows.withColumn("_at", at).filter(F.col("_at") <= n).drop("_at")


def cascade(first: DataFrame, second: DataFrame, key: str, low: float = 0.15, high: float = THRESHOLD) -> DataFrame:
    """The first model's predictions, replaced by the second's where the first abstained with a confidence in [low, high)."""
    band = (F.col("label_pred") == UNKNOWN) & (F.col("confidence") >= low) & (F.col("confidence") < high)
    two = second.select(key, F.col("label_pred").alias("_l"), F.col("confidence").alias("_c"))
    return first.join(two, key, "left").select(key, F.when(band, F.coalesce("_l", F.col("label_pred"))).otherwise(F.col("label_pred")).alias("label_pred"), F.when(band, F.coalesce("_c", F.col("confidence"))).otherwise(F.col("confidence")).alias("confidence"), band.alias("escalated"))


def grouped_split(rows: DataFrame, group: str, shares: dict[str, int]) -> DataFrame:
    """``rows`` with a split; all rows of a group share it, by the group's hash in hundredths."""
    at, out, upto = F.pmod(F.xxhash64(F.col(group)), F.lit(100)), F.lit(None).cast("string"), 0
    for name, share in shares.items():
        out = F.when((at >= upto) & (at < upto + share), name).otherwise(out)
        upto += share
    return rows.withColumn("split", out)
