"""Where words stand on pages: layout of plain text, phrases over consecutive positions, boxes of what was found.

A word is (doc, page, pos, word, x0, y0, x1, y1, method): its place in reading order, its box and how it was read. Phrases are
found by joins on words and positions: a phrase enters by its rarest word only, so common words of long phrases start
nothing, and every other word is then looked up at the one position where it must stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

# Methods, the confidence of words that were not read natively, the distance of one line's boxes, and the box of a value that isn't found.
NATIVE, OCR, OCR_CONFIDENCE, SAME_LINE = "pymupdf_native", "tesseract_cpu", 0.85, 15.0
FALLBACK_BOX = (50.0, 50.0, 250.0, 70.0)
#: Plain text on a page: points a character and a line, margins, height of a word, and lines a page.
ADVANCE, LEADING, MARGIN, HEIGHT, PAGE_LINES = 6.0, 14.0, 50.0, 12.0, 52
BOX = ["x0", "y0", "x1", "y1"]
#: Words that a task places before it hands them on, and words of phrases that may be broadcast.
PLACED, FEW_WORDS = 100_000, 500_000


def laid_out(texts: DataFrame, doc: str, text: str, method: str = NATIVE) -> DataFrame:
    """Words of plain texts in a fixed-width layout: lines of the text are lines of pages, and blanks count. Rows of one doc must be one text.

    A text's words are placed where it is read; nothing is shuffled.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1)):
                page = pos = 0
                for line, words in enumerate((t.as_py() or "").split("\n")):
                    if line // PAGE_LINES + 1 != page:
                        page, pos = line // PAGE_LINES + 1, 0
                    at = 0
                    for word in words.split(" "):
                        if word:
                            pos += 1
                            rows.append((i, page, line % PAGE_LINES, pos, word, at))
                        at += len(word) + 1
                if len(rows) >= PLACED:
                    yield _placed(batch, rows)
                    rows = []
            if rows:
                yield _placed(batch, rows)

    source = texts.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    words = source.mapInArrow(place, f"doc {source.dtypes[0][1]}, page int, line int, pos int, word string, at int")
    x0, y0 = MARGIN + ADVANCE * F.col("at"), MARGIN + LEADING * F.col("line")
    return words.select("doc", "page", "pos", "word", x0.alias("x0"), y0.alias("y0"), (x0 + ADVANCE * F.length("word")).alias("x1"), (y0 + HEIGHT).alias("y1"), F.lit(method).alias("method"))


def _placed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    row, page, line, pos, word, at = zip(*rows, strict=True)
    whole = [pa.array(c, pa.int32()) for c in (page, line, pos)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *whole, pa.array(word, pa.string()), pa.array(at, pa.int32())], ["doc", "page", "line", "pos", "word", "at"])


def bare(word: Column | str) -> Column:
    """A word in lower case without the punctuation around it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")


def phrase_hits(words: DataFrame, phrases: DataFrame, key: str, phrase: str) -> DataFrame:
    """(key, doc, page, method, start, x0, y0, x1, y1) of every run of a page's words that equals a phrase; case and surrounding punctuation don't count.

    Phrases without a word find nothing.
    """
    split = phrases.select(F.col(key).alias("_key"), F.array_compact(F.transform(F.split(phrase, r"\s+"), lambda w: F.when(bare(w) != "", bare(w)))).alias("w"))
    asked = split.select("_key", F.size("w").alias("length"), F.posexplode("w").alias("i", "w"))
    wanted = asked.select("w").distinct()
    few = wanted.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    # words of no phrase go where they are read, as a phrase needs each of its own
    keyed = words.withColumn("w", bare("word")).join(F.broadcast(wanted) if few else wanted, "w", "left_semi")
    keyed = kept(keyed.select("doc", "page", "method", "pos", "w", *BOX), "words")
    uses = keyed.groupBy("w").agg(F.count(F.lit(1)).alias("uses"))
    rarest = asked.join(uses, "w").groupBy("_key").agg(F.min_by(F.struct("i", "w"), F.struct("uses", "i")).alias("a"), F.count(F.lit(1)).alias("known"), F.first("length").alias("length")).filter("known = length")  # one unknown word is enough
    starts = keyed.select("w", "doc", "page", "method", "pos").join(rarest.select("_key", "length", F.col("a.i").alias("i"), F.col("a.w").alias("w")), "w").select("_key", "length", "doc", "page", "method", (F.col("pos") - F.col("i")).alias("start"))
    due = starts.join(asked.select("_key", "i", "w"), "_key").withColumn("pos", F.col("start") + F.col("i"))
    met = due.join(keyed.select("doc", "page", "method", "pos", "w", *BOX), ["doc", "page", "method", "pos", "w"])
    found = met.groupBy("_key", "doc", "page", "method", "start", "length").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).filter("n = length")
    return found.select(F.col("_key").alias(key), "doc", "page", "method", "start", *BOX)


def phrase_evidence(words: DataFrame, phrases: DataFrame, key: str, phrase: str, width: float = 595.28, height: float = 841.89) -> DataFrame:
    """(key, doc, page, quoted_span, hits, x0, y0, x1, y1, method, confidence): a row a phrase and page.

    The box is the union of the page's first hit and of those that start within a line of it, kept on the page. Words that were read
    natively are searched first; only pages without such a hit count hits of other words.
    """
    hits = phrase_hits(words, phrases, key, phrase)
    page = Window.partitionBy(key, "doc", "page")
    first = F.first(F.struct("method", "y0")).over(page.orderBy(F.col("method") != NATIVE, "method", "start"))
    near = hits.withColumn("f", first).filter((F.col("method") == F.col("f.method")) & (F.abs(F.col("y0") - F.col("f.y0")) < SAME_LINE))
    edge = lambda c, top: F.round(F.greatest(F.lit(0.0), F.least(c, F.lit(top))), 2)
    box = [edge(F.min("x0"), width).alias("x0"), edge(F.min("y0"), height).alias("y0"), edge(F.max("x1"), width).alias("x1"), edge(F.max("y1"), height).alias("y1")]
    found = near.groupBy(key, "doc", "page", "method").agg(F.count(F.lit(1)).alias("hits"), *box)
    spans = phrases.select(key, F.trim(phrase).alias("quoted_span"))
    return found.join(spans, key).select(key, "doc", "page", "quoted_span", "hits", *BOX, "method", F.when(F.col("method") == NATIVE, 1.0).otherwise(OCR_CONFIDENCE).alias("confidence"))


def with_boxes(facts: DataFrame, words: DataFrame, doc: str, page: str, value: str) -> DataFrame:
    """``facts`` with the union box of all words of their page that are words of the value; a fixed box where none is, and null without a page."""
    row = "_fact"
    keyed = facts.withColumn(row, F.struct(doc, page, value))
    asked = keyed.filter(F.col(page).isNotNull()).select(row, F.col(doc).alias("doc"), F.col(page).alias("page"), F.explode(F.array_distinct(F.split(F.trim(value), r"\s+"))).alias("word"))  # repeated ones don't change a union
    met = asked.join(words.select("doc", "page", "word", *BOX), ["doc", "page", "word"]).groupBy(row).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    found = keyed.join(met, row, "left")
    return found.select(*facts.columns, *[F.when(F.col(page).isNotNull(), F.round(F.coalesce(c, F.lit(d)), 2)).alias(c) for c, d in zip(BOX, FALLBACK_BOX, strict=True)])
