"""Small steps around a dossier: image shares and routes of pages, boxes and references of evidence, jobs that are over, answers kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes of a page without a stated one, in points; the least width and height of a shown box, in percent; states of a job in work.
PAGE_WIDTH, PAGE_HEIGHT, LEAST_WIDTH, LEAST_HEIGHT = 595.28, 841.89, 1.0, 0.8
ACTIVE = ["QUEUED", "PROCESSING"]
QUOTED, ANSWER_SECONDS = 120, 900


def image_coverage(images: DataFrame, page: list[str], x0: str, y0: str, x1: str, y1: str, page_area: str) -> DataFrame:
    """(page columns, coverage): the images' summed area as a share of the page's, between 0 and 1; images without a box count nothing."""
    area = F.coalesce((F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0)), F.lit(0.0))
    of = F.max(page_area)
    share = F.sum(area) / F.when(of > 0, of).otherwise(1.0)
    return images.groupBy(*page).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("coverage"))


def route_labels(pages: DataFrame, doc: str, method: str) -> DataFrame:
    """(doc, route): native if every page was read natively, else textract or paddle if a page was, else ocr."""
    used = lambda m: F.bool_or(F.coalesce(F.col(method) == m, F.lit(False)))
    every = F.bool_and(F.coalesce(F.col(method) == "pymupdf_native", F.lit(False)))
    return pages.groupBy(doc).agg(F.when(every, "native").when(used("textract_managed"), "textract").when(used("paddleocr_cpu"), "paddle").otherwise("ocr").alias("route"))


def box_percent(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box, in shares or in points, as left, top, width and height in percent of its page, within it and large enough to be seen."""
    shares = (x1 <= 1.05) & (y1 <= 1.05) & (F.coalesce(width, F.lit(0.0)) <= 1.05)
    across = F.when(shares, 1.0).when(F.coalesce(width, F.lit(0.0)) > 0, width).otherwise(PAGE_WIDTH)
    down = F.when(shares, 1.0).when(F.coalesce(height, F.lit(0.0)) > 0, height).otherwise(PAGE_HEIGHT)
    start = lambda at, of: F.greatest(F.lit(0.0), F.least(F.lit(99.0), at / of * 100))
    extent = lambda a, b, of, least: F.greatest(F.lit(least), F.least(100 - start(a, of), F.abs((b - a) / of * 100)))
    return F.struct(start(x0, across).alias("left"), start(y0, down).alias("top"), extent(x0, x1, across, LEAST_WIDTH).alias("width"), extent(y0, y1, down, LEAST_HEIGHT).alias("height"))


def evidence_key(doc: Column, page: Column, x0: Column, y0: Column) -> Column:
    """A key of a place in a document; x0 and y0 may be null."""
    at = F.concat(doc.cast("string"), F.lit("-P"), page.cast("string"))
    box = F.concat(at, F.lit("-"), F.format_string("%.2f", x0), F.lit("_"), F.format_string("%.2f", y0))
    return F.when(x0.isNotNull() & y0.isNotNull(), box).otherwise(F.concat(at, F.lit("-no-bbox")))


def evidence_ref(doc: Column, kind: Column, page: Column, text: Column, is_policy: Column) -> Column:
    """A passage as evidence: its first characters, a page of 1 at least, and policies under their own type."""
    return F.struct(
        doc.alias("document_id"), F.when(is_policy & (kind == "document"), "policy").otherwise(kind).alias("document_type"),
        F.greatest(F.lit(1), page).alias("page_number"), F.trim(F.substring(text, 1, QUOTED)).alias("quoted_span"),
    )


def matching_evidence(evidence: DataFrame, documents: DataFrame, key: str, kind: str) -> DataFrame:
    """The evidence rows whose type, in its normal form, was uploaded for the same key."""
    have = documents.select(F.col(key).alias("_k"), T.normal_type(kind).alias("_t")).distinct()
    return evidence.join(have, (F.col(key) == F.col("_k")) & (T.normal_type(F.col(kind)) == F.col("_t")), "left_semi")


def finished(candidates: DataFrame, jobs: DataFrame, job: str, status: str) -> DataFrame:
    """The candidates that are no longer in work; ids that no job has are over too."""
    return candidates.join(jobs.filter(F.col(status).isin(ACTIVE)).select(job), job, "left_anti")


def append_unique(first: Column, then: Column) -> Column:
    """The first ids and then the others that aren't among them, in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(then, none)))


def kept_answers(asked: DataFrame, answers: DataFrame, application: str, question: str, updated: str, at: str, seconds: int = ANSWER_SECONDS) -> DataFrame:
    """``asked`` (application, question, state of the application by its time of change, time) with the newest answer to the same question of the same
    state that is at most ``seconds`` old, else null."""
    kept = answers.select(F.col(application).alias("_a"), F.col(question).alias("_q"), F.col(updated).alias("_u"), F.col(at).alias("_at"), "answer")
    age = F.col(at).cast("timestamp").cast("double") - F.col("_at").cast("timestamp").cast("double")
    met = asked.join(kept, (F.col(application) == F.col("_a")) & (F.col(question) == F.col("_q")) & (F.col(updated) == F.col("_u")) & age.between(0, seconds), "left")
    return met.groupBy(*asked.columns).agg(F.max_by("answer", "_at").alias("answer"))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement; the same seed gives the same ones."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
