"""Cutting texts into passages of a bounded number of tokens, by folds over arrays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_STRINGS = "array<string>"


def _count(s: Column) -> Column:
    return T.token_count(s)


def sentences(text: Column) -> Column:
    """Trimmed sentences, paragraph by paragraph."""
    paragraphs = F.filter(F.transform(F.split(F.trim(text), r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?])\s+"))), lambda s: F.trim(s) != "")


def _state(done: Column, open_: Column, n: Column) -> Column:
    return F.struct(done.cast(_STRINGS).alias("done"), open_.cast(_STRINGS).alias("open"), n.cast("int").alias("n"))


_EMPTY = lambda: F.array().cast(_STRINGS)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tail(counts: Column, overlap: int) -> Column:
    """How many of the last counts together are at most ``overlap``, and their sum."""
    state = lambda k, n, full: F.struct(k.cast("int").alias("k"), n.cast("int").alias("n"), full.alias("full"))
    step = lambda a, x: F.when(a["full"] | (a["n"] + x > overlap), state(a["k"], a["n"], F.lit(True))).otherwise(state(a["k"] + 1, a["n"] + x, F.lit(False)))
    return F.aggregate(F.reverse(counts), state(F.lit(0), F.lit(0), F.lit(False)), step)


def _by_words(sentence: Column, least: int, most: int) -> Column:
    """A sentence that is too long, cut between words."""

    def step(a: Column, w: Column) -> Column:
        n = _count(w)
        cut = (a["n"] + n > most) & (a["n"] >= least)
        return F.when(cut, _state(F.concat(a["done"], F.array(F.array_join(a["open"], " "))), F.array(w), n)).otherwise(_state(a["done"], F.concat(a["open"], F.array(w)), a["n"] + n))

    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    return F.aggregate(words, _state(_EMPTY(), _EMPTY(), F.lit(0)), step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], " ")))).otherwise(a["done"]))


_RUNS = "array<struct<a:int,b:int>>"


def _runs(counts: Column, least: int, most: int, overlap: int) -> Column:
    """Which sentences make up each passage, by their token counts: runs from a to before b; b is -1 for one that is too long."""

    def state(done: Column, open_: Column, a: Column, n: Column) -> Column:
        return F.struct(done.cast(_RUNS).alias("done"), open_.cast("array<int>").alias("open"), a.cast("int").alias("a"), n.cast("int").alias("n"))

    run = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    none = F.array().cast("array<int>")

    def step(s: Column, x: Column) -> Column:
        n, at = x["n"], x["i"]
        closed = F.when(F.size(s["open"]) > 0, F.concat(s["done"], run(s["a"], at))).otherwise(s["done"])
        more = state(s["done"], F.concat(s["open"], F.array(n)), F.when(F.size(s["open"]) > 0, s["a"]).otherwise(at), s["n"] + n)
        handed = _let(_tail(s["open"], overlap), lambda t: state(closed, F.concat(F.slice(s["open"], F.size(s["open"]) - t["k"] + 1, t["k"]), F.array(n)), at - t["k"], t["n"] + n))
        return F.when(n > most, state(F.concat(closed, run(at, F.lit(-1))), none, at + 1, F.lit(0))).when((s["n"] + n <= most) | (s["n"] < least), more).otherwise(handed)

    start = state(F.array().cast(_RUNS), none, F.lit(0), F.lit(0))
    items = F.transform(counts, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.aggregate(items, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], run(s["a"], s["a"] + F.size(s["open"])))).otherwise(s["done"]))


def chunks(text: Column | str, least: int = 250, most: int = 400, overlap: int = 30) -> Column:
    """An array of passages: sentences are gathered up to ``most`` tokens; a passage of ``least`` or more is closed before
    the next sentence and hands its last ``overlap`` tokens on; one of fewer takes that sentence in all the same.

    Tokens are counted once a sentence; the fold over sentences moves numbers only, and passages are joined at the end.
    """
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")

    def cut(parts: Column) -> Column:
        passage = lambda r: F.when(r["b"] < 0, _by_words(F.get(parts, r["a"]), least, most)).otherwise(F.array(F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), " ")))
        return F.flatten(F.transform(_runs(F.transform(parts, _count), least, most, overlap), passage))

    return _let(t, lambda t: F.when(F.coalesce(t, F.lit("")) == "", _EMPTY()).when(_count(t) <= most, F.array(t)).otherwise(_let(sentences(t), cut)))


def chunk_pages(pages: DataFrame, doc: str, page: str, text: str, **sizes: int) -> DataFrame:
    """(chunk_id, doc, page, pos, text, token_count, aliases): a page that is one passage bears the page's id; else its first one has it as an alias."""
    cut = pages.withColumn("_all", chunks(text, **sizes))
    rows = cut.select(doc, page, F.size("_all").alias("_n"), F.posexplode("_all").alias("pos", "chunk"))
    base = F.concat(F.col(doc).cast("string"), F.lit("_p"), F.col(page).cast("string"))
    part = F.concat(base, F.lit("_c"), F.col("pos").cast("string"))
    return rows.select(
        F.when(F.col("_n") == 1, base).otherwise(part).alias("chunk_id"), doc, page, "pos", F.col("chunk").alias("text"), T.token_count("chunk").alias("token_count"),
        F.when(F.col("_n") == 1, F.array(F.concat(base, F.lit("_c0")))).when(F.col("pos") == 0, F.array(base)).otherwise(_EMPTY()).alias("aliases"),
    )


def policy_sections(markdown: Column | str, most: int = 260) -> Column:
    """A policy's sections (at rules and second-level headings) packed in order up to ``most`` tokens."""
    rule = "\n\n---\n\n"
    parts = F.filter(F.transform(F.split(markdown, r"\n---\n|\n(?=##\s+)"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")

    def step(a: Column, s: Column) -> Column:
        n = _count(s)
        shut = F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], rule)))).otherwise(a["done"])
        return F.when(a["n"] + n <= most, _state(a["done"], F.concat(a["open"], F.array(s)), a["n"] + n)).otherwise(_state(shut, F.array(s), n))

    return F.aggregate(parts, _state(_EMPTY(), _EMPTY(), F.lit(0)), step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], rule)))).otherwise(a["done"]))
