"""Phrases whose words occur together more often than apart, by hierarchical pair naming.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and those into words. All counts are
exact and a language's own (null: ``und``). Level 1 names the frequent words of each language. Level k looks at all
places where two frequent (k-1)-grams stand one word apart, and counts the k-grams there; one is named by the names of
its words, and its left and right parents are the (k-1)-grams without the last and the first word.
So parents serve as pointers: the cut after k words compares the ancestor reached by left steps with the one reached
by right steps, and a phrase lies within a longer one exactly if a chain of children leads there. As a parent is never
rarer than its child, the most frequent child tells whether any longer phrase covers enough of its occurrences.

Words are named while texts are read: the sorted keys of up to ``name_bound`` frequent words are broadcast (8 bytes each),
and a name is the rank of a key. Whether a longer phrase is frequent is asked of a broadcast bit table of at most
2^``FILTER_BITS`` bits: it forgets none, and what it lets through by chance is counted and dropped as too rare, so phrases of
any number are counted in one pass a level. Counts of keys are summed in each task, and shuffled as blocks of sorted
differences by byte planes (three to seven bytes a key once compressed) to parts that grow in number with the texts.
Beyond ``name_bound`` words, or if two words of 64-bit keys ever collide (which is checked), places are rows, and names
are joined by shuffles (``_by_joins``): the same result at the cost of a shuffle of all places a level. A language's best
phrases are taken from salted parts first, and then from those.

Null or empty texts, and pieces without words, give nothing. Repeated rows all count. Ties end with the phrase.
Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import BROADCAST_ROWS, counted, maybe_broadcast, scratch

UNKNOWN_LANG = "und"
#: Frequent words that may be broadcast: 64 MB of keys.
NAME_BOUND = 8_000_000
#: Bits for each frequent phrase in the table that tells whether a phrase may be frequent, and the logarithm of its most bits (32 MB).
BITS_EACH, FILTER_BITS = 32, 28
#: Bits of a key column.
KEY_BITS = 63
#: Keys that a task sums before it sends them on.
HELD = 1 << 20
#: Bytes of text for each part of the counted keys.
PART_BYTES = 1 << 24
#: Bytes of phrases that may be broadcast.
PHRASE_BYTES = 32_000_000
#: Parts of a language from which the best phrases are taken before they meet.
SALTS = 256
#: Fixed by the definition of pieces and words.
PIECE_END, BETWEEN_WORDS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]"

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_U = np.uint64


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all words, and whether each begins a piece."""
    inside, edge = ~_GAP[data], np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1
    text = np.searchsorted(off, starts, side="right") - 1
    breaks = np.append(0, np.cumsum(_BREAK[data]))[starts]
    return starts, ends, text, np.append(True, (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]))[: len(starts)]


def _keyed(batch: pa.RecordBatch, flip: int = 0) -> Iterator[tuple]:
    """For runs of rows (text, lang): bytes, languages of the rows, and each word's start, end, row, piece start and key (language and word).

    With ``flip`` keys are those of flipped bytes, a second hash."""
    langs = batch.column(1).to_pylist()
    with np.errstate(over="ignore"):
        for a, b, data, off in tn.slices(batch.column(0)):
            data = tn.LOWER[data]
            starts, ends, row, opens = _words(data, off)
            names = [x.encode() for x in langs[a:b]]
            raw, at = np.frombuffer(b"".join(names), np.uint8), np.append(0, np.cumsum([len(x) for x in names]))
            keys = []
            for mask in (0, flip) if flip else (0,):
                lang = tn.mix(tn.word_hashes(raw ^ np.uint8(mask), at[:-1], at[1:]) + _U(7))
                keys.append(tn.mix(tn.word_hashes(data ^ np.uint8(mask), starts, ends) ^ lang[row]))
            yield data, langs[a:b], starts, ends, row, opens, *keys


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of key columns."""
    h = tn.mix(columns[0].view(_U))
    with np.errstate(over="ignore"):
        for c in columns[1:]:
            h = tn.mix(h + _U(1) ^ c.view(_U))
    return h


def _summed(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of key columns in ascending order, and the sums of their counts (without counts: of ones)."""
    if n is None and len(columns) == 1:
        found, n = np.unique(columns[0], return_counts=True)
        return [found], n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], np.ones(len(order), np.int64) if n is None else n[order]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at) if len(at) else n


def _pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted keys and their counts by byte planes, the first column as differences: most planes are zeros, which compress to nothing."""
    columns = [np.diff(columns[0], prepend=np.int64(0)), *columns[1:], n.astype(np.int64)]
    return b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unpack(body: bytes, width: int) -> list[np.ndarray]:
    planes = np.frombuffer(body, np.uint8).reshape(width + 1, 8, -1)
    first, *rest = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
    return [np.cumsum(first), *rest]


def _blocks(runs: Iterator[list[np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of key columns to (part, body): packed counts, summed over about ``HELD`` keys."""
    held, size = [], 0

    def summed() -> tuple[list[np.ndarray], np.ndarray]:
        return _summed([np.concatenate(c) for c in zip(*[c for c, _ in held], strict=True)], np.concatenate([n for _, n in held]))

    def sent(columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        part = (_hash(columns) % _U(parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        columns, n = [c[order] for c in columns], n[order]
        have, first = np.unique(part[order], return_index=True)
        bodies = [_pack([c[a:b] for c in columns], n[a:b]) for a, b in zip(first, [*first[1:], len(n)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(bodies, pa.binary())], ["part", "body"])

    for columns in runs:
        held.append(_summed(columns))
        size += len(held[-1][1])
        if size >= HELD:
            held = [summed()]
            size = len(held[0][1])
            if size >= HELD // 2:
                yield sent(*held[0])
                held, size = [], 0
    if size:
        yield sent(*summed())


def _frequent(texts: DataFrame, runs, width: int, parts: int, least: int) -> DataFrame:
    """(c0, .., f, h): the rows of ``width`` key columns that ``runs`` makes of the texts at least ``least`` times, and their hashes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(runs(batches), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(body, width) for batch in batches for body in batch.column(1).to_pylist()]
        if held:
            *columns, n = [np.concatenate(c) for c in zip(*held, strict=True)]
            del held
            columns, n = _summed(columns, n)
            columns, n = [c[n >= least] for c in columns], n[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, n, _hash(columns).view(np.int64)]], [*[f"c{i}" for i in range(width)], "f", "h"])

    sent = texts.mapInArrow(send, "part int, body binary").repartitionById(parts, "part")
    return sent.mapInArrow(add, ", ".join(f"c{i} long" for i in range(width)) + ", f long, h long")


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for *_, keys in _keyed(batch):
            yield [keys.view(np.int64)]


def _ranks(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Each key's place among the sorted ones, -1 if it isn't there."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1) if len(sorted_keys) else np.full(len(keys), -1)


def _word_texts(known: Broadcast):
    """Rows (text, lang) to (name, lang, word, n): each named word once a task, and for each language a row without a word: all its words.

    A word whose second hash isn't that of its name's word before it is a row too, so a name of two words has both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, second = Counter(), np.zeros(len(known.value), bool), np.zeros(len(known.value), _U)
        rows = lambda name, lang, word, n: pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["name", "lang", "word", "n"])
        for batch in batches:
            for data, langs, starts, ends, row, _, keys, again in _keyed(batch, 255):
                for x, many in zip(langs, np.bincount(row, minlength=len(langs)).tolist(), strict=True):
                    total[x] += many
                name = _ranks(keys.view(np.int64), known.value)
                at = np.flatnonzero(name >= 0)
                new, first = np.unique(name[at], return_index=True)
                new, first = new[~seen[new]], at[first[~seen[new]]]
                seen[new], second[new] = True, again[first]
                at = np.append(first, at[second[name[at]] != again[at]])
                yield rows(name[at].astype(np.int32), [langs[i] for i in row[at]], [data[a:b].tobytes().decode() for a, b in zip(starts[at], ends[at], strict=True)], np.zeros(len(at), np.int64))
            if len(total) > BROADCAST_ROWS:
                yield rows([-1] * len(total), [*total], [None] * len(total), [*total.values()])
                total.clear()
        yield rows([-1] * len(total), [*total], [None] * len(total), [*total.values()])

    return run


def _columns(name: np.ndarray, at: np.ndarray, k: int, bits: int) -> list[np.ndarray]:
    """Key columns of the k-grams at the given places: names of ``bits`` bits, as many in a column as fit."""
    out = []
    for j in range(k):
        if j % (KEY_BITS // bits) == 0:
            out.append(np.zeros(len(at), np.int64))
        out[-1] = out[-1] << bits | name[at + j]
    return out


def _words_of(k: int, bits: int) -> Column:
    """The names of the words that ``_columns`` has put together."""
    per = KEY_BITS // bits
    last = lambda j: min(per, k - j // per * per) - 1
    return F.array(*[F.shiftright(f"c{j // per}", bits * (last(j) - j % per)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for j in range(k)])


def _gram_keys(known: Broadcast, filters: list[Broadcast], k: int, bits: int):
    """Key columns of all places of k words that are named, and of which no part is known to be rare. ``filters`` are those of 2 to k - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for *_, opens, keys in _keyed(batch):
                name = _ranks(keys.view(np.int64), known.value)
                good = name >= 0
                for j in range(2, k + 1):
                    # the words at i and i + j - 1 are in one piece if no piece opens in between
                    left = good[:-1]
                    good = left & good[1:] & ~opens[j - 1 : j - 1 + len(left)]
                    if j < k:
                        at = np.flatnonzero(good)
                        good[at] = _maybe(filters[j - 2].value, _hash(_columns(name, at, j, bits)))
                yield _columns(name, np.flatnonzero(good), k, bits)

    return run


def _maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set in a table of 2^n bits."""
    at = h >> _U(64 - (len(table) * 64).bit_length() + 1)
    return (table[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)


def _filter(table: DataFrame, many: int) -> np.ndarray:
    """The bit table of the hashes ``h``, as longs; these are made by Spark, and what reaches the driver is bounded by the table's size."""
    bits = min(max((many * BITS_EACH).bit_length(), 10), FILTER_BITS)
    rows = table.select(F.shiftrightunsigned("h", 64 - bits).alias("h")).selectExpr("shiftright(h, 6) AS at", "shiftleft(1L, cast(h & 63 AS int)) AS bit")
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(_U)


def _keys_of(table: DataFrame) -> np.ndarray:
    """A counted table's keys in ascending order."""
    return np.sort(table.select("c0").toArrow().column(0).to_numpy())


def _named(table: DataFrame, known: Broadcast) -> DataFrame:
    """Counted words (c0, f) as (name, f): the rank of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranks(batch.column(0).to_numpy(), known.value).astype(np.int32)), batch.column(1)], ["name", "f"])

    return table.select("c0", "f").mapInArrow(run, "name int, f long")


def _by_broadcast(spark: SparkSession, texts: DataFrame, max_words: int, least: int, bound: int) -> tuple[list[DataFrame], DataFrame] | None:
    """(levels, totals), or None where there are more frequent words than the bound, or two words share a key.

    Levels have (name, lang, word, f) for words and (name, left, right, f) for longer phrases; totals (lang, n).
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(size // PART_BYTES + 1, 1 << 16)
    table, many = counted(_frequent(texts, _word_keys, 1, parts, least), "word-counts")
    if many > bound:
        return None
    known = spark.sparkContext.broadcast(_keys_of(table))
    of = F.when(F.col("word").isNull(), F.col("lang"))  # totals are kept apart by their language
    words = texts.mapInArrow(_word_texts(known), "name int, lang string, word string, n long").withColumn("of", of).repartition("name", "of")
    words = words.groupBy("name", "of").agg(F.min(F.struct("lang", "word")).alias("lo"), F.max(F.struct("lang", "word")).alias("hi"), F.sum("n").alias("n"))
    kept, _, clashes = counted(words, "words", F.count_if(F.col("lo") != F.col("hi")))
    if clashes:
        return None
    totals = kept.filter("of is not null").select(F.col("of").alias("lang"), "n")
    words = kept.filter("of is null").select("name", "lo.lang", "lo.word").join(maybe_broadcast(_named(table, known), many), "name")
    levels, filters, bits = [words.withColumn("name", F.array("name"))], [], max(1, (many - 1).bit_length())
    for k in range(2, max_words + 1):
        table, found = counted(_frequent(texts, _gram_keys(known, filters, k, bits), -(-k // (KEY_BITS // bits)), parts, least), f"phrases-{k}")
        if k < max_words:
            filters.append(spark.sparkContext.broadcast(_filter(table, found)))
        name = _words_of(k, bits)
        levels.append(table.select(name.alias("name"), F.slice(name, 1, k - 1).alias("left"), F.slice(name, 2, k - 1).alias("right"), "f"))
    return levels, totals


def _by_joins(texts: DataFrame, max_words: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """The same with a row a place: names are joined by shuffles, and a place's right neighbour is the next row of its piece."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", F.posexplode(F.split(lower, PIECE_END)).alias("piece", "text"))
    words = F.filter(F.split("text", BETWEEN_WORDS), lambda w: w != "")
    places = scratch(pieces.select("row", "lang", "piece", F.posexplode(words).alias("at", "word")), "places")
    totals = scratch(places.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "totals")
    table = places.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least)
    levels = [scratch(table.withColumn("name", F.monotonically_increasing_id()), "words")]
    here = scratch(places.join(levels[0], ["lang", "word"]).select("row", "piece", "at", "name"), "named")
    for k in range(2, max_words + 1):
        ahead = Window.partitionBy("row", "piece").orderBy("at")
        pairs = here.select("row", "piece", "at", F.col("name").alias("left"), F.lead("name").over(ahead).alias("right"), F.lead("at").over(ahead).alias("next")).filter("next = at + 1").drop("next")
        pairs = scratch(pairs, "pairs") if k < max_words else pairs
        table = pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least)
        levels.append(scratch(table.withColumn("name", F.monotonically_increasing_id()), f"phrases-{k}"))
        if k < max_words:
            here = scratch(pairs.join(levels[-1], ["left", "right"]).select("row", "piece", "at", "name"), "named")
    return levels, totals


def _lookup(table: DataFrame, by: str, other: DataFrame, many: int, **columns: str) -> DataFrame:
    """``table`` with columns of the row of ``other`` whose name ``by`` holds."""
    side = other.select(F.col("name").alias(by), *[F.col(c).alias(new) for new, c in columns.items()])
    return table.join(maybe_broadcast(side, many), by)


def _counted(table: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A scratch table and how many rows it counts as for a broadcast: bytes of phrases over ``PHRASE_BYTES`` count as too many."""
    kept, many, size = counted(table, name, F.sum(F.octet_length("phrase")))
    return kept, many if (size or 0) <= PHRASE_BYTES else BROADCAST_ROWS + 1


def _described(levels: list[DataFrame]) -> list[DataFrame]:
    """Levels 2 and up with lang, phrase, f, and the counts of a phrase's first 1 to k words (heads) and last 1 to k words (tails), by a step to each parent."""
    known, many = _counted(levels[0].select("name", "lang", F.col("word").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")), "named-1")
    out = []
    for k, level in enumerate(levels[1:], 2):
        new = _lookup(level, "left", known, many, lang="lang", phrase="phrase", heads="heads")
        new = _lookup(new, "right", known, many, last="phrase", tails="tails")
        phrase = F.concat_ws(" ", "phrase", F.substring_index("last", " ", -1))
        known, many = _counted(new.select("name", "left", "right", "lang", phrase.alias("phrase"), "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), f"named-{k}")
        out.append(known)
    return out


def _scored(table: DataFrame, k: int, scale: int) -> DataFrame:
    """Phrases of k words with their lowest cut."""
    exact = lambda c: f"cast({c} as decimal(15,0))"
    cuts = []
    for i in range(1, k):
        l, r = f"heads[{i - 1}]", f"tails[{k - i - 1}]"
        cuts.append(F.expr(f"named_struct('score', ({scale} * {exact('f')} * {exact('f')}) div ({exact(l)} * {exact(r)}), 'cut', {i}, 'l', {l}, 'r', {r})"))
    best = table.withColumn("best", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    return best.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, least: int = 10, cover_percent: int = 50, top: int = 2000, scale: int = 1_000_000, name_bound: int = NAME_BOUND) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``max_words`` words.

    score is floor(scale * a * a / (l * r)) of the lowest cut (ties: the first); counts up to 10^15 stay exact.
    Phrases of which a longer one covers ``cover_percent`` of the occurrences are left out.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit(UNKNOWN_LANG)).alias("lang"))
    levels, totals = _by_broadcast(docs.sparkSession, texts, max_words, least, name_bound) or _by_joins(texts, max_words, least)
    tables, scored = _described(levels), None
    for k, (table, longer) in enumerate(zip(tables, [*tables[1:], None], strict=True), 2):
        if longer is not None:
            cover = longer.select(F.col("left").alias("name"), "f").union(longer.select("right", "f")).groupBy("name").agg(F.max("f").alias("longer"))
            table = table.join(cover, "name", "left").filter(F.coalesce(100 * F.col("longer") < cover_percent * F.col("f"), F.lit(True)))
        best = _scored(table, k, scale)
        scored = best if scored is None else scored.unionByName(best)
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    part = scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    row = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("m"), "phrase", "a", "l", "r", "score")
    best = part.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(row)), 1, top).alias("rows"))  # at most SALTS * top rows a language
    best = best.join(maybe_broadcast(*counted(totals, "totals")), "lang").select("lang", "n", F.posexplode("rows").alias("at", "row"))
    return best.select("lang", (F.col("at") + 1).alias("rank"), "row.phrase", "row.a", "row.l", "row.r", "n", "row.score")
