"""Fill-in-the-middle: texts cut at two tokens and put together in another order, with markers.

A token is a word with the white space before it, or the white space at a text's end. A text of n tokens is cut after
two of the ranks 0 to n, drawn from hashes of its id.

Overlapping chunks: a text's bytes are cut into chunks of ``CHUNK`` bytes, each of which sees one byte of the next. A
token ends at a byte that is no white space and is followed by some, or at the text's end, so two adjacent bytes tell
it (white space is ASCII, and no part of a longer character). All chunks count their ends and characters at once;
prefix sums over the counts tell which chunk owns each cut's rank, and only those chunks are scanned again for the
place. Working arrays hold a window of chunks, however long the text is. Only ranks and lengths come back from Python;
markers are put in and taken out by Spark's string functions.

Null text counts as empty; empty texts and those that hold a marker stay as they are (plain). Rows with a null id draw
from ``seed:`` alone. Repeated rows get the same result. Equal ranks give an empty middle. Further columns pass
through; a result column replaces one of its name. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textnum as tn
from .common import unused

CHUNK = 1 << 16
#: Chunks that are counted at a time.
WINDOW = 16
MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}


def _ends(data: np.ndarray, a: int, b: int, last: np.ndarray) -> np.ndarray:
    """Whether a token ends at each byte of [a, b); ``last`` holds the places of the texts' last bytes, in order."""
    space = tn.IS_SPACE[data[a : b + 1]]
    out = ~space[: b - a]
    out[: len(space) - 1] &= space[1:]
    out[last[np.searchsorted(last, a) : np.searchsorted(last, b)] - a] = True
    return out


def _is_char(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


class Chunks:
    """The counts of all chunks of a run of texts, and their prefix sums."""

    def __init__(self, data: np.ndarray, off: np.ndarray, chunk: int = CHUNK):
        length = np.diff(off)
        of = (length + chunk - 1) // chunk
        self.data, self.last = data, off[1:][length > 0] - 1
        self.first = np.concatenate([[0], np.cumsum(of)])  # each text's first chunk
        text = np.repeat(np.arange(len(length)), of)
        self.start = off[text] + (np.arange(self.first[-1]) - self.first[text]) * chunk
        self.end = np.minimum(self.start + chunk, off[text + 1])
        ends, chars = (np.zeros(len(text) + 1, np.int64) for _ in range(2))
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + WINDOW * chunk, side="right")))
            a, b = self.start[i], self.end[j - 1]
            ends[i + 1 : j + 1] = np.add.reduceat(_ends(data, a, b, self.last), self.start[i:j] - a, dtype=np.int64)
            chars[i + 1 : j + 1] = np.add.reduceat(_is_char(data[a:b]), self.start[i:j] - a, dtype=np.int64)
            i = j
        self.ends, self.chars = np.cumsum(ends), np.cumsum(chars)
        self.n = self.ends[self.first[1:]] - self.ends[self.first[:-1]]

    def chars_before(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The characters of each text's first ``rank`` tokens: the owning chunk is found by the sums, and scanned."""
        goal = self.ends[self.first[text]] + rank
        owner = np.searchsorted(self.ends, goal) - 1
        out = np.zeros(len(text), np.int64)
        for i in np.flatnonzero(rank > 0):
            c = owner[i]
            a = self.start[c]
            at = np.flatnonzero(_ends(self.data, a, self.end[c], self.last))[goal[i] - self.ends[c] - 1]
            out[i] = self.chars[c] - self.chars[self.first[text[i]]] + np.count_nonzero(_is_char(self.data[a : a + at + 1]))
        return out


def cuts(texts: pa.Array, u: np.ndarray, v: np.ndarray, wanted: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, characters before the first cut, characters between the cuts) of each text; 0 and 0 where no cut is wanted."""
    n, prefix, middle = (np.zeros(len(texts), np.int64) for _ in range(3))
    for a, b, data, off in tn.slices(texts):
        found = Chunks(data, off, chunk)
        n[a:b] = found.n
        text = np.flatnonzero(wanted[a:b])
        x, y = u[a:b][text] % (found.n[text] + 1), v[a:b][text] % (found.n[text] + 1)
        prefix[a + text] = found.chars_before(text, np.minimum(x, y))
        middle[a + text] = found.chars_before(text, np.maximum(x, y)) - prefix[a + text]
    return n, prefix, middle


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "prefix", "middle")]))
def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, u, v, wanted in batches:
        found = cuts(pa.array(text, pa.string(), from_pandas=True), u.to_numpy(), v.to_numpy(), wanted.to_numpy(bool))
        yield pd.DataFrame(dict(zip(("n", "prefix", "middle"), found, strict=True)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    digest, found = unused(docs, "digest"), unused(docs, "cut")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    draw = lambda i: F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")
    plain = text == ""
    for marker in MARKERS.values():
        plain |= F.contains(text, F.lit(marker))
    form = F.when(plain | (draw(3) % 100 >= percent), "plain").when(draw(4) % 100 < spm_percent, "spm").otherwise("psm")
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    formed = unused(docs, "formed")
    drawn = docs.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)).withColumn(formed, form)
    cut = drawn.withColumn(found, _cut(text, draw(1), draw(2), F.col(formed) != "plain"))
    p, m = F.col(f"{found}.prefix").cast("int"), F.col(f"{found}.middle").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), p), F.substr(text, p + 1, m), F.substr(text, p + m + 1)
    put = {k: F.lit(v) for k, v in MARKERS.items()}
    output = F.when(F.col(formed) == "psm", F.concat(put["prefix"], prefix, put["suffix"], suffix, put["middle"], middle))
    output = output.when(F.col(formed) == "spm", F.concat(put["suffix"], suffix, put["prefix"], prefix, put["middle"], middle)).otherwise(text)
    told = lambda c: F.when(F.col(formed) != "plain", F.col(f"{found}.{c}"))
    return cut.select(*kept, F.col(f"{found}.n").alias("n"), F.col(formed).alias("form"), told("prefix").alias("prefix_chars"), told("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of a form was made of. No marker can begin within a part, so the first match of each is the one put in."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    part = lambda s, marker, i: F.split_part(s, F.lit(MARKERS[marker]), F.lit(i))
    middle = part(output, "middle", 2)
    psm = F.concat(F.substr(part(output, "suffix", 1), F.lit(len(MARKERS["prefix"]) + 1)), middle, part(part(output, "suffix", 2), "middle", 1))
    spm = F.concat(part(part(output, "prefix", 2), "middle", 1), middle, F.substr(part(output, "prefix", 1), F.lit(len(MARKERS["suffix"]) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
