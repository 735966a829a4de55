"""Byte-level BPE: texts to token ids and back, with the tiktoken library and a local rank file.

The driver reads the rank file and broadcasts its bytes (bounded by ``MAX_RANK_BYTES``), so executors need no copy.
Long texts are cut at boundaries that no match of the split pattern can cross (see ``safe_cuts``), so the pieces'
ids joined are the ids of the whole. Decoding gives raw bytes, which need not be UTF-8.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; rows that repeat are
encoded each; further columns are kept as they are, but for one that is called as the result, which the result replaces.
Special tokens are ordinary text. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import schema_with

MAX_RANK_BYTES = 64 << 20
PIECE_CHARS = 1 << 16
#: A character that is no white space by any definition in use, then a space or line feed; or a letter or digit and then another class.
_CUT = re.compile(r"[^\s\x1c-\x1f](?=[ \n])")
_CLASS_CUT = re.compile(r"[a-zA-Z](?=[0-9.,;:!?(){}<>|/+*=-])|[0-9](?=[a-zA-Z.,;:!?(){}<>|/+*=-])")

# The split patterns of which ``safe_cuts`` holds, that of the 50k byte-level vocabularies in its two spellings.
CUT_PATTERNS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)

_encoders: dict[str, object] = {}


def encoder(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file's bytes; one for each worker and file."""
    import tiktoken

    key = hashlib.sha256(ranks + b"\0" + pattern.encode()).hexdigest()
    if key not in _encoders:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_cuts(text: str, piece: int = PIECE_CHARS) -> list[int]:
    """Borders of pieces of about ``piece`` characters, at places that are borders of matches whatever stands around.

    In the patterns of ``CUT_PATTERNS`` (a word, number or symbol run with at most one leading space, runs of white
    space, contractions) no match goes on from a non-space to a space or line feed, from an ASCII letter to a digit or
    mark, or from a digit to a letter or mark; and none looks behind. A text without such a place stays one piece.
    """
    cuts, at = [0], 0
    while len(text) - at > piece:
        found = _CUT.search(text, at + piece - 1) or _CLASS_CUT.search(text, at + piece - 1)
        if not found:
            break
        at = found.end()
        cuts.append(at)
    return [*cuts, len(text)]


def encode(enc, text: str, piece: int = PIECE_CHARS) -> list[int]:
    """A text's ids. Texts are cut only under patterns whose matches are known not to cross a cut; under others they stay whole."""
    if len(text) <= piece or enc._pat_str not in CUT_PATTERNS:
        return enc.encode_ordinary(text)
    cuts, ids = safe_cuts(text, piece), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        ids += enc.encode_ordinary(text[a:b])
    return ids


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes and can't be broadcast")
    return spark.sparkContext.broadcast(data)


def with_ids(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` and its texts' ids as array<int>."""
    ranks = _ranks(docs.sparkSession, rank_path)
    docs = docs.drop(ids_col)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            ids = pa.array([encode(enc, t or "") for t in batch.column(where).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, schema_with(docs, **{ids_col: "array<int>"}))


def with_bytes(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` and the raw bytes of its ids; null for null ids. An id outside the vocabulary raises KeyError."""
    ranks = _ranks(docs.sparkSession, rank_path)
    docs = docs.drop(bytes_col)
    where = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            raw = pa.array([None if x is None else enc.decode_bytes(x) for x in batch.column(where).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, bytes_col])

    return docs.mapInArrow(run, schema_with(docs, **{bytes_col: "binary"}))


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row, without the ids leaving the worker."""
    ranks = _ranks(docs.sparkSession, rank_path)
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids_sha, raw_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(enc, text or "")
                n.append(len(ids))
                ids_sha.append(sha(",".join([names[i] for i in ids]).encode()))
                raw_sha.append(sha(enc.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
