"""WARC archives in Zstandard: one record a frame, with the dictionary in the archive's leading skippable frame.

Writing: Spark's text sink writes raw bytes through the cluster's file system and commit protocol. A row is one frame,
and the line separator is an empty skippable frame, so that files are plain concatenations of frames that any reader of
.warc.zst takes. A task starts a new archive, each with its dictionary frame first, after ``MAX_ROWS`` rows; an archive
that reaches ``MAX_BYTES`` is filled up with empty rows, so both bounds hold.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is a response, and the others
are revisits that refer to it. Equal means equal SHA-1 and length.

Reading takes any archive of this kind, of one record a frame: each archive is one binary row. The dictionary is loaded
from the leading skippable frame, if there is one; frames are found by their headers and block lengths and decoded one at
a time, whether or not they state their size. Version line, required headers, the content length, the record's end and,
where a response has them, its HTTP content length and payload digest (SHA-1, SHA-256 or MD5, hex or base32) are checked;
a chunked payload is joined, and its digest may be of either form. Record ids are any text. What is wrong raises
``WarcError``, or with ``errors="keep"`` gives a row with the reason in ``error`` and null fields, after which reading goes on with
the next frame (damage to the frames themselves ends that archive with such a row).

Defined results: a null payload counts as empty; a null URL is written as ``urn:x-page:unknown``; a row with a null id
keeps a null id and is a revisit only if its payload has a response with an id; rows that repeat the largest id are
responses each. Very long payloads are written whole (a record holds at most ``MAX_RECORD`` bytes). Further columns,
whatever their names, are ignored. An empty table gives an archive without records, or none.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, scratch_path

DICTIONARY_MAGIC, SKIPPABLE_LOW, SKIPPABLE_HIGH, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIPPABLE_LOW, 0).decode("ascii")
MAX_ROWS, MAX_BYTES, MAX_RECORD = 4096, 8 << 20, 1 << 30
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 100, 4 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 32


class WarcError(ValueError):
    pass


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary from a bounded number of bounded samples; raw content where they are too few to train on."""
    samples = [p[:SAMPLE_BYTES] for p in payloads[:SAMPLES] if p]
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record with its two closing line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-page:unknown"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, opening, rows, size = None, b"", 0, 0
        for batch in batches:
            out = []
            page, url, html, digest, refers, revisit = (c.to_pylist() for c in batch.columns)
            payloads = [(h or "").encode() for h in html]
            if compressor is None:
                raw = train_dictionary(payloads)
                data = zstandard.ZstdCompressionDict(raw)
                data.precompute_compress(level=level)
                compressor = zstandard.ZstdCompressor(dict_data=data, level=level, write_content_size=True, write_checksum=True)
                packed = zstandard.ZstdCompressor(level=level).compress(raw)
                opening = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
            for i, payload in enumerate(payloads):
                if size >= MAX_BYTES and rows:
                    out += [b""] * (MAX_ROWS - rows)
                    rows = 0
                elif rows == MAX_ROWS:
                    rows = 0
                if not rows:
                    out.append(opening)
                    rows, size = 1, len(opening)
                out.append(compressor.compress(record(page[i], url[i], payload, digest[i], refers[i], revisit[i], date)))
                rows, size = rows + 1, size + len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Write all rows as records below ``path``, a folder of a file system that Spark can write to."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    equal = scratch(rows.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and keep is not null").select("digest", "n", "keep"), "payloads")
    if equal.count() <= BROADCAST_ROWS:
        told = rows.join(F.broadcast(equal), ["digest", "n"], "left")
    else:  # one payload may have a large part of all rows, so the rows of each are dealt over some partitions
        told = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["digest", "n", "salt"], "left")
    revisit = F.coalesce(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.lit(False))
    frames = told.select("page_id", "url", "html", "digest", "keep", revisit.alias("revisit")).mapInArrow(_write(date, level), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", MAX_ROWS).text(path)


def frames(data: memoryview | bytes) -> Iterator[tuple[int, memoryview]]:
    """(magic number, whole frame) of each frame, found by headers and block lengths without decoding."""
    view, at = memoryview(data).cast("B"), 0
    while at < len(view):
        if at + 4 > len(view):
            raise WarcError("the archive ends in a frame's magic number")
        (magic,) = struct.unpack_from("<I", view, at)
        start = at
        try:
            if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
                at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            elif magic == FRAME_MAGIC:
                form = view[at + 4]
                single = form >> 5 & 1
                at += 5 + (not single) + (0, 1, 2, 4)[form & 3] + (single, 2, 4, 8)[form >> 6]
                last = 0
                while not last:
                    block = view[at] | view[at + 1] << 8 | view[at + 2] << 16
                    last = block & 1
                    at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
                at += 4 * (form >> 2 & 1)
            else:
                raise WarcError(f"no frame starts at byte {at}")
        except (IndexError, struct.error):
            raise WarcError("the archive ends within a frame") from None
        if at > len(view):
            raise WarcError("the archive ends within a frame")
        yield magic, view[start:at]


_DIGESTS = {"sha1": 20, "sha256": 32, "md5": 16}


def _digest(value: str) -> tuple[str, str | None]:
    """Algorithm and lower-case hex of a digest header; None for another algorithm or spelling."""
    name, _, text = value.partition(":")
    name = name.lower().replace("-", "")
    size = _DIGESTS.get(name, 0)
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except (ValueError, binascii.Error):
        return name, None
    return name, raw.hex() if size and len(raw) == size else None


def _unchunked(body: bytes) -> bytes | None:
    """The content of an HTTP body in chunks; None if it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def parse(raw: bytes) -> dict:
    """The fields of one record; raises WarcError unless headers and lengths are sound."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC version line: {version[:40]!r}")
    fields, last = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a folded header goes on
            fields[last] += " " + line.strip().decode(errors="replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        last = name.strip().lower().decode("latin-1")
        fields[last] = value.strip().decode(errors="replace")
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
        raise WarcError(f"missing headers: {missing}")
    size = fields["content-length"]
    if not size.isdecimal() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"content length {size} where {len(rest) - 4} bytes stand")
    kind, block = fields["warc-type"].lower(), rest[:-4]
    name, stated = _digest(fields.get("warc-payload-digest", ""))
    found = {"fields": fields, "type": kind, "block": block, "payload": None, "payload_bytes": None, "digest": stated}
    if kind not in ("response", "revisit"):
        return found
    http, blank, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", http, re.I)
    if kind == "revisit":
        if "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields and not stated:
            raise WarcError("a revisit needs a record, a page or a digest to refer to")
        found["payload_bytes"] = int(length[1]) if length else None
        return found
    plain = _unchunked(payload) if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", http, re.I) else None
    if plain is None and length and len(payload) != int(length[1]):
        raise WarcError(f"HTTP content length {int(length[1])} where {len(payload)} bytes stand")
    forms = [payload] if plain is None else [plain, payload]
    if stated and stated not in (hashlib.new(name, x).hexdigest() for x in forms):
        raise WarcError("the payload's digest differs")
    found |= {"payload": forms[0], "payload_bytes": len(forms[0]), "digest": stated or hashlib.sha1(forms[0]).hexdigest()}
    return found


def records(archive: memoryview | bytes, errors: str = "raise") -> Iterator[dict]:
    """All records of an archive, decoded one frame at a time; with ``errors`` "keep", {"error": reason} for a bad one."""
    decoder = zstandard.ZstdDecompressor()
    found = enumerate(frames(archive))
    while True:
        try:
            i, (magic, frame) = next(found)
        except StopIteration:
            return
        except WarcError as e:
            if errors == "raise":
                raise
            yield {"error": str(e)}
            return
        try:
            if magic == DICTIONARY_MAGIC:
                if i:
                    raise WarcError("a dictionary frame must lead its archive")
                raw = bytes(frame[8:])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = decoder.decompress(raw, max_output_size=MAX_RECORD)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            elif magic == FRAME_MAGIC:
                size = zstandard.frame_content_size(frame[:18])
                if size > MAX_RECORD:
                    raise WarcError(f"a frame states {size} bytes")
                raw = decoder.decompress(frame) if size >= 0 else decoder.stream_reader(frame).read(MAX_RECORD + 1)
                if len(raw) > MAX_RECORD:
                    raise WarcError(f"a frame holds over {MAX_RECORD} bytes")
                yield parse(raw)
        except (WarcError, zstandard.ZstdError) as e:
            if errors == "raise":
                raise e if isinstance(e, WarcError) else WarcError(f"a frame can't be decoded: {e}") from None
            yield {"error": str(e)}


def read_archives(spark: SparkSession, path: str, payloads: bool = True, errors: str = "raise") -> DataFrame:
    """record_id, url, record_type, refers_to (a record id), payload_bytes, payload_digest (hex), error and, if asked for, payload (null but for responses)."""
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "error"] + ["payload"] * payloads
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payloads

    def row(r: dict) -> tuple:
        f = r.get("fields", {})
        return (f.get("warc-record-id"), f.get("warc-target-uri"), r.get("type"), f.get("warc-refers-to"), r.get("payload_bytes"), r.get("digest"), r.get("error"), r.get("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in records(memoryview(content.as_buffer()), errors):
                    rows.append(row(r))
                    held += len(r.get("payload") or b"") if payloads else 0
                    if len(rows) == 512 or held > MAX_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
                yield flush(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names))


def archived(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without the payloads; page ids stand for record ids."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")  # noqa: E731  null for a null id
    back = read_archives(pages.sparkSession, path, payloads=False)
    return back.select(page("record_id").alias("page_id"), "url", "record_type", page("refers_to").alias("refers_to"), "payload_bytes", "payload_digest")
