"""Media columns whose types are sniffed from the bytes.

An Aho-Corasick automaton finds every signature (magic bytes) of a payload in one pass. A format's
validator then confirms its structure and says how long it is, so that a chance match is no find.
What begins at the first byte corrects the declared type; what is confirmed further in is carved
out as embedded media.

The query stores each text as 8-bit mono PCM in a RIFF/WAVE file with a declared type that knows
nothing, writes the column, reads it back, sniffs it, and takes the samples from where the sniffed
structure says they are.

Null text is empty (a payload of 64 zeros); null and repeated identifiers are stored like others;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc32_sql, slim, table, written
from barloom.llm.textblock import tidied

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


class Found(NamedTuple):
    """Confirmed media: its type, and the bytes that it takes."""

    kind: str
    start: int
    end: int


def _png(b: bytes, at: int) -> int | None:
    here = at + 8
    while here + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, here)
        if here + 12 + size > len(b) or zlib.crc32(b[here + 4 : here + 8 + size]) != struct.unpack_from(">I", b, here + 8 + size)[0]:
            return None
        if here == at + 8 and name != b"IHDR":
            return None
        here += 12 + size
        if name == b"IEND":
            return here
    return None


def _gif(b: bytes, at: int) -> int | None:
    def blocks(here: int) -> int | None:
        while here < len(b):
            if not b[here]:
                return here + 1
            here += 1 + b[here]
        return None

    if at + 13 > len(b):
        return None
    here = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while here is not None and here < len(b):
        if b[here] == 0x3B:
            return here + 1
        if b[here] == 0x21:
            here = blocks(here + 2)
        elif b[here] == 0x2C and here + 10 < len(b):
            here = blocks(here + 11 + (3 << (b[here + 9] & 7) + 1 if b[here + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    here, frame = at + 2, False
    while here + 4 <= len(b) and b[here] == 0xFF:
        mark, size = b[here + 1], struct.unpack_from(">H", b, here + 2)[0]
        if size < 2 or mark in (0x00, 0xFF, 0xD8):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        here += 2 + size
        if mark == 0xDA:  # entropy-coded bytes: up to a mark that isn't a stuffed byte or a restart
            while True:
                here = b.find(b"\xff", here)
                if here < 0 or here + 1 >= len(b):
                    return None
                if b[here + 1] == 0xD9:
                    return here + 2 if frame else None
                if b[here + 1] and not 0xD0 <= b[here + 1] <= 0xD7:
                    break
                here += 2
    return None


def _riff(form: bytes, need: bytes):
    def check(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        names = {name for name, _, _ in riff_chunks(b, at, end)}
        return end if need in names else None

    return check


def riff_chunks(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of each chunk's body; stops where one doesn't fit."""
    here = at + 12
    while here + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, here)
        if here + 8 + size > end:
            return
        yield name, here + 8, here + 8 + size
        here += 8 + size + (size & 1)


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, spare, pixels, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not spare and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= pixels < size <= len(b) - at else None


#: Bytes of a gzip header's name or comment at most, and what is inflated at once.
GZIP_NAME, INFLATED = 4096, 1 << 20
#: Gzip members are inflated for as long as that takes in this many bytes for each byte of the payload, and EFFORT_LEAST; then hits count as unconfirmed.
EFFORT, EFFORT_LEAST = 16, 1 << 20


class Search:
    """What the checks of one payload share, so that hits that come to nothing don't each read on to its end."""

    def __init__(self, payload: bytes):
        self.payload, self.view = payload, memoryview(payload)
        self.effort = EFFORT * len(payload) + EFFORT_LEAST
        self.next: dict[bytes, tuple[int, int]] = {}

    def find(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1. Hits ascend, so a payload is searched once."""
        since, found = self.next.get(mark, (0, -2))
        if found == -2 or since > at or -1 < found < at:
            found = self.payload.find(mark, at)
            self.next[mark] = (at, found)
        return found


def _gzip(b: Search, at: int) -> int | None:
    raw, here = b.payload, at + 10
    if here > len(raw) or raw[at + 3] & 0xE0:
        return None
    flags = raw[at + 3]
    if flags & 4:  # extra field
        here += 2 + int.from_bytes(raw[here : here + 2], "little")
    for flag in (8, 16):  # name, comment
        if flags & flag:
            end = raw.find(b"\0", here, here + GZIP_NAME)
            if end < 0:
                return None
            here = end + 1
    here += 2 if flags & 2 else 0
    reader, check, size = zlib.decompressobj(-15), 0, 0
    rest: bytes | memoryview = b""
    try:
        while not reader.eof:
            if not len(rest):
                rest = b.view[here : here + (1 << 12)]
                here += len(rest)
                if not len(rest):
                    return None
            b.effort -= len(rest)
            if b.effort < 0:
                return None
            out = reader.decompress(rest, INFLATED)
            check, size = zlib.crc32(out, check), size + len(out)
            rest = reader.unconsumed_tail
    except zlib.error:
        return None
    end = here - len(reader.unused_data)
    told = struct.unpack_from("<II", raw, end) if end + 8 <= len(raw) else None
    return end + 8 if told == (check, size & 0xFFFFFFFF) else None


def _ogg(b: bytes, at: int) -> int | None:
    here = at
    while here + 27 <= len(b) and b[here : here + 5] == b"OggS\0":
        table_end = here + 27 + b[here + 26]
        end = table_end + sum(b[here + 27 : table_end])
        if table_end > len(b) or end > len(b):
            return None
        last, here = b[here + 5] & 4, end
        if last:
            return here
    return None


def _pdf(b: Search, at: int) -> int | None:
    end = b.find(b"%%EOF", at)
    return end + 5 if end >= 0 and 0 <= b.find(b"startxref", at) < end else None


def _flac(b: bytes, at: int) -> int | None:
    here, first = at + 4, True
    while here + 4 <= len(b):
        kind, size = b[here] & 0x7F, int.from_bytes(b[here + 1 : here + 4])
        if first and (kind != 0 or size != 34) or here + 4 + size > len(b):
            return None
        last, here, first = b[here] & 0x80, here + 4 + size, False
        if last:  # frames say no length: up to the end
            return len(b) if b[here : here + 1] == b"\xff" else None
    return None


#: Magic bytes, media type, and what confirms the rest.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", "video/x-msvideo", _riff(b"AVI ", b"LIST")),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "application/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    own, by_magic = ahocorasick.Automaton(), {}
    for magic, kind, check in FORMATS:
        by_magic.setdefault(magic, []).append((kind, check))
    for magic, checks in by_magic.items():
        own.add_word(magic.decode("latin-1"), (len(magic), checks))
    own.make_automaton()
    return own


#: Checks that are given the payload's Search.
SEARCHING = (_gzip, _pdf)


def sniffed(payload: bytes) -> list[Found]:
    """All confirmed media of a payload, by where they begin; some may lie within others, but none within another of its kind."""
    out, search, past = [], Search(payload), {}
    for last, (length, checks) in automaton().iter(payload.decode("latin-1")):
        start = last + 1 - length
        for kind, check in checks:
            if start < past.get(kind, 0):
                continue
            end = check(search if check in SEARCHING else payload, start)
            if end is not None:
                past[kind] = end
                out.append(Found(kind, start, end))
    return sorted(out, key=lambda f: f.start)


def corrected(declared: str, found: list[Found]) -> str:
    """The type of what begins at the first byte, else the declared one."""
    return next((f.kind for f in found if f.start == 0), declared)


def as_wave(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM. The sizes of RIFF have 32 bits."""
    body = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def samples_of(media: bytes, wave: Found) -> bytes:
    return next(media[a:b] for name, a, b in riff_chunks(media, wave.start, wave.end) if name == b"data")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, declared, media``: each text as a media column's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.encode() for x in batch.column(1).to_pylist()]
            media = [as_wave(x + b"\0" * (-len(x) % UNIT or UNIT * (not x))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([UNKNOWN] * len(raw), pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return slim(docs, key, text).withColumn(key, F.col(key).cast("long")).mapInArrow(tidied(run), "doc_id long, n_bytes long, declared string, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, embedded array<struct<kind: string, start: long, length: long>>"


def features(stored: DataFrame) -> DataFrame:
    """Sniffs each stored value and describes its samples: type, how many, their mean, and how often they cross the middle."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")[:8]] + ["embedded"]
        for batch in batches:
            rows = []
            for doc, n, declared, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sniffed(media)
                kind = corrected(declared, found)
                payload = samples_of(media, found[0]) if kind == "audio/wav" else media
                value = np.frombuffer(payload, np.uint8)
                crossings = int(np.count_nonzero(np.diff((value >= 128).view(np.int8))))
                inner = [{"kind": f.kind, "start": f.start, "length": f.end - f.start} for f in found if f.start]
                feature = f"{kind};samples={len(value)};mean={value.mean() if len(value) else 0:.4f};crossings={crossings};embedded={len(inner)}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, inner))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(tidied(run), FEATURES)


def op6_signature_sniffed_media(spark, sf_dir) -> DataFrame:
    found = features(written(store(table(spark, sf_dir, "documents")), "media"))
    carved = F.transform("embedded", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["length"].cast("string")))
    return found.withColumn("carved", F.array_join(carved, ",")).drop("embedded")


def _little(number: str) -> str:
    """SQL for the digits of four bytes, lowest first."""
    return "printf('%02X%02X%02X%02X', " + ", ".join(f"({number}) >> {s} & 255" for s in (0, 8, 16, 24)) + ")"


#: SQL can't follow the validators. It says that no text holds media, which is so in the tables: where one does, the rows differ.
ORACLE_SQL = f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
t AS (SELECT doc_id, len(digits) // 2 AS n, rpad(digits, greatest((len(digits) + {2 * UNIT - 1}) // {2 * UNIT}, 1)::INTEGER * {2 * UNIT}, '0') AS payload FROM raw),
m AS (
    SELECT *, len(payload) // 2 AS size, {as_wave(b"")[:4].hex().upper()!r} || {_little("36 + len(payload) // 2")} || {as_wave(b"")[8:40].hex().upper()!r} || {_little("len(payload) // 2")} || payload AS media,
        regexp_extract_all(payload, '..') AS bytes FROM t
)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, {crc32_sql(f"right(payload, {2 * UNIT})")} AS tail_crc32,
    len(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
    printf('audio/wav;samples=%d;mean=%.4f;crossings=%d;embedded=0', size, list_sum(list_transform(bytes, lambda x: ('0x' || x)::BIGINT))::DOUBLE / size,
        len(regexp_replace(array_to_string(list_transform(bytes, lambda x: CASE WHEN x >= '80' THEN 'h' ELSE 'l' END), ''), 'h+|l+', 'x', 'g')) - 1) AS feature, '' AS carved
FROM m
"""
