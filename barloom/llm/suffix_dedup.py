"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier (in a document with a
smaller identifier, or earlier in the same one). Not every suffix is sorted: each window of LENGTH
bytes has an anchor, the start of its ``GRAM`` bytes with the smallest hash, and equal windows have
equal anchors, so it is enough to sort the suffixes at anchors, with what stands before them. One
anchor serves some 35 windows.

1. ``parts`` holds the texts, some MB to a row, with their anchors. Where a text repeats itself at
   short distance (rulers, padding) an anchor whose windows equal those of an earlier one of the same
   text goes at once, a chunk at a time; its windows are kept as ranges that are known to repeat.
2. Hashes of the anchors' GRAM bytes, counted in each part, are dealt out by hash; those seen once
   can't repeat, and of those seen more than HOT times each window is sorted by itself, in the bucket
   of its own hash. In the same exchange texts that equal an earlier one are found; they need no look
   at their suffixes.
3. Each part sorts its suffixes at anchors seen again, drops those that equal an earlier one in the
   part (whose windows all repeat), and sends sorted runs, front-coded, to buckets by the hash.
4. A bucket merges its runs by a loser tree: every contender knows how many bytes it shares with the
   last winner, so a longer share wins unread, and equal shares are compared from there on. The
   shares that come out are the suffix array's common prefixes; with them the windows of each anchor
   that stand in an equal earlier one are found for all offsets. Runs are decoded as the tree asks
   for them, and what comes out is looked at in blocks that end where the shared prefix is shorter
   than GRAM, so that equal windows are never in two. Buckets grow in number with the text, not in size.
5. The windows go back to the parts, which remove what they cover.

Null text is empty; null identifiers come after all others; rows that repeat an identifier come in
the order of their texts' digests, and of rows that repeat both one is the earliest; texts shorter
than LENGTH lose nothing; an empty table gives no rows; other columns are not read. A text longer
than ``PART_BYTES`` is a part of its own: its task holds it with its anchors (some 17 bytes for each of about three in a hundred bytes), and works on half a MB at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches, table, written
from barloom.llm.textblock import gather, mixed, range_hashes, text_bytes, tidied

LENGTH = 100
GRAM = 32
#: Places in a window where its anchor can be.
PLACES = LENGTH - GRAM + 1
#: The key of a suffix: LENGTH bytes from the anchor on, then those before it, backwards; what windows can't reach is 0.
KEY = LENGTH + PLACES - 1
PART_BYTES = 8 << 20
CHUNK = 1 << 19
#: Keys that are built or compared at once.
KEYS = 1 << 14
#: Anchors with the same bytes up to which they share a bucket.
HOT = 1 << 18
#: Merged suffixes that are looked at together, if the shared prefix lets them end there.
BLOCK = 1 << 16
#: Text whose suffixes go to one bucket, where there is more than the shuffle partitions' buckets are for.
BUCKET_BYTES = 32 << 20
LAST = np.iinfo(np.int64).max
ROWS = "part string, bucket int, body binary"
SCHEMA = pa.schema([("part", pa.string()), ("bucket", pa.int32()), ("body", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, source_sha256 string, kept binary"
#: Buckets of rows that aren't merged: a part's texts, and (this or below) what a part knows by itself.
TEXTS, COVERED = -1, -2


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays with their names, compressed one after another, so that no copy holds all of them."""
    head = ";".join(f"{name},{x.dtype.str},{len(x)}" for name, x in arrays.items()).encode() + b"\n"
    own = zstandard.ZstdCompressor(level=3).compressobj(size=len(head) + sum(x.nbytes for x in arrays.values()))
    out = [own.compress(head)]
    for x in arrays.values():
        if len(x):
            planes = np.ascontiguousarray(x).view(np.uint8)
            out.append(own.compress(np.ascontiguousarray(planes.reshape(-1, x.dtype.itemsize).T) if x.dtype.itemsize > 1 else planes))
    out.append(own.flush())
    return b"".join(out)


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    body = zstandard.decompress(raw)
    at = body.index(b"\n") + 1
    out = {}
    for item in body[: at - 1].decode().split(";"):
        name, kind, n = item.split(",")
        kind, n = np.dtype(kind), int(n)
        if not n:
            out[name] = np.empty(0, kind)
            continue
        own = np.frombuffer(body, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out[name] = np.ascontiguousarray(own.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if kind.itemsize > 1 else own.view(kind)
    return out


def _batch(*rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def anchors(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of some texts, each with the first and last window that it serves, and ranges of windows that repeat earlier ones of their text. All are places in ``body``."""
    found, known = [], []
    for c in range(0, len(body), CHUNK):
        own = body[c : c + CHUNK + LENGTH - 1]
        n = len(own) - GRAM + 1
        if n < PLACES:
            break
        start = np.arange(n)
        key = (range_hashes(own, start, start + GRAM) >> np.uint64(24) << np.uint64(24)) | start.astype(np.uint64)
        have = 1
        while have < PLACES:  # the least of ``have`` neighbours, then of more
            step = min(have, PLACES - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        window = start[: len(key)] + c
        inside = window + LENGTH <= at[np.searchsorted(at, window, "right")]
        place, low, high = _runs_of(window[inside], (key[inside] & np.uint64((1 << 24) - 1)).astype(np.int64) + c)
        doc = np.searchsorted(at, low, "right")
        copy = copies(body, place, low, high, span_hashes(body, place, low, high) ^ mixed(doc.astype(np.uint64))) if len(low) else np.empty(0, bool)
        known.append(_ranges(low[copy], high[copy]))
        found.append((place[~copy], low[~copy], high[~copy]))
    if not found:
        return (np.empty(0, np.int64),) * 5
    again = _ranges(*(np.concatenate(x) for x in zip(*known, strict=True)))
    place, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (low[1:] != high[:-1] + 1))[: len(place)])
    return place[new], low[new], high[np.append(new[1:], len(high)) - 1] if len(high) else high, *again


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ranges, those that touch as one. Windows of two texts never touch."""
    new = np.flatnonzero(np.append(True, low[1:] != high[:-1] + 1)[: len(low)])
    return low[new], high[np.append(new[1:], len(high)) - 1] if len(high) else high


def span_hashes(text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the bytes of all windows of each anchor, and where the anchor is in them. ``low`` ascends."""
    out = np.empty(len(low), np.uint64)
    a = 0
    while a < len(low):
        k = int(low[a])
        b = int(np.searchsorted(low, k + CHUNK))
        own = text[k : int(high[a:b].max()) + LENGTH]
        out[a:b] = range_hashes(own, low[a:b] - k, high[a:b] + LENGTH - k) ^ mixed((place[a:b] - low[a:b]).astype(np.uint64))
        a = b
    return out


def copies(text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which anchors have the same windows as the first of their ``name`` (a hash). Exact: bytes are compared."""
    order = np.argsort(name, kind="stable")
    later = np.append(False, name[order][1:] == name[order][:-1])[: len(name)]
    first = order[np.maximum.accumulate(np.where(later, 0, np.arange(len(name))))]
    hit, of = order[later], first[later]
    out = np.zeros(len(name), bool)
    for k in range(0, len(hit), KEYS):
        i, j = hit[k : k + KEYS], of[k : k + KEYS]
        alike = (place[i] - low[i] == place[j] - low[j]) & (high[i] - place[i] == high[j] - place[j])
        out[i] = alike & (keys_of(text, place[i], low[i], high[i]) == keys_of(text, place[j], low[j], high[j])).all(axis=1)
    return out


def _runs_of(window: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of one anchor as one run: anchor, first and last window."""
    if not len(window):
        return anchor, window, window
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    return anchor[new], window[new], window[np.append(new[1:], len(window)) - 1]


def parts(docs: DataFrame, key: str, text: str, part_bytes: int, whole: bool = False) -> DataFrame:
    """Rows with the identifiers, digests, texts and anchors of some texts each; with ``whole`` also with the documents' other columns."""

    def flush(ids: list, bodies: list[np.ndarray], sizes: list[np.ndarray], others: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, at = np.concatenate(bodies), np.append(0, np.cumsum(np.concatenate(sizes)))
        bodies.clear()
        digest = np.frombuffer(b"".join(hashlib.sha256(body[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint8)
        place, low, high, known_low, known_high = anchors(body, at)
        doc = np.searchsorted(at, low, "right") - 1
        order = np.array([LAST if x is None else x for x in ids], np.int64)
        null = np.array([x is None for x in ids], np.uint8)
        yield _batch((uuid.uuid4().hex, TEXTS, packed(order=order, null=null, digest=digest, size=np.diff(at), text=body, back=(place - low).astype(np.uint8), windows=(high - low).astype(np.uint8), low=np.diff(low - at[doc], prepend=0).astype(np.int32), doc=np.diff(doc, prepend=0).astype(np.int32), known_low=known_low, known_high=known_high, others=_stream(others))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, sizes, others, held = [], [], [], [], 0
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            if held and held + len(body) > part_bytes:
                yield from flush(ids, bodies, sizes, others)
                ids, bodies, sizes, others, held = [], [], [], [], 0
            ids += batch.column(0).to_pylist()
            bodies.append(body.copy())
            sizes.append(np.diff(at))
            if whole:
                others.append(batch.select(range(2, batch.num_columns)))
            held += len(body)
        if ids:
            yield from flush(ids, bodies, sizes, others)

    small_batches(docs.sparkSession)
    body = F.col(f"`{text}`")
    columns = [F.col(f"`{key}`").cast("long").alias("_id"), F.coalesce(body, F.lit("")).alias("_text")]
    if whole:
        columns += [body.isNull().alias("_null"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c != text)]
    return docs.select(*columns).mapInArrow(tidied(cut), ROWS)


def _stream(batches: list[pa.RecordBatch]) -> np.ndarray:
    """Rows as bytes of an Arrow stream."""
    if not batches:
        return np.empty(0, np.uint8)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return np.frombuffer(out.getvalue(), np.uint8)


class Part:
    """What a row of ``parts`` holds."""

    def __init__(self, raw: bytes):
        x = unpacked(raw)
        self.order, self.null, self.text = x["order"], x["null"], x["text"]
        self.digest = x["digest"].reshape(-1, 32)
        self.at = np.append(0, np.cumsum(x["size"]))
        self.doc = np.cumsum(x["doc"], dtype=np.int64)
        self.low = np.cumsum(x["low"], dtype=np.int64) + self.at[self.doc]
        self.place, self.high = self.low + x["back"], self.low + x["windows"]
        self.known_low, self.known_high, self.others = x["known_low"], x["known_high"], x["others"]
        self.digest8 = np.ascontiguousarray(self.digest[:, :8]).view("<u8").reshape(-1)

    def hashes(self) -> np.ndarray:
        """Of each anchor's first bytes."""
        out = np.empty(len(self.place), np.uint64)
        for k in range(0, len(self.text), CHUNK):
            a, b = np.searchsorted(self.place, (k, k + CHUNK))
            if b > a:
                own = self.place[a:b] - k
                out[a:b] = range_hashes(self.text[k : k + CHUNK + GRAM], own, own + GRAM)
        return out


def _buckets(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(values) % np.uint64(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, and where its members are, in their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edge = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(order)]), len(order)).tolist()
    for a, b in zip(edge, edge[1:], strict=False):
        yield int(sorted_[a]), order[a:b]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in range(3))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """Rows that lie together by bucket."""
    at, held = None, []
    for part, bucket, body in _rows(batches):
        if bucket != at and held:
            yield at, held
            held = []
        at = bucket
        held.append((part, body))
    if held:
        yield at, held


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Part, list[tuple[int, bytes]]]]:
    """Each part with the other rows that lie together with it."""
    at, text, held = None, None, []
    for part, bucket, body in _rows(batches):
        if part != at:
            if text is not None:
                out, text, held = (at, text, held), None, []
                yield out
                del out
            at, text, held = part, None, []
        if bucket == TEXTS:
            text = Part(body)
        else:
            held.append((bucket, body))
    if text is not None:
        yield at, text, held


def hashed(buckets: int):
    """Each part's distinct anchor hashes with their counts, and its text digests, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, body in _rows(batches):
            own = Part(body)
            h, count = np.unique(own.hashes(), return_counts=True)
            grams, texts = dict(_split(_buckets(h, buckets))), dict(_split(_buckets(own.digest8, buckets)))
            none = np.empty(0, np.int64)
            for k in sorted({*grams, *texts}):
                g, t = grams.get(k, none), texts.get(k, none)
                yield _batch((part, k, packed(hashes=h[g], count=count[g], digest=own.digest[t].reshape(-1), order=own.order[t])))

    return run


def seen_again(batches: Iterator[pa.RecordBatch], hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """For each row of a bucket: which hashes are seen more than once in it, which more than ``hot`` times, and which texts equal an earlier one."""
    for bucket, rows in _by_bucket(batches):
        held = [unpacked(body) for _, body in rows]
        hashes = np.concatenate([x["hashes"] for x in held])
        _, number = np.unique(hashes, return_inverse=True)
        count = np.zeros(len(hashes), np.int64)
        np.add.at(count, number, np.concatenate([x["count"] for x in held]))
        again, often = count[number] > 1, count[number] > hot
        digest = np.concatenate([x["digest"] for x in held])
        name = np.ascontiguousarray(digest).view("S32").reshape(-1)
        order = np.concatenate([x["order"] for x in held])
        _, same = np.unique(name, return_inverse=True) if len(name) else (None, np.empty(0, np.int64))
        sorted_ = np.lexsort((order, same))
        later = np.empty(len(name), bool)
        later[sorted_] = np.append(False, same[sorted_][1:] == same[sorted_][:-1])[: len(name)]
        a = b = 0
        for (part, _), x in zip(rows, held, strict=True):
            c, d = a + len(x["hashes"]), b + len(x["order"])
            yield _batch((part, bucket, packed(again=np.packbits(again[a:c]), hot=np.packbits(often[a:c]), later=np.packbits(later[b:d]))))
            a, b = c, d


def keys_of(text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The keys of suffixes at ``place``, KEY bytes each."""
    ahead, behind = np.arange(LENGTH), np.arange(1, PLACES)
    out = np.zeros((len(place), KEY), np.uint8)
    if len(place) > KEYS:
        for k in range(0, len(place), KEYS):
            out[k : k + KEYS] = keys_of(text, place[k : k + KEYS], low[k : k + KEYS], high[k : k + KEYS])
        return out
    reach = (high + LENGTH - place)[:, None]
    right = ahead[None, :] < reach
    out[:, :LENGTH][right] = text[(place[:, None] + ahead[None, :])[right]]
    left = behind[None, :] <= (place - low)[:, None]
    out[:, LENGTH:][left] = text[(place[:, None] - behind[None, :])[left]]
    return out


def shared_with_last(keys: np.ndarray) -> np.ndarray:
    """How many bytes each key shares with the one before it; 0 for the first."""
    out = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), KEY)
    return out


def runs(buckets: int):
    """Sorted front-coded runs of each part, by bucket, and the windows that are known to repeat within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own, back in _by_part(batches):
            h, number = np.unique(own.hashes(), return_inverse=True)
            again, hot, later = np.zeros(len(h), bool), np.zeros(len(h), bool), np.zeros(len(own.order), bool)
            grams, texts = dict(_split(_buckets(h, buckets))), dict(_split(_buckets(own.digest8, buckets)))
            for k, body in back:
                x = unpacked(body)
                for where, bits, to in ((grams.get(k), x["again"], again), (grams.get(k), x["hot"], hot), (texts.get(k), x["later"], later)):
                    if where is not None:
                        to[where] = np.unpackbits(bits, count=len(where)).astype(bool)
            known_doc, known_from, known_to = [np.flatnonzero(later)], [own.at[:-1][later]], [own.at[1:][later] - LENGTH]
            known_doc.append(np.searchsorted(own.at, own.known_low, "right") - 1)
            known_from.append(own.known_low)
            known_to.append(own.known_high)
            some = np.flatnonzero(again[number] & ~later[own.doc])
            alone = hot[number[some]]
            place, low, high, docs = (x[some[~alone]] for x in (own.place, own.low, own.high, own.doc))
            bucket = _buckets(h[number[some[~alone]]], buckets)
            groups = [(place, low, high, docs, bucket, span_hashes(own.text, place, low, high))]
            if alone.any():  # each window by itself
                i = some[alone]
                each = own.high[i] - own.low[i] + 1
                window = np.arange(each.sum()) + np.repeat(own.low[i] - (np.cumsum(each) - each), each)
                name = span_hashes(own.text, window, window, window)
                groups.append((window, window, window, np.repeat(own.doc[i], each), _buckets(name, buckets), name))
            place, low, high, docs, bucket, name = (np.concatenate(x) for x in zip(*groups, strict=True))
            for k, i in _split(bucket):
                i = i[np.lexsort((place[i], own.digest8[docs[i]], own.order[docs[i]]))]
                # the same bytes and the same windows as an earlier one: all repeat
                copy = copies(own.text, place[i], low[i], high[i], name[i])
                known_doc.append(docs[i[copy]])
                known_from.append(low[i[copy]])
                known_to.append(high[i[copy]])
                i = i[~copy]
                key = keys_of(own.text, place[i], low[i], high[i])
                order = np.argsort(np.ascontiguousarray(key).view(f"S{KEY}").reshape(-1), kind="stable")
                i, key = i[order], key[order]
                shared, doc = shared_with_last(key), docs[i]
                rest = np.arange(KEY)[None, :] >= shared[:, None]
                yield _batch((part, k, packed(shared=shared, rest=key[rest], back=(place - low)[i].astype(np.uint8), ahead=(high - place)[i].astype(np.int8), order=own.order[doc], digest8=own.digest8[doc], place=place[i] - own.at[doc], doc=doc.astype(np.int32))))
            doc, low, high = np.concatenate(known_doc), np.concatenate(known_from), np.concatenate(known_to)
            long = high >= low
            yield _batch((part, COVERED - zlib.crc32(part.encode()) % buckets, packed(doc=doc[long].astype(np.int32), low=low[long], high=high[long])))

    return run


def _compared(one: bytes, other: bytes, start: int) -> int:
    """How many bytes two keys share, of which the first ``start`` are known to be shared."""
    n = KEY - start
    x = int.from_bytes(one[start:]) ^ int.from_bytes(other[start:])
    return start + n - (x.bit_length() + 7) // 8


def decoded(rest: np.ndarray, shared: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """The keys of a front-coded run, one by one, each with what it shares with the one before it."""
    raw, last, a = memoryview(np.ascontiguousarray(rest)), b"", 0
    for s in shared.tolist():
        b = a + KEY - s
        last = last[:s] + raw[a:b]
        a = b
        yield last, s


def merged(sorted_runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int, bytes]]:
    """The runs' keys in one order: (run, what the key shares with the one before it, key). Holds one key of each run.

    A loser tree; ``share[r]`` is what the next key of run r shares with the last winner, if run r
    lost last to that winner. The contender that shares more is the smaller one; only for equal
    shares are bytes read, from where the shares end.
    """
    n = len(sorted_runs)
    size = 1 << max(0, (n - 1).bit_length())
    share, lost = [0] * size, [0] * size
    head: list[bytes | None] = [next(x, (None, 0))[0] for x in sorted_runs] + [None] * (size - n)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        one, other = head[a], head[b]
        if one is None or other is None:
            return (b, a) if one is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        common = _compared(one, other, share[a])
        if common == KEY:
            win, lose = (a, b) if a < b else (b, a)
        else:
            win, lose = (a, b) if one[common] < other[common] else (b, a)
        share[lose] = common
        return win, lose

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        above = []
        for k in range(0, len(level), 2):
            win, lose = play(level[k], level[k + 1])
            lost[node + k // 2] = lose
            above.append(win)
        level = above
    win = level[0]
    while head[win] is not None:
        yield win, share[win], head[win]
        head[win], share[win] = next(sorted_runs[win], (None, 0))
        node = (win + size) // 2
        while node:
            win, lost[node] = play(win, lost[node])
            node //= 2


def in_blocks(stream: Iterator[tuple[int, int, bytes]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs, shares and keys of at least ``least`` merged suffixes (but for the last), up to where the next one begins with other GRAM bytes."""
    run, shares, keys = [], [], bytearray()
    for r, s, key in stream:
        if s < GRAM and len(run) >= least:
            yield np.array(run, np.int64), np.array(shares, np.int64), np.frombuffer(bytes(keys), np.uint8).reshape(-1, KEY)
            run, shares, keys = [], [], bytearray()
        run.append(r)
        shares.append(s)
        keys += key
    if run:
        yield np.array(run, np.int64), np.array(shares, np.int64), np.frombuffer(bytes(keys), np.uint8).reshape(-1, KEY)


def repeated(key: np.ndarray, shares: np.ndarray, back: np.ndarray, ahead: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For sorted suffixes: of which offsets before the anchor the window stands in an earlier suffix too. ``rank`` is the suffixes' order in the corpus."""
    n = len(key)
    out = np.zeros((n, PLACES), bool)
    with np.errstate(over="ignore"):
        left = np.zeros(n, np.uint64)
        for o in range(PLACES):
            if o:
                left = mixed(left * np.uint64(0x9E3779B97F4A7C15) + key[:, LENGTH + o - 1].astype(np.uint64) + np.uint64(1))
            some = np.flatnonzero((back >= o) & (-ahead <= o))
            if len(some) < 2:
                continue
            right = np.cumsum(shares < LENGTH - o)[some]
            order = np.lexsort((rank[some], left[some], right))
            same = (right[order][1:] == right[order][:-1]) & (left[some][order][1:] == left[some][order][:-1])
            if not same.any():
                continue
            later = np.append(False, same)
            first = some[order][np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))]
            hit, of = some[order][later], first[later]
            equal = (key[hit, LENGTH : LENGTH + o] == key[of, LENGTH : LENGTH + o]).all(axis=1)
            out[hit[equal], o] = True
    return out


def merge(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Windows that repeat, for each part, from the runs of each bucket; what parts know already passes through."""
    for bucket, rows in _by_bucket(batches):
        if bucket <= COVERED:
            for part, body in rows:
                yield _batch((part, bucket, body))
            continue
        held = [unpacked(body) for _, body in rows]
        next_ = np.cumsum([0, *(len(x["back"]) for x in held)])[:-1]  # of each run, the first suffix that hasn't come out
        column = {c: np.concatenate([x[c] for x in held]) for c in ("back", "ahead", "order", "digest8", "place", "doc")}
        stream = merged([decoded(x["rest"], x["shared"]) for x in held])
        del held
        found = []
        for run, shares, key in in_blocks(stream, block):
            i = np.empty(len(run), np.int64)
            for r, mine in _split(run):  # a run's suffixes come out in its order
                i[mine] = next_[r] + np.arange(len(mine))
                next_[r] += len(mine)
            own = {c: x[i] for c, x in column.items()}
            rank = np.empty(len(i), np.int64)
            rank[np.lexsort((run, own["place"], own["digest8"], own["order"]))] = np.arange(len(i))
            hit = repeated(key, shares, own["back"].astype(np.int64), own["ahead"].astype(np.int64), rank)
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            e, low = np.nonzero(edge == 1)
            _, past = np.nonzero(edge == -1)
            found.append((run[e], own["doc"][e], own["place"][e] - (past - 1), own["place"][e] - low))
        run, doc, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        for k, mine in _split(run):
            # places in documents; the rows of a part that it wrote itself have places in its text
            yield _batch((rows[k][0], bucket, packed(doc=doc[mine], low=low[mine], high=high[mine])))


def left_of(own: Part, back: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the windows that repeat leave of a part: which bytes stay, and of each document how many bytes and how many runs go."""
    change = np.zeros(len(own.text) + 1, np.int32)
    for bucket, body in back:
        x = unpacked(body)
        base = 0 if bucket <= COVERED else own.at[x["doc"]]
        np.add.at(change, x["low"] + base, 1)
        np.add.at(change, x["high"] + base + LENGTH, -1)
    gone, depth = np.empty(len(own.text), bool), 0
    for k in range(0, len(gone), CHUNK):
        depths = np.cumsum(change[k : min(k + CHUNK, len(gone))]) + depth
        gone[k : k + CHUNK], depth = depths > 0, depths[-1]
    del change
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = own.at[:-1][np.diff(own.at) > 0]
    begins[first] = gone[first]
    edge = own.at.tolist()
    removed, spans = (np.array([np.count_nonzero(x[a:b]) for a, b in zip(edge, edge[1:], strict=False)], np.int64) for x in (gone, begins))
    return np.logical_not(gone, out=gone), removed, spans


def kept_bytes(own: Part, stays: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """What is left of the documents from a to b, some MB at a time."""
    held, size, since = [], 0, 0
    for k in range(len(own.order)):
        a, b = own.at[k], own.at[k + 1]
        held.append(own.text[a:b][stays[a:b]].tobytes())
        size += len(held[-1])
        if size > 4 << 20 or k + 1 == len(own.order):
            yield since, k + 1, held
            held, size, since = [], 0, k + 1


def removed_from(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each part, without what windows that repeat cover."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "source_sha256", "kept"]
    for _, own, back in _by_part(batches):
        stays, removed, spans = left_of(own, back)
        size = np.diff(own.at)
        for a, b, kept in kept_bytes(own, stays):
            rows = [(None if own.null[k] else int(own.order[k]), int(size[k]), int(removed[k]), int(spans[k]), own.digest[k].tobytes().hex(), kept[k - a]) for k in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        del own, stays  # before the next part is unpacked


def trimmed_rows(names: list[str], at: int):
    """The documents of each part as they came, but for the text, column ``at`` of ``names``. Where a cut splits a character, its other bytes go too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, back in _by_part(batches):
            stays, _, _ = left_of(own, back)
            others = pa.ipc.open_stream(pa.py_buffer(own.others.tobytes())).read_all()
            for a, b, kept in kept_bytes(own, stays):
                some = others.slice(a, b - a).combine_chunks()
                null, *columns = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in some.columns)
                texts = pa.array([None if n else x.decode(errors="ignore") for n, x in zip(null.to_pylist(), kept, strict=True)], pa.string())
                columns.insert(at, texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)
            del own, stays, others  # before the next part is unpacked

    return run


def covered_parts(texts: DataFrame, part_bytes: int, hot: int, block: int, bucket_bytes: int) -> DataFrame:
    """Each part of ``texts`` with the windows that go, side by side."""
    buckets = max(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * part_bytes // bucket_bytes))
    # by part too: a task that runs again finds its rows in the same order
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "part")
    with_texts = lambda df: df.unionByName(texts).repartition("part").sortWithinPartitions("part", "bucket")
    again = by_bucket(texts.mapInArrow(tidied(hashed(buckets)), ROWS)).mapInArrow(tidied(lambda batches: seen_again(batches, hot)), ROWS)
    sent = by_bucket(with_texts(again).mapInArrow(tidied(runs(buckets)), ROWS))
    return with_texts(sent.mapInArrow(tidied(lambda batches: merge(batches, block)), ROWS))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES, hot: int = HOT, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, source_sha256, kept`` of every row of ``docs``."""
    texts = written(parts(docs, key, text, part_bytes), "suffix-parts")
    return covered_parts(texts, part_bytes, hot, block, bucket_bytes).mapInArrow(tidied(removed_from), RESULT)


def trimmed(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, each with what is left of its text (a null text stays null). A part carries its documents' other columns, so no join puts them back."""
    texts = written(parts(docs, key, text, part_bytes, whole=True), "suffix-parts")
    rows = covered_parts(texts, part_bytes, HOT, BLOCK, BUCKET_BYTES)
    return rows.mapInArrow(tidied(trimmed_rows(docs.columns, docs.columns.index(text))), docs.schema)


def op10_suffix_merge_dedup(spark, sf_dir) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS body, row_number() OVER (ORDER BY doc_id) AS nth FROM documents),
blocks AS (SELECT nth, first, substr(body, 2 * first + 1, 1198) AS block FROM (SELECT nth, body, unnest(range(0, len(body) // 2 - 99, 500)) AS first FROM t)),
w AS (SELECT nth, first + i AS start, md5(substr(block, 2 * i + 1, 200)) AS string FROM (SELECT nth, first, block, unnest(range(len(block) // 2 - 99)) AS i FROM blocks)),
again AS (SELECT nth, start FROM w QUALIFY row_number() OVER (PARTITION BY string ORDER BY nth, start) > 1),
runs AS (
    SELECT nth, min(start) AS a, max(start) + 100 AS b FROM (
        SELECT nth, start, sum(fresh) OVER (PARTITION BY nth ORDER BY start) AS run FROM (
            SELECT nth, start, CASE WHEN start - lag(start) OVER (PARTITION BY nth ORDER BY start) <= 100 THEN 0 ELSE 1 END AS fresh FROM again))
    GROUP BY nth, run
),
left_over AS (
    SELECT t.nth, string_agg(substr(body, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM t JOIN (
        SELECT nth, lag(b, 1, 0) OVER (PARTITION BY nth ORDER BY a) AS x, a AS y FROM runs
        UNION ALL SELECT nth, max(b), 1073741824 FROM runs GROUP BY nth) USING (nth) GROUP BY t.nth
),
cut AS (SELECT nth, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY nth)
SELECT doc_id, len(body) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, body))) AS kept_sha256
FROM t LEFT JOIN cut USING (nth) LEFT JOIN left_over USING (nth)
"""
