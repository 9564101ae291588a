"""Texts of an Arrow batch as one byte array, in blocks of bounded size, and words of a block as numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Bytes that are hashed at once.
SPAN_LOG2 = 20
#: An odd multiplier and its inverse modulo 2**64, for hashes of byte ranges.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and where each value begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values with at most ``most`` bytes together, but one value at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


@lru_cache(maxsize=4)
def _powers(base: int, log_n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.full(1 << log_n, x, np.uint64) for x in (base, inverse))
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits; every value has one image."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def range_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hashes of ``body[start:end]``; equal ranges have equal hashes in any block. In a long body, whose ranges must ascend, some are hashed at a time."""
    if len(body) >> SPAN_LOG2 and len(start):
        out = np.empty(len(start), np.uint64)
        edge = np.unique(np.append(np.searchsorted(start, np.arange(0, len(body), 1 << SPAN_LOG2 - 1)), len(start)))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            first, last = int(start[a]), int(end[a:b].max())
            out[a:b] = _range_hashes(body[first:last], start[a:b] - first, end[a:b] - first, base)
        return out
    return _range_hashes(body, start, end, base)


def _range_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        log_n = max(SPAN_LOG2, int(len(body)).bit_length())
        # tables for a range that is longer than a span aren't kept
        up, down = _powers(base, log_n) if log_n == SPAN_LOG2 else _powers.__wrapped__(base, log_n)
        total = np.empty(len(body) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_byte_values()[body] * up[: len(body)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mixed(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def distinct_words(body: np.ndarray, start: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a block that ``start`` cuts into words, and each word's number among them. Exact: bytes are compared."""
    if not len(start):
        return [], np.empty(0, np.int64)
    end = np.append(start[1:], len(body))
    for base in BASES:
        _, first, number = np.unique(range_hashes(body, start, end, base), return_index=True, return_inverse=True)
        same = np.arange(len(body)) + np.repeat(start[first][number] - start, end - start)
        if np.array_equal(body[same], body):
            raw = body.tobytes()
            return [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], number
    raw, known = body.tobytes(), {}
    number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return list(known), number


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``pool[start:start+length]`` of every range, one after another."""
    total = int(length.sum())
    begin = np.cumsum(length) - length
    return pool[np.repeat(start - begin, length) + np.arange(total)]


def give_back() -> None:
    """Memory that isn't used goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Cached functions whose values this worker keeps from one task to the next of the same kind.
_lasting: list = []


def only_lasting(own: Sequence) -> None:
    """What tasks of other kinds have left in this worker goes; what ``own`` caches may stay."""
    others = [x for x in _lasting if x not in own]
    _lasting[:] = own
    for x in others:
        x.cache_clear()
    if others:
        give_back()


def tidied(run: Callable[[Iterator], Iterator], *pools, lasting: Sequence = ()) -> Callable[[Iterator], Iterator]:
    """``run`` for an Arrow batch iterator. When its task ends, the pools' words go, and memory that isn't used goes back to the system: Python workers outlive their tasks.

    Values of the cached functions ``lasting``, such as a tokenizer, stay until the worker gets a task of another kind.
    """

    def own(batches: Iterator) -> Iterator:
        only_lasting(lasting)
        try:
            yield from run(batches)
        finally:
            for pool in pools:
                pool().clear()
            give_back()

    return own


class WordPool:
    """Numbers for distinct words, each computed once and kept while there is room."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], most: int = 400_000, dtype=np.uint32):
        self.encode, self.most, self.dtype = encode, most, dtype
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.values = np.empty(0, self.dtype)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``values`` the numbers of each word are, and how many."""
        if len(self.known) > self.most:
            self.clear()
        new = [w for w in words if w not in self.known]
        if new:
            got = self.encode(new)
            length = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for g in got for x in g), self.dtype, int(length.sum()))
            start = len(self.values) + np.cumsum(length) - length
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.values, self.start, self.length = (np.concatenate(x) for x in ((self.values, flat), (self.start, start), (self.length, length)))
        i = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.start[i], self.length[i]
