"""Packing of documents into sequences: dominance reduction, then best fit.

Documents become token ids on the executors; only longer ones than a sequence are cut, the first
piece taking what is left over. What is packed is a count for each length, so the instance has at
most ``capacity`` numbers whatever the input. On it, sets of pieces that provably belong together
in some best packing are fixed first (Martello and Toth's dominance between sets), largest piece
first, which shrinks the instance; the remainder is packed best fit, longest first. The plan says
for each length which of its pieces (by rank) go where, and is joined to the ranked pieces.

Null text is an empty one, which is a document of one token, the end mark; null and repeated
identifiers are documents like any other; an empty table gives no rows; other columns are not read. A very
long text is encoded by one task, which holds it, its ids and a copy of these as pieces of 1024.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import pretoken
from barloom.llm.common import numbered, slim, table, written
from barloom.llm.textblock import WordPool, blocks, distinct_words, gather, text_bytes, tidied

CAPACITY = 1024
END = 2
#: Words in a call of the tokenizer.
WORDS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_words(path: str):
    """Encodes words by the tokenizers library, some thousands in a call, in the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True

    def encode(words: list[bytes]) -> list[list[int]]:
        return [e.ids for k in range(0, len(words), WORDS) for e in own.encode_batch_fast([w.decode() for w in words[k : k + WORDS]], add_special_tokens=False)]

    return encode


@lru_cache(maxsize=1)
def tokenizer_pool(path: str) -> WordPool:
    """The pool of a Python worker; each task leaves it empty, and a task of another kind removes it."""
    return WordPool(tokenizer_words(path))


def block_ids(pool: WordPool, body: np.ndarray, at: np.ndarray, library: str = "tiktoken") -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's texts, one after another, and how many each text has."""
    start = pretoken.words(body, at, library)
    words, number = distinct_words(body, start)
    first, count = pool.numbers(words)
    length = count[number] if len(words) else np.empty(0, np.int64)
    ids = gather(pool.values, first[number], length) if len(words) else np.empty(0, np.uint32)
    before = np.append(0, np.cumsum(length))
    edge = before[np.searchsorted(start, at)]
    return ids, np.diff(edge)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, with a checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = tokenizer_pool(path)
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            for i, j in blocks(at):
                ids, count = block_ids(pool, body[at[i] : at[j]], at[i : j + 1] - at[i])
                ids, edge = ids.astype("<u4"), np.append(0, np.cumsum(count))
                rows: list[tuple] = []
                for k, one in enumerate(batch.column(0)[i:j].to_pylist()):
                    own = np.append(ids[edge[k] : edge[k + 1]], np.uint32(END))
                    a, raw, n = 0, own.tobytes(), len(own)
                    b, piece = n % capacity or min(n, capacity), 0
                    while a < n:
                        rows.append((one, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
                        a, b, piece = b, b + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim(docs, key, text).mapInArrow(tidied(cut, lambda: tokenizer_pool(path), lasting=[tokenizer_pool]), PIECES)


@dataclass(frozen=True)
class Placed:
    """Pieces of one length with ranks from ``low``: ``each`` in every sequence from ``sequence`` on, the first at ``offset``."""

    length: int
    low: int
    high: int
    each: int
    sequence: int
    offset: int


class Plan:
    """Places pieces by length, of which ``left`` counts those not placed yet."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.placed: list[Placed] = []
        self.sequences = 0

    def take(self, length: int, each: int, sequence: int, n: int, offset: int) -> None:
        low = self.used[length]
        self.used[length] += each * n
        self.left[length] -= each * n
        self.placed.append(Placed(length, low, low + each * n, each, sequence, offset))

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def fix(self, lengths: tuple[int, ...], n: int) -> None:
        """``n`` sequences that hold just these pieces."""
        sequence, offset = self.open(n), 0
        for x in lengths:
            self.take(x, 1, sequence, n, offset)
            offset += x


def reduce(plan: Plan) -> None:
    """Fixes what dominates, for the longest piece left, until nothing is certain.

    For a longest piece j with room r: it stands alone if nothing fits beside it; it is fixed with
    the longest piece k that fits if k fills r, or if no two other pieces that fit r together are
    longer than k in sum and no three fit; that stays true while pieces become fewer. Any packing can be changed to hold such a set without
    more sequences, since k can be swapped for what stood beside j.
    """
    lengths = sorted(plan.left, reverse=True)
    for j in lengths:
        while plan.left[j]:
            room = plan.capacity - j
            rest = [x for x in lengths if plan.left[x] - (x == j) > 0]
            fits = [x for x in rest if x <= room]
            if not fits:
                plan.fix((j,), plan.left[j])
                continue
            k = fits[0]
            many = plan.left[j] // 2 if j == k else min(plan.left[j], plan.left[k])
            if k == room:
                plan.fix((j, k), many)
                continue
            small = [x for x in reversed(fits) for _ in range(min(3, plan.left[x] - (x == j)))][:3]
            if len(small) > 2 and sum(small) <= room:
                break
            if _longest_pair(plan, fits, j, room) > k:
                break
            plan.fix((j, k), many)


def _longest_pair(plan: Plan, fits: list[int], j: int, room: int) -> int:
    """The largest sum of two pieces besides j that fits the room; 0 if none does. ``fits`` falls."""
    rising, best = fits[::-1], 0
    for x in fits:
        at = bisect_right(rising, min(x, room - x)) - 1
        if at >= 0 and rising[at] == x and plan.left[x] - (x == j) < 2:
            at -= 1
        if at >= 0:
            best = max(best, x + rising[at])
    return best


def best_fit(plan: Plan) -> None:
    """Longest first, each piece to the open sequence with the least room that takes it."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences

    def put(room: int, sequence: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, []).append((sequence, n))

    for x in sorted((x for x, n in plan.left.items() if n), reverse=True):
        for room in sorted(r for r in rooms if r >= x):
            while plan.left[x] and rooms.get(room):
                sequence, n = rooms[room].pop()
                each = min(room // x, plan.left[x])
                whole = min(n, plan.left[x] // each)
                plan.take(x, each, sequence, whole, plan.capacity - room)
                put(room - each * x, sequence, whole)
                put(room, sequence + whole, n - whole)
            if not rooms.get(room):
                rooms.pop(room, None)
            if not plan.left[x]:
                break
        while plan.left[x]:
            each = min(plan.capacity // x, plan.left[x])
            n = plan.left[x] // each
            sequence = plan.open(n)
            plan.take(x, each, sequence, n, 0)
            put(plan.capacity - each * x, sequence, n)


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length."""
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("a piece is longer than a sequence, or empty")
    plan = Plan(counts, capacity)
    reduce(plan)
    best_fit(plan)
    return plan


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, key, text), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = packed(counts, capacity).placed
    ranked = numbered(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank")
    # the plan's rows are bounded by the lengths, not by the documents
    where = spark.createDataFrame([(p.length, p.low, p.high, p.each, p.sequence, p.offset) for p in plan], "length long, low long, high long, each long, first long, place long")
    spot = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(where["length"])
    nth = F.col("rank") - F.col("low")
    return spot.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def op1_dominance_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
