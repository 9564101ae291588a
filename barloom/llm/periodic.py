"""Periodic runs of words, by bit-parallel lags.

A text's words become numbers, and each bit of these numbers a plane: one big integer with a bit for
each word. For a lag q, every plane is XORed with itself shifted by q and the results are ORed, so a
bit is 0 where a word equals the one q words later. ANDing the matches with their own shifts, each time doubled,
leaves the begins of those stretches that are long enough: a run of length n and period q is a stretch of
n - q matches at lag q. Lags rise, so a stretch that was seen at a smaller lag has that smaller period.

Lags to look at come from repeated grams, which keeps long texts far from all n/3 lags. A run of
smallest period q holds the gram of its first k words again q words later, and, if 3q/2 <= k <= 2q, not earlier:
two occurrences at a distance d < q would give that gram the periods q and d or q and q - d, one of these at most q/2, and
so (Fine and Wilf) a period that divides q, which the run would have too. Since a run has 3q words at least, both fit into it. So the
distances between neighbouring occurrences of equal grams of k words contain each period from k/2 to 2k/3 that there is. k = 12 serves
periods 1 to 8 (a run has at least 24 words), then k grows by about a third; grams are named exactly,
by pairs of names of shorter ones, and where no gram of k words repeats, no longer one does. No lag with a run is left out, at any length of text.

Null text has no words. A null identifier is one whose words stay as they are; repeated identifiers are rows like others; an empty table
gives no rows. A very long text is held by one task with four bytes for each word, some more while grams are named, and its distinct words.
Columns other than the key and the text aren't read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc32_sql, slim, table
from barloom.llm.textblock import tidied

SHORTEST = 24  # words of a run
TIMES = 3  # periods of a run
GRAM = SHORTEST // 2
WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes that are cut into words at once, and words that are put together at once.
CHUNK, WORDS = 1 << 20, 1 << 17
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words' numbers in order of first appearance, and the distinct words. ``bytes.split`` splits at just the six characters of the contract."""
    known: dict[bytes, int] = {}
    numbers, at = array("i"), 0
    while at < len(raw):
        edge = WHITE.search(raw, at + CHUNK)
        end = edge.start() if edge else len(raw)
        numbers.extend([known.setdefault(w, len(known)) for w in raw[at:end].split()])
        at = end
    return np.frombuffer(numbers, np.int32) if numbers else np.empty(0, np.int32), list(known)


def lags(ids: np.ndarray) -> list[int]:
    """Every smallest period that a run of ``ids`` has, and few other lags; ascending."""
    n, found, first, k = len(ids), [], 1, GRAM
    name, width = ids.astype(np.int64), 1  # of the grams of ``width`` words
    while n >= max(SHORTEST, TIMES * first):
        while width * 2 <= k:
            _, name = np.unique(name[:-width] * n + name[width:], return_inverse=True)
            width *= 2
        gram = name[: n - k + 1] * n + name[k - width : n - width + 1]
        order = np.argsort(gram, kind="stable")
        again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
        if not len(again):
            break
        apart = np.unique(order[again + 1] - order[again])
        last = 2 * k // 3
        found += apart[(apart >= first) & (apart <= last)].tolist()
        first = last + 1
        k = 2 * first
    return found


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of each number, as one integer for each b."""
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(int(ids.max(initial=0)).bit_length())]


def places(bits: int) -> np.ndarray:
    """Where an integer has ones."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def stretches(of: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each longest stretch of ``least`` or more words that equal the word ``lag`` later."""
    differs = 0
    for plane in of:
        differs |= plane ^ (plane >> lag)
    every = (1 << (n - lag)) - 1
    long = every ^ (differs & every)
    have = 1
    while have < least and long:
        step = min(have, least - have)
        long &= long >> step
        have += step
    if not long:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = places(long & ~(long << 1)), places(long & ~(long >> 1))
    return begin, end - begin + least


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start, then period."""
    n, found = len(ids), {}
    look = lags(ids)
    of = planes(ids) if look else []
    for q in look:
        begin, matches = stretches(of, n, q, max(SHORTEST - q, (TIMES - 1) * q))
        for a, m in zip(begin.tolist(), matches.tolist(), strict=True):
            found.setdefault((a, m + q), q)  # a smaller period came first
    return sorted((a, length, q) for (a, length), q in found.items())


def planted(n: int, key: int | None) -> np.ndarray | None:
    """Which original word stands at each place, for the identifiers that the contract has repeat their words; else None."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def joined(words: list[bytes], ids: np.ndarray) -> Iterator[bytes]:
    """The words with one space between them, some at a time."""
    for at in range(0, len(ids), WORDS):
        yield (b" " if at else b"") + b" ".join([words[i] for i in ids[at : at + WORDS].tolist()])


def digest(parts) -> str:
    h = sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def described(key: int | None, text: str | None, plant: bool) -> tuple:
    """The row of one text."""
    ids, words = numbered_words((text or "").encode())
    place = planted(len(ids), key) if plant else None
    ids = ids if place is None else ids[place]
    found = runs(ids)
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    exponent = best and 1000 * best[1] // best[2]
    left = ids[kept(len(ids), found)] if found else ids
    return key, len(found), *(best or (None, None, None)), exponent, digest(b"%d,%d,%d\n" % r for r in found), digest(joined(words, left))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """A row for each text: its runs, the strongest of them, and digests of all runs and of the words left. ``plant`` first repeats words of a tenth of the identifiers, as a test of the finder."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(i.as_py(), t.as_py(), plant) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return slim(docs, key, text).withColumn(key, F.col(key).cast("long")).mapInArrow(tidied(run), SCHEMA)


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, each periodic run of a text cut down to its first period. Words of a changed text are joined by one space; texts without runs, and null ones, stay as they are."""

    def shrunk(text: str | None) -> str | None:
        ids, words = numbered_words((text or "").encode())
        found = runs(ids)
        return b"".join(joined(words, ids[kept(len(ids), found)])).decode() if found else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(map(shrunk, batch.column(at).to_pylist()), batch.schema.field(at).type))

    return docs.mapInArrow(tidied(run), docs.schema)


def op11_bit_parallel_periodic_runs(spark, sf_dir) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), plant=True)


#: The same by pairs of equal words of a text, joined, and stretches of such pairs. It takes a text of a few thousand words at most.
ORACLE_SQL = rf"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("hex(doc_id::VARCHAR::BLOB)")} AS h FROM documents
), planned AS (
  SELECT doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM hashed
), words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planned)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), placed AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
long AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM placed GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY doc_id, start, length),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::HUGEINT * 1000000000000 // period DESC, start, period) AS place FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS told FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.told, '')) AS runs_sha256, sha256(coalesce(left_over.told, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN left_over USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE place = 1) best USING (doc_id)
"""
