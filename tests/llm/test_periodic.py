"""Periodic runs against a plain search over all periods and starts."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from barloom.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """Every longest stretch with period q, for q from 1; one of the same begin and end as a smaller period's has that as its smallest."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def plain(i, text):
    w = WORD.findall(text or "")
    n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for a, m, q in runs for k in range(a + q, a + m)}
    digest = lambda s: sha256(s.encode()).hexdigest()
    told = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(told), digest(" ".join(x for k, x in enumerate(w) if k not in gone))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def words_with_runs(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        q = rng.randrange(1, n // 3 + 1)
        a = rng.randrange(n - 1)
        for i in range(a + q, min(n, a + rng.randrange(2 * q, 5 * q + 2))):
            w[i] = w[i - q]
    return w


def test_runs_of_random_words():
    rng, seen = random.Random(3), 0
    for _ in range(1500):
        w = words_with_runs(rng, rng.choice([0, 1, 23, 24, 25, 30, 72, 150, 300]), rng.choice([1, 2, 2, 3, 5, 30]))
        want = plain_runs(w)
        seen += len(want)
        assert periodic.runs(np.array(w, np.int32)) == want
    assert seen > 200


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 12, 13, 17, 18, 25, 100])
def test_threshold_of_each_scale(period):
    """A run of just three periods, and one word less."""
    block = list(range(100, 100 + period))
    least = max(24, 3 * period)
    for n in (least - 1, least, least + 1):
        w = [1, 2, 3, *(block * 30)[:n], 4, 5]
        assert periodic.runs(np.array(w, np.int32)) == ([(3, n, period)] if n >= least else [])


def test_smallest_period_and_neighbours():
    w = [7] * 30 + [8, 9] * 12 + [1] * 24
    assert periodic.runs(np.array(w, np.int32)) == [(0, 30, 1), (30, 24, 2), (54, 24, 1)]


def test_words_are_numbered_across_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 7)
    monkeypatch.setattr(periodic, "WORDS", 3)
    raw = b"  aa\tbb aa\x0bcccccccccccccc \x1c dd  aa"
    ids, words = periodic.numbered_words(raw)
    assert [words[i] for i in ids] == raw.split() and ids.tolist() == [0, 1, 0, 2, 3, 4, 0]
    assert b"".join(periodic.joined(words, ids)) == b" ".join(raw.split())


def test_odd_documents(spark, odd, none, texts):
    """Texts 15 and 16 have 40,000 words, too many for the plain search; their words come in the order of 997 times 31 pairs, which doesn't recur."""
    more = [(i, "x " * 40 + " ".join(f"a{k % 9}" for k in range(60)) + f" end {i}") for i in range(100, 160)] + [(None, "z " * 50), (None, None)]
    some = [*((i, t) for i, t in texts if i not in (15, 16)), *more, *more]
    assert rows(periodic.repeats(spark.createDataFrame(some, "doc_id long, text string"), plant=True)) == sorted((plain(i, t) for i, t in some), key=str)
    assert periodic.repeats(none, plant=True).collect() == []
    whole = {r["doc_id"]: r for r in periodic.repeats(odd, plant=False).collect()}
    assert whole.keys() == {i for i, _ in texts}
    assert whole[15]["n_runs"] == whole[16]["n_runs"] == 0


def test_very_long_text():
    w = np.random.default_rng(1).integers(0, 50_000, 300_000)
    w[100_000:100_000 + 3 * 40_000] = np.tile(w[100_000:140_000], 3)
    found = periodic.runs(w.astype(np.int32))
    assert len(found) == 1 and found[0][2] == 40_000 and found[0][1] >= 120_000


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "say\n" + "ha ho " * 20 + "end", "a"), (2, "no  run", "b"), (3, None, "c")], "doc_id long, text string, ids string")
    assert rows(periodic.collapse(docs)) == [(1, "say ha ho end", "a"), (2, "no  run", "b"), (3, None, "c")]


def test_query(spark, sf, documents):
    short = {i for i, t in documents.items() if len((t or "").split()) < 900}
    got = {r["doc_id"]: tuple(r) for r in periodic.op11_bit_parallel_periodic_runs(spark, sf).collect()}
    assert got.keys() == documents.keys()
    for i in short:
        assert got[i] == plain(i, documents[i])
    assert any(r[1] for r in got.values())


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(periodic.ORACLE_SQL).fetchall()) == sorted(map(tuple, periodic.op11_bit_parallel_periodic_runs(spark, sf).collect()))
