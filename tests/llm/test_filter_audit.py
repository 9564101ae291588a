"""The filter audit against a plain count of documents for each order and step."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np

from barloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """``docs``: (id, text, lang); ``labels``: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out, shapley = defaultdict(Counter), Counter()
    for i, t, lang in docs:
        t, part = t or "", lang or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > least[t]), strict=True) if x}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                c["unique_fails"] += fails == {f}
                c["redundant"] += gone and f in fails
                here = not gone and f in fails
                gone |= here
                c["kept"] += not gone
                c["removed"] += here
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
                shapley[part, f] += here
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*k, *(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items())


LONG = " ".join(f"w{i}" for i in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, "en"), (3, LONG, "en"), (1, LONG, "en"), (None, LONG, "en"), (None, None, None), (4, None, None), (5, "", ""),
    (6, "AB " * 130, "en"), (7, "a#b", "fr"), (8, " \t\n", "fr"), (9, LONG + " $", "xx"), (10, "É" * 5 + "A", "xx"), (11, " ".join(f"w{i % 999}" for i in range(60_000)), "en"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (6, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", "y", 3) for r in docs], "doc_id long, text string, lang string, part string, mask string, n int")
    return d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_odd_documents(spark):
    got = filter_audit.audit(*frames(spark, DOCS, LABELS))
    assert sorted(map(tuple, got.collect())) == plain(DOCS, LABELS)


def test_empty_tables(spark):
    d, lab = frames(spark, [], [])
    assert filter_audit.audit(d, lab).collect() == []
    d, _ = frames(spark, DOCS[:3], [])
    assert sorted(map(tuple, filter_audit.audit(d, lab).collect())) == plain(DOCS[:3], [])


def test_sql_on_odd_documents(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", DOCS)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert sorted(con.execute(filter_audit.ORACLE_SQL).fetchall()) == plain(DOCS, LABELS)


def test_query(spark, sf):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    got = filter_audit.op12_filter_interaction_audit(spark, sf)
    assert sorted(map(tuple, got.collect())) == plain(read("documents", "doc_id", "text", "lang"), read("labels", "doc_id", "quality", "toxic"))


def test_matrices():
    m = filter_audit.matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    assert np.array_equal(m["kept"][0], np.ones(600)) and not m["kept"][31].any()
    assert m["removed"].sum() == 31 * 120  # each mask but the empty one is removed once in every order
