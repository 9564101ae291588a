"""Base spans against the patterns themselves, the tagger's gradients and decoding against plain ones, and what it finds in held-out texts."""

from __future__ import annotations

import itertools
import random
import re
import time
import types
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

from barloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SMALL = pii.Settings(hidden=10, windows=700, epochs=6)


def plain_luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        x = int(c) * (1 + place % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), list(PATTERNS).index(kind)))
    return sorted(out, key=lambda s: (s[0], s[2]))


def told(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, b, k in spans)


def test_base_spans_of_random_texts():
    rng, seen = random.Random(5), set()
    parts = ["a", "Z.", "@", "@", "x@y.zz", "-", "_", "%+", ".", ".", "1", "23", "255", "256", "007", "1.2.3.4", " ", " ", "+", "(", ")", "4111 1111 1111 1111", "+1 (310) 555-4510", "é", "\n", "00000000000004"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = plain(text)
        seen |= {k for _, _, k in want}
        assert pii.base(text) == want, text
    assert seen == {0, 1, 2, 3}


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" * 200_000, "+1" + "-" * 400_000, "@" * 400_000, "a@" * 200_000, "a@b." * 100_000, "+1 " * 130_000])
def test_base_spans_take_linear_time(text):
    began = time.perf_counter()
    pii.base(text)
    assert time.perf_counter() - began < 5


def in_doubles():
    """The module's own source with 64-bit numbers, for gradients by differences."""
    source = Path(pii.__file__).read_text().replace("np.float32", "np.float64")
    import sys

    own = types.ModuleType("barloom.llm.pii_doubles")
    sys.modules[own.__name__] = own
    exec(compile(source, "pii_doubles", "exec"), own.__dict__)
    return own


def test_gradients():
    own, rng = in_doubles(), np.random.default_rng(0)
    values = own.start_values(own.Settings(hidden=3))
    values["next"][:] = rng.normal(size=values["next"].shape)
    ids, tags = rng.integers(0, pii.SYMBOLS, (7, 3)).astype(np.uint8), rng.integers(0, pii.TAGS, (7, 3))
    _, slopes = own.gradients(values, ids, tags)
    for name, value in values.items():
        for _ in range(5):
            i = tuple(int(rng.integers(n)) for n in value.shape)
            if name[0] == "x":
                i = int(ids[rng.integers(7), rng.integers(3)]), i[1]
            at, losses = value[i], []
            for d in (1e-5, -1e-5):
                value[i] = at + d
                losses.append(own.gradients(values, ids, tags)[0])
            value[i] = at
            assert abs((losses[0] - losses[1]) / 2e-5 - slopes[name][i]) < 1e-6


def test_likelihood_and_best_path_by_all_paths():
    rng = np.random.default_rng(2)
    scores, follow = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    worth = lambda n, p: sum(scores[t, n, x] for t, x in enumerate(p)) + sum(follow[a, b] for a, b in itertools.pairwise(p))
    tags = np.array([[0, 2], [1, 1], [2, 0], [0, 0]])
    want = np.mean([np.log(sum(np.exp(worth(n, p)) for p in itertools.product(range(3), repeat=4))) - worth(n, tags[:, n]) for n in range(2)])
    assert abs(pii.likelihood(scores, follow, tags)[0] - want) < 1e-9
    for n in range(2):
        assert tuple(pii.best_paths(scores, follow)[:, n]) == max(itertools.product(range(3), repeat=4), key=lambda p: worth(n, p))


def test_reconciled_by_all_sets():
    rng = random.Random(4)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 6), rng.randrange(4), rng.randrange(1, 90) / 7) for a in (rng.randrange(12) for _ in range(rng.randrange(7)))]
        got = pii.reconciled(spans)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(got))
        best = max(sum(x[3] for x in some) for n in range(len(spans) + 1) for some in itertools.combinations(spans, n) if all(x[1] <= y[0] for x, y in itertools.pairwise(sorted(some))))
        worth = {}
        for *x, m in spans:
            worth[tuple(x)] = max(m, worth.get(tuple(x), 0))
        assert abs(sum(worth[x] for x in got) - best) < 1e-9


def test_windows_cover_every_trigger():
    s = pii.Settings()
    text = "word " * 300 + "call 123-456 now " + "x" * 500 + " at home dot com " + "7 " * 400 + "end"
    spans = [(0, 4, 0)]
    got = list(pii.windows(text, spans, s))
    assert all(0 < b - a <= s.window for a, b in got)
    for m in re.finditer("[0-9]", text):
        assert any(a <= m.start() < b for a, b in got)
    for at in range(got[0][0], got[0][1] - s.window // 2 + 1):  # what is half a window long is whole in some window, within a region
        assert any(a <= at and at + s.window // 2 <= b for a, b in got)
    assert list(pii.windows("no signs here " * 50, [], s)) == []


NAMES = ["river", "miller", "bridge", "wagon", "daughter", "window", "garden", "letter", "market", "winter", "summer", "harbour", "story", "teacher"]


def prose(rng, n):
    return " ".join(NAMES[int(rng.integers(len(NAMES)))] for _ in range(n))


def labelled(rng, n):
    made = ("{0}@{1}.com", "{2}.{3}.{4}.5", "{card}", "+1 ({2}) {3}-1234")
    out = []
    for i in range(n):
        a, b = prose(rng, 1), prose(rng, 1)
        out.append(f"{prose(rng, 20)} {made[i % 4].format(a, b, rng.integers(100, 200), rng.integers(100, 200), rng.integers(100, 200), card=pii.card_number(rng, 16))} {prose(rng, 20)} {rng.integers(2000)}.")
    return out


@pytest.fixture(scope="module")
def trained():
    ids, tags, n = pii.examples(labelled(np.random.default_rng(1), 40), pii.Settings())
    assert n == 40 and len(ids) == len(tags) and (tags > 0).any()
    return pii.fit(ids, tags, pii.Settings())


def test_held_out_variants(trained):
    """Other words, other numbers: most rewritten spans are found exactly, few decoys are taken."""
    rng, s = np.random.default_rng(77), pii.Settings()
    texts, where = [], []
    for i in range(400):
        left, right, own = prose(rng, 25) + " ", " " + prose(rng, 25), prose(rng, 6).split()
        middle = pii.variant(i % 4, rng, own)
        texts.append(left + middle + right)
        where.append((len(left), len(left) + len(middle), i % 4))
    exact = [span in known + more for span, (known, more) in zip(where, pii.all_spans(texts, trained, s), strict=True)]
    assert np.mean(exact) > 0.75
    decoys = [f"{prose(rng, 25)} {pii.decoy(rng, prose(rng, 6).split())} {prose(rng, 25)}" for _ in range(400)]
    assert np.mean([bool(more) for _, more in pii.all_spans(decoys, trained, s)]) < 0.02
    assert not any(more for _, more in pii.all_spans([prose(rng, 200) for _ in range(20)], trained, s))


def test_rows_of_find(spark, odd, none, texts):
    rng = np.random.default_rng(1)
    train_on = spark.createDataFrame([(i, t) for i, t in enumerate(labelled(rng, 60))], "doc_id long, text string")
    model = pii.train(train_on, s=SMALL)
    raw = model.first()["model"]
    assert raw and raw == pii.train(train_on.repartition(7), s=SMALL).first()["model"]  # the order of rows doesn't matter
    for docs, want in ((odd, texts), (none, [])):
        got = {r["doc_id"]: r for r in pii.find(docs, model, s=SMALL).collect()}
        assert got.keys() == {i for i, _ in want}
        for i, t in want:
            assert got[i]["base_sha256"] == sha256(told(plain(t)).encode()).hexdigest()
    more = [(None, "mail a@b.cc, twice a@b.cc"), (1, "x +1 310 555 4510 y"), (1, "x +1 310 555 4510 y"), (2, None), (3, "see " + "9" * 300_000 + " 10.0.0.1")]
    got = pii.find(spark.createDataFrame(more, "doc_id long, text string"), model, s=SMALL).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_phone"]) for r in got) == [(0, 2, 0, 0), (1, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 0), (3, 0, 1, 0)]
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]


def test_without_labelled_spans_nothing_is_added(spark, none):
    docs = spark.createDataFrame([(1, "call 310 555 4510 or 12"), (2, "nothing")], "doc_id long, text string")
    for source in (docs, none):
        model = pii.train(source, s=SMALL)
        assert [r["model"] for r in model.collect()] in ([], [b""])
        assert [r["spans"] for r in pii.find(docs, model, s=SMALL).collect()] == ["", ""]
    assert pii.find(none, pii.train(none, s=SMALL)).collect() == []


def test_redacted_texts(spark, none):
    docs = spark.createDataFrame([(1, "a", "write to x.y@z.org, or +1 310 555 4510!"), (2, "b", None), (3, "c", "plain")], "doc_id long, n string, text string")
    got = pii.redact(docs, pii.train(none))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a", "write to [EMAIL], or [PHONE]!"), (2, "b", None), (3, "c", "plain")]


def test_query(spark, sf, documents):
    got = {r["doc_id"]: r for r in pii.op13_bilstm_crf_pii(spark, sf).collect()}
    assert got.keys() == documents.keys()
    for i, t in documents.items():
        want, r = plain(t), got[i]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[2] == k for x in want) for k in range(4)]
        assert r["base_sha256"] == sha256(told(want).encode()).hexdigest()
        spans = [(int(a), int(b), list(PATTERNS).index(k)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (s[0], s[2]))
        extra = set(spans) - set(want)
        assert len(extra) == r["n_added"] and all(b <= c or d <= a for a, b, _ in extra for c, d, _ in want)
    assert any(zlib.crc32(str(i).encode()) % 5 == 0 for i in documents)
