"""What crafted input may cost: files that inflate a thousandfold, magic bytes by the thousand, pieces that cross words."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
import tracemalloc
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import bpe, common, exact_dedup, media, suffix_dedup, textblock, token_counts, toxicity, warc

CRLF = "\r\n"


def record(payload: bytes, kind="response", page=1) -> bytes:
    http = f"HTTP/1.1 200 OK{CRLF}Content-Length: {len(payload)}{CRLF * 2}".encode()
    digest = hashlib.sha256(payload).hexdigest()
    head = f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <{warc.URN}{page}>{CRLF}WARC-Payload-Digest: sha256:{digest}{CRLF}Content-Length: {len(http) + len(payload)}{CRLF * 2}"
    return head.encode() + http + payload + (CRLF * 2).encode()


def test_a_small_file_with_300_mb_is_read_in_little_memory():
    size, digest = 300 << 20, hashlib.sha256()
    http = f"HTTP/1.1 200 OK{CRLF}Content-Length: {size}{CRLF * 2}".encode()
    head = f"WARC/1.1{CRLF}WARC-Type: response{CRLF}Content-Length: {len(http) + size}{CRLF * 2}".encode()
    packer, out = zlib.compressobj(9, zlib.DEFLATED, 31), []
    zeros = bytes(1 << 20)
    for piece in [head + http, *(zeros for _ in range(300)), (CRLF * 2).encode()]:
        out.append(packer.compress(piece))
    for _ in range(300):
        digest.update(zeros)
    raw = b"".join(out) + packer.flush()
    assert len(raw) < 400_000
    tracemalloc.start()
    (found,) = warc.scanned(warc._inflated(raw))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.size == size and found.digest == digest.hexdigest() and peak < 50 << 20


def test_scanned_records_in_any_chunks():
    rng = random.Random(1)
    bodies = [b"", b"x", b"a\r\n\r\nb" * 50, rng.randbytes(5000)]
    whole = b"".join(record(b, page=k) for k, b in enumerate(bodies))
    for step in (1, 3, 17, 1000, len(whole)):
        got = list(warc.scanned(iter(whole[k : k + step] for k in range(0, len(whole), step))))
        assert [(r.size, r.digest) for r in got] == [(len(b), hashlib.sha256(b).hexdigest()) for b in bodies]
    members = b"".join(gzip.compress(record(b)) for b in bodies)  # a member for each record, as other writers have it
    assert len(list(warc.scanned(warc._inflated(members, 13, 7)))) == len(bodies)
    assert list(warc.scanned(warc._inflated(gzip.compress(b"")))) == [] and list(warc.scanned(iter([]))) == []


@pytest.mark.parametrize("damage", [lambda w: w[:-5], lambda w: w[:60], lambda w: b"x" + w, lambda w: w.replace(b"Content-Length", b"Content-Lenght"), lambda w: w + b"rest"])
def test_damaged_files_are_errors(damage):
    with pytest.raises(ValueError, match="don't agree"):
        list(warc.scanned(iter([damage(record(b"payload"))])))


def test_cut_compressed_files_are_errors():
    with pytest.raises(ValueError, match="don't agree"):
        list(warc.scanned(warc._inflated(gzip.compress(record(b"payload" * 100))[:-9])))


@pytest.mark.parametrize("magic", [b"%PDF-", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03", b"BM", b"%PDF-%%EOF", b"startxref%PDF-"])
def test_magic_bytes_by_the_thousand(magic):
    payload = (magic * ((1 << 20) // len(magic) + 1))[: 1 << 20]
    began = time.perf_counter()
    found = media.sniffed(payload)
    assert time.perf_counter() - began < 3 and len(found) <= 1


def test_a_bomb_is_confirmed_in_little_memory():
    bomb = gzip.compress(bytes(100 << 20))
    tracemalloc.start()
    assert media.sniffed(b"1234" + bomb + b"after") == [media.Found("application/gzip", 4, 4 + len(bomb))]
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_gzip_headers():
    body = zlib.compress(b"text" * 50, wbits=-15)
    tail = zlib.crc32(b"text" * 50).to_bytes(4, "little") + (200).to_bytes(4, "little")
    for flags, more in ((0, b""), (4, b"\x03\x00abc"), (8, b"name\0"), (16, b"note\0"), (2, b"\1\2"), (31, b"\x01\x00zname\0note\0\1\2")):
        whole = b"\x1f\x8b\x08" + bytes([flags]) + b"\0" * 6 + more + body + tail
        assert media.sniffed(whole + b"x") == [media.Found("application/gzip", 0, len(whole))]
        assert not media.sniffed(whole[:-1]) and not media.sniffed(whole[:-1] + bytes([whole[-1] ^ 1]))


def test_finds_of_one_kind_do_not_nest():
    pdf = b"%PDF-1 %PDF-2 startxref 0 %%EOF"
    assert media.sniffed(pdf + b" %PDF-3") == [media.Found("application/pdf", 0, len(pdf))]
    assert [f.start for f in media.sniffed(pdf + pdf)] == [0, len(pdf)]


def test_carved_spans_are_told(spark):
    inner = "%PDF-1.4 startxref 12 %%EOF"
    docs = spark.createDataFrame([(1, "before " + inner + " after"), (2, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedded"] for r in media.features(media.store(docs)).collect()}
    assert [(e["kind"], e["start"], e["length"]) for e in got[1]] == [("application/pdf", 44 + 7, len(inner))] and got[2] == []


def test_pieces_that_cross_words_are_refused(monkeypatch):
    import sentencepiece

    class Model:
        pieces = ["<unk>", "▁a", "▁▁", "b", "a▁b"]

        def __init__(self, model_file):
            pass

        def __len__(self):
            return len(self.pieces)

        is_unknown = lambda self, i: i == 0
        is_control = is_byte = is_unused = lambda self, i: False
        id_to_piece = lambda self, i: self.pieces[i]
        get_score = lambda self, i: -float(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="a▁b"):
        token_counts.vocabulary.__wrapped__("crossing")
    Model.pieces = Model.pieces[:-1]
    assert token_counts.vocabulary.__wrapped__("fine")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_rows_chosen_by_few_keys_stay_where_they_are(spark, tmp_path, how, most):
    rows = spark.createDataFrame([(k if k % 7 else None, f"text {k}") for k in range(100)], "id long, text string")
    keys = common.written(spark.createDataFrame([(k,) for k in range(0, 100, 3)], "id long"), "keys")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = common.chosen(rows, keys, "id", how, most)
        assert ("Exchange hashpartitioning" in plan_of(got)) == (most == 0)
        want = {k for k in range(100) if ((k % 7 != 0 and k % 3 == 0) == (how == "left_semi"))}
        assert sorted(r["text"] for r in got.collect()) == sorted(f"text {k}" for k in want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_survivors_of_exact_dedup_do_not_shuffle_texts(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k % 40} " * 9, "x") for k in range(60)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    got = exact_dedup.survivors(docs)
    assert "Exchange hashpartitioning" not in plan_of(got)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40)) and got.columns == docs.columns


def test_word_buckets_grow_with_the_text(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, None), (3, "é" * 500)], "doc_id long, text string")
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bpe.word_buckets(docs, "text") == least and bpe.word_buckets(docs, "text", 10) == max(least, 200) and bpe.word_buckets(docs.limit(0), "text") == least


def part_of(texts: list[bytes]) -> suffix_dedup.Part:
    body, at = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64)
    n, none = len(texts), np.empty(0, np.int64)
    digest = np.frombuffer(b"".join(hashlib.sha256(x).digest() for x in texts), np.uint8)
    return suffix_dedup.Part(suffix_dedup.packed(order=np.arange(n), null=np.zeros(n, np.uint8), digest=digest, size=np.diff(at), text=body, back=none.astype(np.uint8), windows=none.astype(np.uint8), low=none.astype(np.int32), doc=none.astype(np.int32), known_low=none, known_high=none, others=np.empty(0, np.uint8)))


def test_what_windows_leave_of_a_part_takes_few_bytes_for_each_of_its():
    """tracemalloc sees numpy's arrays; with 8-byte sums over all bytes this was 23 bytes for each."""
    rng = random.Random(5)
    texts = [rng.randbytes(rng.choice([0, 0, 1, 99, 100, 101, 5000, 200_000])) for _ in range(300)]
    windows = [(k, a, min(a + rng.randrange(300), len(x) - 100)) for k, x in enumerate(texts) if len(x) >= 100 for a in (0, len(x) - 100, *(rng.randrange(len(x) - 99) for _ in range(20)))]
    doc, low, high = (np.array(x) for x in zip(*windows, strict=True))
    own = part_of(texts)
    half = len(doc) // 2
    back = [(3, suffix_dedup.packed(doc=doc[:half].astype(np.int32), low=low[:half], high=high[:half])), (suffix_dedup.COVERED, suffix_dedup.packed(doc=doc[half:].astype(np.int32), low=low[half:] + own.at[doc[half:]], high=high[half:] + own.at[doc[half:]]))]
    tracemalloc.start()
    stays, removed, spans = suffix_dedup.left_of(own, back)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(own.text)
    gone = [bytearray(len(x)) for x in texts]
    for k, a, b in windows:
        gone[k][a : b + 100] = b"\x01" * (b + 100 - a)
    assert stays.tobytes() == bytes(1 - x for g in gone for x in g)
    assert removed.tolist() == [sum(g) for g in gone] and spans.tolist() == [len([x for x in bytes(g).split(b"\x00") if x]) for g in gone]
    assert [x.tolist() for x in suffix_dedup.left_of(part_of([b"", b""]), [])] == [[], [0, 0], [0, 0]]


def test_a_part_is_packed_without_a_copy_of_all():
    text = np.frombuffer(random.Random(6).randbytes(1 << 20) * 8, np.uint8)
    arrays = {"text": text, "none": np.empty(0, np.int64), "low": np.arange(-5, 5), "again": np.array([1, 2], "<u8")}
    tracemalloc.start()
    raw = suffix_dedup.packed(**arrays)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text)
    got = suffix_dedup.unpacked(raw)
    assert list(got) == list(arrays) and all(np.array_equal(got[k], x) and got[k].dtype == x.dtype for k, x in arrays.items())


def test_tasks_of_another_kind_remove_what_is_kept():
    made = []
    keeps = lru_cache(maxsize=1)(lambda path: made.append(path) or path)
    one = textblock.tidied(lambda batches: (keeps("x") for _ in batches), lasting=[keeps])
    other = textblock.tidied(lambda batches: batches)
    assert list(one(iter([1, 2]))) == list(one(iter([1, 2]))) == ["x", "x"] and made == ["x"]
    assert list(other(iter([1]))) == [1] and keeps.cache_info().currsize == 0
    assert list(one(iter([1]))) == ["x"] and made == ["x", "x"]


def test_fit_takes_texts_in_an_order_without_copies_of_them():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(600)] + ["", "\u00e4\u00f6 x"]
    labels = np.array([int("abc" in x[:200]) for x in texts])
    order = np.array(rng.sample(range(len(texts)), len(texts)))
    given = pa.chunked_array([texts[:100], [], texts[100:101], texts[101:]], pa.string())
    s = toxicity.Settings(epochs=5, buckets_log2=12)
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    number, n, count, to = toxicity.dictionary(given, order, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pa.total_allocated_bytes() == before and peak < 2 * given.nbytes + (60 << 20) and n.tolist() == [len(texts[k].split()) for k in order]
    numbers, intercept = toxicity.fit(given, labels, s, order)
    sorted_, same = toxicity.fit(pa.array([texts[k] for k in order], pa.large_string()), labels[order], s)
    assert np.array_equal(numbers, sorted_) and intercept == same
