"""Each operator against a plain version, on odd texts and on a small table; nulls, repeats and empty tables."""

from __future__ import annotations

import binascii
import struct
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, exact_dedup, media, near_dedup, packing, queries, sharding, suffix_dedup, token_counts, toxicity, warc
from brute import WHITE, near, sha256, unigram, window_score, without_repeats

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def duck(sf, sql):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return sorted(con.execute(sql).fetchall())


def same_as_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con_rows = duck(sf, queries.ORACLE_SQL[name])
    assert sorted(map(tuple, got.collect())) == con_rows


# 1: packing


def token_lists(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE_50K)
    own.encode_special_tokens = True
    return {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}


def packing_is_right(rows, texts, capacity=1024):
    ids, pieces, sequences = token_lists(texts), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            part = ids[i][at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(np.array(part, "<u4").tobytes()))
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids[i])
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), Counter(r["length"] for r in rows)


def first_fit(counts, capacity=1024):
    rooms = []
    for x in sorted(counts.elements(), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= x), None)
        if k is None:
            rooms.append(capacity - x)
        else:
            rooms[k] -= x
    return len(rooms)


def test_packing(odd, texts, none):
    n, counts = packing_is_right(packing.pack(odd, BPE_50K).collect(), texts)
    assert n <= first_fit(counts)
    assert packing.pack(none, BPE_50K).count() == 0


def test_packing_query(spark, sf, documents):
    n, counts = packing_is_right(queries.QUERIES["op1_dominance_best_fit_packing"](spark, sf).collect(), documents.items())
    assert n <= first_fit(counts)


def smallest(lengths, capacity):
    """The least number of sequences, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            at = rooms.index(room)
            place(k + 1, [*rooms[:at], room - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_dominance_fixes_only_what_some_best_packing_holds():
    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.integers(10, 40))
        lengths = [int(x) for x in rng.integers(1, capacity + 1, rng.integers(1, 11))]
        plan = packing.Plan(dict(Counter(lengths)), capacity)
        packing.reduce(plan)
        left = [x for x, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + smallest(left, capacity) == smallest(lengths, capacity), (capacity, lengths)


# 2: WARC


def test_warc_query(spark, sf):
    same_as_sql(spark, sf, "op2_warc_archive")


@pytest.mark.parametrize("name", ["op4_hyperminhash_near_dedup", "op6_signature_sniffed_media", "op7_rendezvous_sharding", "op10_suffix_merge_dedup"])
def test_query_equals_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


@pytest.mark.parametrize("name", ["op4_hyperminhash_near_dedup", "op6_signature_sniffed_media", "op7_rendezvous_sharding", "op8_streaming_exact_dedup", "op10_suffix_merge_dedup"])
def test_query_equals_sql_on_odd_texts(spark, odd, texts, tmp_path, name):
    """Nulls, empty and very long texts, equal texts; the last one, which holds a NUL, is left out."""
    odd.filter("doc_id <= 17").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())


def test_warc_odd_pages(spark, tmp_path):
    big = "x" * 200
    rows = [(1, "u", big), (2, None, big), (3, "a\r\nb", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (2, "u", "é" * 60)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").write.parquet(path)
    warc.write_archive(spark.read.parquet(path), str(tmp_path / "archive"))
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_back(spark, str(tmp_path / "archive")).collect())
    assert got == Counter([(1, 200, "response", None), (2, 200, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (None, 200, "revisit", 1), (2, 120, "response", None)])
    kept = warc.records(spark, str(tmp_path / "archive")).collect()
    assert all(r["verified"] for r in kept) and any("a%0D%0Ab" in r["head"] for r in kept)
    assert spark.read.parquet(str(tmp_path / "archive/payloads")).count() == 4
    warc.write_warc(spark, str(tmp_path / "archive"), str(tmp_path / "files"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    import gzip

    whole = gzip.decompress(raw)
    assert whole.count(b"WARC/1.1\r\n") == len(rows) and whole.endswith(b"\r\n\r\n")
    heads = [h for h, _ in warc.warc_records(iter(whole[k : k + 7] for k in range(0, len(whole), 7)))]
    assert sorted(h.split(b"\r\nWARC-Record-ID: ")[1].split(b"\r\n")[0] for h in heads) == sorted(f"<{warc.URN}{'' if r[0] is None else r[0]}>".encode() for r in rows)
    read = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "files")).collect())
    assert read == got


def test_warc_without_pages(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(path)
    warc.write_archive(spark.read.parquet(path), str(tmp_path / "archive"))
    assert warc.read_back(spark, str(tmp_path / "archive")).count() == 0
    warc.write_warc(spark, str(tmp_path / "archive"), str(tmp_path / "files"))
    assert warc.read_warc(spark, str(tmp_path / "files")).count() == 0


def test_warc_of_long_and_nested_payloads(spark, tmp_path):
    """A payload that looks like records itself, and one of some MB, over files of one record."""
    trap = "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n" * 4
    rows = [(1, "u", trap), (2, "u", "é" * 3_000_000), (3, "u", trap), (-4, "u", "\r\n\r\n" * 40)]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, head string").write.parquet(str(tmp_path / "pages"))
    warc.write_archive(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "archive"))
    warc.write_warc(spark, str(tmp_path / "archive"), str(tmp_path / "files"), per_file=1)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "files")).collect()}
    assert got == {i: (len(h.encode()), sha256(h.encode()), "revisit" if i == 3 else "response", 1 if i == 3 else None) for i, _, h in rows}
    with pytest.raises(ValueError, match="within a record"):
        list(warc.warc_records(iter([b"WARC/1.1\r\nContent-Length: 50\r\n\r\nabc"])))


# 3: toxicity


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = by_id(queries.QUERIES["op3_subword_bag_toxicity"](spark, sf))
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (binascii.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[i]["score"], y) for i, y in marked.items() if i in rows and rows[i]["held_out"]]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9


SMALL = toxicity.Settings(buckets_log2=14, epochs=10, batch=8)


@pytest.fixture(scope="module")
def insults(table_of):
    rng = np.random.default_rng(3)
    plain = ["river", "garden", "letter", "window", "market", "bridge", "summer", "teacher"]
    texts = [(i, " ".join(rng.choice(plain, 12)) + (" stupid idiots" if i % 2 else "")) for i in range(1, 161)]
    return table_of([*texts, (1001, "river stupiid idiotss garden"), (1002, "river letter garden"), (1003, None), (None, "summer letter"), (1002, "river letter garden")])


def test_toxicity_shares_grams_and_handles_odd_rows(spark, insults):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 161)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.classify(insults, labels, SMALL).collect()
    assert len(rows) == 165
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1001] > 0.5 > score[1002]
    assert not next(r for r in rows if r["doc_id"] is None)["held_out"]
    kept = toxicity.clean(insults, labels, s=SMALL)
    assert kept.columns == insults.columns and 1001 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize(("labels", "expected"), [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_toxicity_without_both_classes(spark, insults, none, labels, expected):
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert all(abs(r["score"] - expected) < 1e-6 for r in toxicity.classify(insults, marks, SMALL).collect())
    assert toxicity.classify(none, marks, SMALL).count() == 0


def test_toxicity_scores_equal_a_plain_forward_pass(spark, odd, texts):
    """Every text's score under a model of random weights, word by word."""
    weights = np.random.default_rng(4).normal(0, 5, 1 << SMALL.buckets_log2).astype(np.float32)
    model = spark.createDataFrame([(bytearray(weights.tobytes()), -0.5)], "numbers binary, intercept double")
    got = by_id(toxicity.score(odd, model, s=SMALL))
    for i, t in texts:
        want = window_score(t, weights, -0.5, SMALL.shortest, SMALL.longest, SMALL.window)
        assert got[i]["score"] == pytest.approx(want, abs=1e-6), i


# 4: near duplicates


def test_near_dedup(odd, texts, none):
    got = {r["id"]: (r["n"], r["component"]) for r in near_dedup.assign(odd).collect()}
    assert got == near(dict(texts))
    assert near_dedup.assign(none).count() == 0
    assert {r["doc_id"] for r in near_dedup.survivors(odd).collect()} == {i for i, (_, c) in got.items() if i == c}


def test_near_dedup_query(spark, sf, documents):
    rows = queries.QUERIES["op4_hyperminhash_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near(documents)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_dedup_around_the_threshold(table_of):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 100_000, rng.integers(8, 120))]
        rows.append((3 * k, " ".join(words)))
        for j in (1, 2):
            other = list(words)
            for at in rng.integers(0, len(words), max(1, len(words) // int(rng.integers(20, 60)))):
                other[at] = f"v{rng.integers(0, 100_000)}"
            rows.append((3 * k + j, " ".join(other)))
    docs, want = table_of(rows), near(dict(rows))
    for few in (near_dedup.FEW, None):
        assert {r["id"]: (r["n"], r["component"]) for r in near_dedup.assign(docs, few=few).collect()} == want


def test_near_dedup_null_and_repeated_identifiers(table_of):
    text = "a b c d e f g h i j k"
    got = near_dedup.assign(table_of([(None, text), (None, text), (5, text), (5, "other words here"), (9, text), (7, "other words here")])).collect()
    assert Counter((r["id"], r["component"]) for r in got) == Counter({(None, None): 2, (5, 5): 2, (9, 5): 1, (7, 5): 1})


def test_unrelated_sets_agree_as_often_as_the_correction_says(spark):
    """Registers of many unrelated sets: their share of equal ones is the computed chance, and the corrected estimate is about 0."""
    rng = np.random.default_rng(8)
    draw = lambda n: near_dedup.registers(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))
    rows = [(draw(2000).astype(int).tolist(), draw(2600).astype(int).tolist(), 2000, 2600) for _ in range(600)]
    df = spark.createDataFrame(rows, "x array<int>, y array<int>, n long, m long")
    got = df.select(near_dedup.estimate(F.col("x"), F.col("y"), F.col("n"), F.col("m")).alias("e"), near_dedup.collisions(F.col("n"), F.col("m")).alias("c")).agg(F.avg("e").alias("e"), F.first("c").alias("c")).first()
    equal = np.mean([a == b for x, y, _, _ in rows for a, b in zip(x, y, strict=True)])
    assert 0 < got["c"] and abs(equal - got["c"]) < 5 * (got["c"] / (600 * near_dedup.REGISTERS)) ** 0.5 and abs(got["e"]) < 5 * (got["c"] / (600 * near_dedup.REGISTERS)) ** 0.5


def test_registers_hold_zeros_and_mantissa():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    got = near_dedup.registers(hashes)
    for b in range(near_dedup.REGISTERS):
        least = min(int(h) & (2**57 - 1) for h in hashes if int(h) >> 57 == b)
        zeros = 57 - least.bit_length()
        bits = (least << (64 - 57 + zeros + 1) & (2**64 - 1)) >> (64 - near_dedup.MANTISSA)
        assert int(got[b]) == (zeros + 1) << near_dedup.MANTISSA | bits


# 5: byte-level BPE


def bpe_is_right(rows, texts):
    core = bpe.word_encoder(MULTI)
    want = {i: core.encode_ordinary(t or "") for i, t in texts}
    assert len(rows) == len(want)
    for r in rows:
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) == (len(ids), ",".join(map(str, ids)).encode(), core.decode_bytes(ids))


def test_bpe(odd, texts, none):
    bpe_is_right(bpe.encode_decode(odd, MULTI).collect(), texts)
    bpe_is_right(bpe.encode_decode(odd, MULTI, part_bytes=500).collect(), texts)
    assert bpe.encode_decode(none, MULTI).count() == 0


def test_bpe_query(spark, sf, documents):
    core = bpe.word_encoder(MULTI)
    rows = by_id(queries.QUERIES["op5_distinct_word_bpe"](spark, sf))
    assert rows.keys() == documents.keys()
    for i, t in documents.items():
        ids = core.encode_ordinary(t or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()), sha256((t or "").encode()))


# 6: media columns


def test_media(odd, texts, none):
    rows = by_id(media.features(media.store(odd)))
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        wave = media.as_wave(payload)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wave), sha256(wave)) and r["feature"].startswith("audio/wav;")
    assert rows[11]["feature"] == rows[12]["feature"]
    assert media.features(media.store(none)).count() == 0


def png():
    chunk = lambda name, body: struct.pack(">I4s", len(body), name) + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


def test_media_types_are_corrected_and_embedded_media_carved():
    import gzip

    zipped = gzip.compress(b"text")
    wave = media.as_wave(b"\x80" * 64)
    for kind, body in (("image/png", png()), ("image/gif", GIF), ("application/gzip", zipped), ("audio/wav", wave)):
        assert media.corrected("text/plain", media.sniffed(body + b"tail")) == kind
        found = media.sniffed(b"junk " + body + b" tail")
        assert media.corrected("text/plain", found) == "text/plain"
        assert media.Found(kind, 5, 5 + len(body)) in found
    broken = bytearray(png())
    broken[20] ^= 1
    assert not media.sniffed(bytes(broken)) and not media.sniffed(b"BM is no picture, RIFF no sound, GIF89a neither")
    assert media.sniffed(b"") == []


def test_media_query(spark, sf, documents):
    rows = by_id(queries.QUERIES["op6_signature_sniffed_media"](spark, sf))
    assert rows.keys() == documents.keys()
    for i, t in documents.items():
        raw = (t or "").encode()
        assert rows[i]["payload_sha256"] == sha256(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))


# 7: sharding


def shard_of(key, weights):
    draw = lambda s: (int(md5(f"{s}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max(range(len(weights)), key=lambda s: (-weights[s] / np.log(draw(s)), -s))


def sharding_is_right(rows, texts, shards=16):
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["shard"] == shard_of("" if r["doc_id"] is None else r["doc_id"], [1.0] * shards) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(odd, texts, none, table_of):
    sharding_is_right(sharding.assign(odd).collect(), texts)
    twice = [(3, "a"), (3, "a"), (None, "b"), (None, None)]
    sharding_is_right(sharding.assign(table_of(twice)).collect(), twice)
    assert sharding.assign(none).count() == 0
    heavy = sharding.assign(odd, weights=[1.0, 3.0]).collect()
    assert all(r["shard"] == shard_of(r["doc_id"], [1.0, 3.0]) for r in heavy)
    with pytest.raises(ValueError):
        sharding.assign(odd, weights=[1.0, 0.0])


def test_sharding_query(spark, sf, documents):
    df = queries.QUERIES["op7_rendezvous_sharding"](spark, sf)
    sharding_is_right(df.collect(), documents.items())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = by_id(df)
    assert all((rows[i]["size"], rows[i]["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents.items())


# 8: exact duplicates


def exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[WHITE.sub(" ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), sha256(body.encode())) for body, g in groups.items() for i in g}


def test_exact_dedup(odd, texts, none):
    want = exact(texts)
    for options in ({}, {"trigger_bytes": 1}, {"digest": lambda body: exact_dedup.sha256(body).substr(1, 1)}):
        got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["sha256"]) for r in exact_dedup.assign(odd, **options).collect()}
        assert got == want, options
        assert exact_dedup.assign(none, **options).count() == 0
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_exact_dedup_null_and_repeated_identifiers(table_of):
    docs = table_of([(2, "a b"), (2, "a  b"), (None, "a b"), (None, "lone")])
    got = exact_dedup.assign(docs).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter([(2, 2, 3, True), (2, 2, 3, False), (None, 2, 3, False), (None, None, 1, True)])
    assert exact_dedup.survivors(docs).count() == 2


def test_exact_dedup_state_takes_little_disk_over_many_partitions(odd, spark, texts):
    """Allocated blocks of the stores, sampled while the stream runs; the session is left as it was."""
    import os
    import threading
    import time

    local = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    allocated = lambda: sum(os.lstat(os.path.join(d, f)).st_blocks * 512 for d, _, files in os.walk(local) for f in files if os.path.lexists(os.path.join(d, f)))
    before, most, done = allocated(), 0, threading.Event()

    def watch():
        nonlocal most
        while not done.is_set():
            try:
                most = max(most, allocated())
            except OSError:
                pass
            time.sleep(0.1)

    settings = {c: spark.conf.get(c, None) for c in exact_dedup.STATE}
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r["id"]: r["keep_id"] for r in exact_dedup.assign(odd).collect()}
    finally:
        done.set()
        watcher.join()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == {i: w[0] for i, w in exact(texts).items()}
    assert most - before < 60 << 20
    assert settings == {c: spark.conf.get(c, None) for c in exact_dedup.STATE}


def test_exact_dedup_query(spark, sf):
    same_as_sql(spark, sf, "op8_streaming_exact_dedup")


# 9: token counts


def test_token_counts(odd, none, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    longest = max(map(len, scores))
    rows = by_id(token_counts.counts(odd, PIECES))
    for i, t in texts:
        if t is None or len(t) < 5000:
            n, score = unigram(t, scores, longest)
            assert rows[i]["n_tokens"] == n and rows[i]["score"] == pytest.approx(score), i
    assert token_counts.counts(none, PIECES).count() == 0


def test_token_counts_query(spark, sf, documents):
    """Whole texts of the table, whatever their length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    rows = by_id(queries.QUERIES["op9_viterbi_token_counts"](spark, sf))
    assert rows.keys() == documents.keys()
    for i, t in documents.items():
        n, score = unigram(t, scores, max(map(len, scores)))
        assert rows[i]["n_tokens"] == n and rows[i]["score"] == pytest.approx(score), i


def test_token_count_ties():
    own = token_counts.Vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "▁": -1.0})
    rng = np.random.default_rng(2)
    scores = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "▁": -1.0}
    for _ in range(200):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        assert own.count("▁" + word) == pytest.approx(unigram(word, scores, 3))


# 10: repeated passages


def test_suffix_dedup(odd, texts, none):
    want = without_repeats(texts[:14])
    some = odd.filter("doc_id <= 14")
    for options in ({}, {"part_bytes": 300}):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.assign(some, **options).collect()}
        assert got == want, options
    assert suffix_dedup.assign(none).count() == 0
    kept = suffix_dedup.trimmed(some)
    assert kept.columns == odd.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: None if dict(texts)[i] is None else w[3].decode(errors="ignore") for i, w in want.items()}


def test_suffix_dedup_of_planted_passages(table_of):
    rng = np.random.default_rng(4)
    letters = "abcdefgh "
    draw = lambda n: "".join(rng.choice(list(letters), n))
    shared = [draw(n) for n in (99, 100, 101, 160, 400)]
    rows = [(i, "".join(x for k in range(rng.integers(0, 6)) for x in (draw(rng.integers(0, 150)), shared[rng.integers(0, 5)], "z" * int(rng.integers(0, 130))))) for i in range(80)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.assign(table_of(rows), part_bytes=4000).collect()}
    assert got == without_repeats(rows)


def test_suffix_dedup_null_and_repeated_identifiers(table_of):
    text = "x y z " * 5 + "".join(chr(97 + i * i % 23) for i in range(150))
    got = suffix_dedup.assign(table_of([(None, text), (4, text), (4, text), (9, text[:99])])).collect()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 4)[1] == len(text.encode())
    assert next(r["n_removed"] for r in got if r["doc_id"] is None) == len(text.encode())
    assert next(r["n_removed"] for r in got if r["doc_id"] == 9) == 0


def test_suffix_dedup_query(spark, sf, documents):
    rows = queries.QUERIES["op10_suffix_merge_dedup"](spark, sf).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == {i: (*w[:3], sha256(w[3])) for i, w in without_repeats(list(documents.items())).items()}


def test_near_dedup_with_a_passage_that_many_share(table_of):
    """Large bands of documents that are mostly not linked, at all shares of a common passage."""
    rng = np.random.default_rng(12)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(240):
        own = [f"u{x}" for x in rng.integers(0, 10**6, rng.integers(1, 24))]
        if i % 3 == 0 and rows:
            own = own[: len(own) // 3]
        rows.append((i, " ".join(passage[: int(rng.integers(30, 41))] + own)))
    assert {r["id"]: (r["n"], r["component"]) for r in near_dedup.assign(table_of(rows)).collect()} == near(dict(rows))


def test_near_dedup_of_short_texts_that_the_sketch_loses(table_of):
    """Sets of 4 and 3 shingles, similar by exactly 0.75: all estimates lie below the cut, and the last pair shares no band either."""
    rows = [(2 * k + j, " ".join(f"{c}{k}" for c in "abcdefgh"[: 8 - j])) for k in (2291, 16464, 18041) for j in (0, 1)]
    assert {r["id"]: (r["n"], r["component"]) for r in near_dedup.assign(table_of(rows)).collect()} == near(dict(rows))


def test_the_estimate_takes_out_what_sets_of_these_sizes_share_by_chance(spark):
    def chance(n, m):
        total = 0.0
        for z in range((1 << near_dedup.ZEROS) - 1):
            high, low = (2.0**-k / near_dedup.REGISTERS for k in (z, z + 1))
            total += ((1 - low) ** n - (1 - high) ** n) * ((1 - low) ** m - (1 - high) ** m)
        return total / 2.0**near_dedup.MANTISSA

    sizes = [(65, 87), (300, 400), (20_000, 25_000)]
    apart = spark.createDataFrame([([1, 2], [3, 4], n, m) for n, m in sizes], "x array<int>, y array<int>, n long, m long")
    got = {(r["n"], r["m"]): r["e"] for r in apart.select("n", "m", near_dedup.estimate(F.col("x"), F.col("y"), F.col("n"), F.col("m")).alias("e")).collect()}
    assert got == {(n, m): pytest.approx(-chance(n, m) / (1 - chance(n, m)), rel=1e-6) for n, m in sizes}


@pytest.mark.parametrize("period", [1, 2, 7, 50, 300])
def test_texts_of_a_short_period_have_few_anchors(period):
    raw = np.tile(np.arange(65, 65 + period, dtype=np.int64) % 251, 40_000 // period).astype(np.uint8)
    place, low, high, known_low, known_high = suffix_dedup.anchors(raw, np.array([0, len(raw) // 2, len(raw)]))
    assert len(place) <= 2 * period + 8 and len(known_low) <= 8
    windows = np.zeros(len(raw), int)
    for a, b in zip([*low, *known_low], [*high, *known_high], strict=True):
        windows[a : b + 1] += 1
    inside = np.ones(len(raw), int)
    inside[-99:] = inside[len(raw) // 2 - 99 : len(raw) // 2] = 0
    assert (windows == inside).all()


def test_hashes_are_counted_before_they_are_sent(table_of):
    rows = [(i, f"{i:04d} " + "".join(chr(97 + k * k % 23) for k in range(120))) for i in range(300)]
    docs = table_of(rows).coalesce(1)
    texts = suffix_dedup.parts(docs, "doc_id", "text", suffix_dedup.PART_BYTES)
    sent = [suffix_dedup.unpacked(bytes(r["body"])) for r in texts.mapInArrow(suffix_dedup.hashed(4), suffix_dedup.ROWS).collect()]
    assert all(len(np.unique(x["hashes"])) == len(x["hashes"]) for x in sent) and sum(x["count"].sum() for x in sent) >= 300


@pytest.mark.parametrize("runs", [1, 2, 5, 9])
def test_merged_runs_come_out_in_order_and_in_blocks_of_whole_grams(runs):
    rng = np.random.default_rng(runs)
    grams = [bytes(rng.integers(0, 3, suffix_dedup.GRAM, np.uint8)) for _ in range(4)]
    want, coded = [], []
    for r in range(runs):
        own = sorted(grams[rng.integers(0, 4)] + bytes(rng.integers(0, 2, suffix_dedup.KEY - suffix_dedup.GRAM, np.uint8) * (rng.random() < 0.7)) for _ in range(rng.integers(0, 40)))
        key = np.frombuffer(b"".join(own), np.uint8).reshape(-1, suffix_dedup.KEY)
        shared = suffix_dedup.shared_with_last(key)
        coded.append((key[np.arange(suffix_dedup.KEY)[None, :] >= shared[:, None]], shared))
        want += [(k, r) for k in own]
    merged = lambda: suffix_dedup.merged([suffix_dedup.decoded(*x) for x in coded])
    assert [(k, r) for r, _, k in merged()] == sorted(want)
    for least in (1, 7, 10**6):
        blocks = list(suffix_dedup.in_blocks(merged(), least))
        keys = np.concatenate([b[2] for b in blocks]) if blocks else np.empty((0, suffix_dedup.KEY), np.uint8)
        assert [bytes(k) for k in keys] == [k for k, _ in sorted(want)]
        if blocks:
            assert (np.concatenate([b[1] for b in blocks]) == suffix_dedup.shared_with_last(keys)).all()
        assert all(len(b[0]) >= least for b in blocks[:-1])
        firsts = [{bytes(k[: suffix_dedup.GRAM]) for k in b[2]} for b in blocks]
        assert sum(map(len, firsts)) == len(set().union(*firsts))


@pytest.mark.parametrize(("hot", "block", "bucket_bytes"), [(1, 1, 1 << 25), (10, 20, 500), (1 << 18, 1, 100), (1 << 18, 1 << 16, 1 << 25)])
def test_suffix_dedup_of_hot_anchors_and_periods(table_of, hot, block, bucket_bytes):
    rng = np.random.default_rng(6)
    common = "".join(rng.choice(list("abcdefgh "), 130))
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = [(i, draw(rng.integers(0, 90)) + common[rng.integers(0, 40) :] + draw(rng.integers(0, 90)) + "ab" * int(rng.integers(0, 120)) + "-" * int(rng.integers(0, 300))) for i in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.assign(table_of(rows), part_bytes=2000, hot=hot, block=block, bucket_bytes=bucket_bytes).collect()}
    assert got == without_repeats(rows)


@pytest.mark.parametrize(("table", "column", "change"), [("payloads", "payload", "cast(concat(cast(payload AS string), '!') AS binary)"), ("heads", "head", "replace(head, 'sha256:', 'sha256:0')"), ("heads", "head", "regexp_replace(head, 'Content-Length: ', 'Content-Length: 1')")])
def test_warc_reading_back_finds_damage(spark, tmp_path, table, column, change):
    spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    warc.write_archive(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "archive"))
    assert warc.read_back(spark, str(tmp_path / "archive")).count() == len(warc.read_back(spark, str(tmp_path / "archive")).collect()) == 3
    for name in ("heads", "payloads"):
        stored = spark.read.parquet(str(tmp_path / "archive" / name))
        (stored.withColumn(column, F.expr(change)) if name == table else stored).write.parquet(str(tmp_path / "damaged" / name))
    with pytest.raises(Exception, match="don't agree"):
        warc.read_back(spark, str(tmp_path / "damaged")).collect()
    with pytest.raises(Exception, match="don't agree"):
        warc.write_warc(spark, str(tmp_path / "damaged"), str(tmp_path / "files"))
        warc.read_warc(spark, str(tmp_path / "files")).collect()
