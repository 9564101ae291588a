"""Byte-level BPE over a corpus: every distinct word is encoded once.

1. Texts are cut into pre-tokens with their positions. What a part of the input (``PART_BYTES`` of
   text) says is a row of ``parts``: its distinct words, and for each position the word's number.
2. The words are dealt out by their hash, all copies of a word to one bucket. A row holds what one
   part sends to one bucket, so a word costs a few bytes and a bucket is read as a stream. A
   bucket encodes each of its distinct words once. Buckets grow in number with the text, so the words that a task
   knows don't; a part sends a row to each bucket that it has words for, and never more rows than it has words.
3. The ids go back to the part, which puts them together by position.
4. Decoding looks every id up in the token-byte table, which is as large as the vocabulary.

Null text is an empty one: no ids; null and repeated identifiers are documents like any other; an
empty table gives no rows; other columns are not read. A text longer than a part is a part of its own, which its task holds
whole, with four bytes for each of its words.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import pretoken
from barloom.llm.common import slim, table
from barloom.llm.textblock import blocks, distinct_words, gather, text_bytes, tidied

PART_BYTES = 24 << 20
#: Text whose distinct words go to one bucket, where there is more than the shuffle partitions' buckets are for.
BUCKET_BYTES = 256 << 20
#: Buckets of a part's own rows.
HEAD, ORDER = -1, -2
PARTS = "part string, bucket int, ids array<long>, sizes binary, body binary"
DOCS = "doc_id long, n_tokens long, ids binary, decoded binary"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The rank of each token's bytes, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def word_encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, where each id's begin, and how many they are."""
    table = {i: w for w, i in ranks(path).items()}
    length = np.array([len(table.get(i, b"")) for i in range(max(table) + 1)])
    return np.frombuffer(b"".join(table.get(i, b"") for i in range(len(length))), np.uint8), np.cumsum(length) - length, length


def shrunk(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, their bytes in four planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def grown(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


PARTS_ARROW = pa.schema([("part", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("body", pa.binary())])


def parts(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of each part: HEAD (identifiers, words of each text, numbers by position), ORDER (the numbers in the order of the buckets' words), one for each bucket (its words' bytes)."""

    def flush(name: str, ids: list, known: dict[bytes, int], numbers: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, part, by_place = list(known), name, np.concatenate(numbers)
        # frequent words get small numbers, which compress
        often = np.argsort(-np.bincount(by_place, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        own: list[list[int]] = [[] for _ in range(buckets)]
        for k in sorted(range(len(words)), key=words.__getitem__):
            own[zlib.crc32(words[k]) % buckets].append(k)
        dealt = np.array([k for some in own for k in some], np.int64)
        yield _row(PARTS_ARROW, part, HEAD, ids, shrunk(np.concatenate(sizes)), shrunk(rank[by_place]))
        yield _row(PARTS_ARROW, part, ORDER, None, shrunk(rank[dealt]), b"")
        for k, some in enumerate(own):
            if some:
                mine = [words[x] for x in some]
                yield _row(PARTS_ARROW, part, k, None, shrunk(np.fromiter(map(len, mine), np.int64, len(mine))), zstandard.compress(b"".join(mine), 3))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, numbers, sizes, held, nth = [], {}, [], [], 0, 0
        name = lambda: f"{TaskContext.get().partitionId()}-{nth}"  # noqa: E731  the same in a task that runs again
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            for i, j in blocks(at):
                if held and held + at[j] - at[i] > part_bytes:
                    yield from flush(name(), ids, known, numbers, sizes)
                    ids, known, numbers, sizes, held, nth = [], {}, [], [], 0, nth + 1
                held += int(at[j] - at[i])
                own, edge = body[at[i] : at[j]], at[i : j + 1] - at[i]
                start = pretoken.words(own, edge, "tiktoken")
                words, number = distinct_words(own, start)
                here = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                numbers.append(here[number] if len(words) else number.astype(np.int32))
                sizes.append(np.diff(np.searchsorted(start, edge)))
                ids += batch.column(0)[i:j].to_pylist()
        if ids:
            yield from flush(name(), ids, known, numbers, sizes)

    return slim(docs, key, text).mapInArrow(tidied(cut), PARTS)


def encoded(words: DataFrame, path: str) -> DataFrame:
    """For each row of words the ids, as many as ``sizes`` says for each word. Rows of a bucket lie together, so each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, bucket, known = word_encoder(path)._core_bpe, None, {}
        for batch in batches:
            for part, k, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("part", "bucket", "sizes", "body")), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                raw, edge = zstandard.decompress(body), np.append(0, np.cumsum(grown(sizes))).tolist()
                got = []
                for a, b in zip(edge, edge[1:], strict=False):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = core.encode_single_piece(word)
                    got.append(ids)
                yield _row(PARTS_ARROW, part, k, None, shrunk(np.fromiter(map(len, got), np.int64, len(got))), shrunk(np.fromiter((x for g in got for x in g), np.int64)))

    return words.mapInArrow(tidied(encode), PARTS)


def put_together(path: str):
    """A part's documents from its own rows and its words' ids: ids (decimal, joined by commas) and the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def documents(ids, sizes, body, dealt, lengths, values) -> Iterator[pa.RecordBatch]:
        numbers, words, length, begin = grown(body), grown(sizes), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        length[dealt], begin[dealt] = lengths, np.cumsum(lengths) - lengths
        pool, first, count = token_bytes(path)
        decimal = [str(i) for i in range(len(count))]
        edge, out, held = np.append(0, np.cumsum(words)), [], 0
        for k, doc in enumerate(ids):
            mine = numbers[edge[k] : edge[k + 1]]
            own = gather(values, begin[mine], length[mine]) if len(mine) else values[:0]
            raw = gather(pool, first[own], count[own]) if len(own) else pool[:0]
            out.append((doc, len(own), ",".join([decimal[x] for x in own.tolist()]).encode(), raw.tobytes()))
            held += len(raw)
            if held > 4 << 20 or k + 1 == len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, held = [], 0

    def assemble(own: pa.Table, back: pa.Table) -> pa.Table:
        rows = {r["bucket"]: r for r in own.filter(pc.less(own["bucket"], 0)).to_pylist()}
        lengths, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in back.sort_by("bucket").to_pylist():
            lengths.append(grown(r["sizes"]))
            values.append(grown(r["body"]))
        head = rows[HEAD]
        return pa.Table.from_batches(documents(head["ids"], head["sizes"], head["body"], grown(rows[ORDER]["sizes"]), np.concatenate(lengths), np.concatenate(values)), schema)

    return assemble


def only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In Python, as a filter would go below the exchange that both readers of the parts share."""
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0))


def word_buckets(docs: DataFrame, text: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many that a bucket holds the distinct words of ``bucket_bytes`` of text at most, on average; lengths are read, no text leaves the JVM."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document."""
    buckets = word_buckets(docs, text)
    cut = parts(docs, buckets, key, text, part_bytes).repartition("part")  # one exchange, read twice
    words = cut.mapInArrow(only_words, PARTS).repartition("bucket").sortWithinPartitions("bucket")
    return cut.groupBy("part").cogroup(encoded(words, path).groupBy("part")).applyInArrow(put_together(path), DOCS)


def op5_distinct_word_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
