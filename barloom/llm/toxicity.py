"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams, ends marked, hashed to ``buckets`` vectors; a passage of
``window`` words is the average of its words, each the average of its n-grams; a linear layer and a
softmax give the two classes. A text has the score of its worst passage, so that its length doesn't
thin out what makes it toxic; in training, the passage is random at first and then the worst so far. Vectors and layer are trained jointly, in numpy, with Adagrad. As all of it is linear
up to the softmax, a trained model folds into one number for each bucket and an intercept, so a
word that was never seen, such as a new misspelling, is scored by the n-grams that it shares.

The model is fitted on at most ``rows`` labelled rows (the smallest hashes of their identifiers),
which bounds the one task that fits it; all rows are scored, whole.

Null text is an empty one; a text without words gets the score of the intercept; null and repeated
identifiers are scored like others (a null one is never held out: nothing is learnt from it);
repeated labels of an identifier count as the largest; without labels of both classes every score
is the share of label 1 (0 without labels); an empty table gives no rows. A very long text is one block
of its task: its code points (4 bytes each), the places of its words, and the n-grams of its distinct words; the fit holds at most ``rows`` whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.llm import pretoken
from barloom.llm.common import slim, small_batches, table, written
from barloom.llm.textblock import blocks, gather, mixed, text_bytes, tidied

#: Words whose windows are looked at at once.
WORDS = 1 << 18
#: Distinct words whose n-grams are worked on at once.
WORDS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Settings:
    rows: int = 12_000
    buckets_log2: int = 18
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    epochs: int = 14
    #: In the first ones, the passage of each text is chosen at random.
    random_epochs: int = 3
    window: int = 4
    batch: int = 64
    rate: float = 0.5
    layer_rate: float = 0.2
    #: The average is multiplied by this: one word of a passage can make it toxic.
    gain: float = 10.0
    seed: int = 7


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Each code point in lower case, where that is one code point."""
    out = np.arange(pretoken.POINTS, dtype=np.uint32)
    for i in np.flatnonzero(pretoken.classes("tiktoken") == pretoken.LETTER).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def words_of(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of a block, begin and end of each word (letters and digits), and the text that it is in."""
    point = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), "<u4")
    edge = at if len(point) == len(body) else np.searchsorted(np.flatnonzero((body & 0xC0) != 0x80), at)
    kind = pretoken.classes("tiktoken")[point]
    inside = (kind == pretoken.LETTER) | (kind == pretoken.NUMBER)
    first = np.zeros(len(point) + 1, bool)
    first[edge] = True
    begin = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
    end = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1
    return _lower()[point], begin, end, np.searchsorted(edge, begin, "right") - 1


def distinct_ranges(point: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first range of each distinct word, and each word's number among them; words are told apart by 64-bit hashes."""
    h = np.zeros(len(begin), np.uint64)
    length = end - begin
    order = np.argsort(-length, kind="stable")
    still = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")
    with np.errstate(over="ignore"):
        for k, n in enumerate(still.tolist()):  # the words longer than k
            of = order[:n]
            h[of] = mixed(h[of] + point[begin[of] + k].astype(np.uint64) + np.uint64(1))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    return first, number


def grams(point: np.ndarray, begin: np.ndarray, end: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of every n-gram of the words; a whole marked word counts as one too."""
    length = end - begin + 2
    close = np.cumsum(length)
    flat = np.full(int(length.sum()), ord("<"), np.uint64)
    inner = np.ones(len(flat), bool)
    inner[close - 1] = inner[close - length] = False
    flat[inner] = gather(point, begin, end - begin)
    flat[close - 1] = ord(">")
    word = np.repeat(np.arange(len(begin)), length)
    left = np.repeat(close, length) - np.arange(len(flat))  # characters from here to the word's end
    shift, of, to = np.uint64(64 - s.buckets_log2), [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, s.longest + 1):
        fits = np.flatnonzero(left >= n)
        h[fits] = mixed(h[fits] + flat[fits + n - 1] * np.uint64(n))
        if n >= s.shortest:
            of.append(word[fits])
            to.append((h[fits] >> shift).astype(np.int64))
    return np.concatenate(of), np.concatenate(to)


def best_windows(word: np.ndarray, number: np.ndarray, edge: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text (words ``edge[k]`` to ``edge[k + 1]`` of ``number``) where its best window of ``size`` words begins, and that window's mean; 0 without words. ``word`` has the words' values. Some texts at a time."""
    got = [(np.empty(0, np.int64), np.empty(0))]
    for i, j in blocks(edge, WORDS):
        begin, best = _best_windows(word[number[edge[i] : edge[j]]], edge[i : j + 1] - edge[i], size)
        got.append((begin + edge[i], best))
    begin, best = (np.concatenate(x) for x in zip(*got, strict=True))
    return begin, best


def _best_windows(value: np.ndarray, edge: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    before = np.append(0.0, np.cumsum(value))
    n = np.diff(edge)
    starts = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(n)), starts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts) + edge[text]
    end = np.minimum(at + size, edge[text + 1])
    mean = (before[end] - before[at]) / (end - at)
    begin, best = edge[:-1].copy(), np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        best[some] = np.maximum.reduceat(mean, (np.cumsum(starts) - starts)[some])
        top = np.flatnonzero(mean == best[text])[::-1]
        begin[text[top]] = at[top]  # the first of equal ones
    return begin, best


def in_blocks(texts: pa.Array | pa.ChunkedArray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in ``order``, as bytes of some texts and where each begins and the last ends. Only one block's bytes are copied at once."""
    chunks = [text_bytes(x) for x in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts])]
    first = np.cumsum([0, *(len(at) - 1 for _, at in chunks)])
    chunk = np.searchsorted(first, order, "right") - 1
    row = order - first[chunk]
    length = np.concatenate([np.empty(0, np.int64), *(np.diff(at) for _, at in chunks)])[order]
    edge = np.append(0, np.cumsum(length))
    for i, j in blocks(edge):
        some = [chunks[c][0][chunks[c][1][k] : chunks[c][1][k + 1]] for c, k in zip(chunk[i:j].tolist(), row[i:j].tolist(), strict=True)]
        yield np.concatenate(some), edge[i : j + 1] - edge[i]


def dictionary(texts: pa.Array | pa.ChunkedArray, order: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Each word of the texts, taken in ``order``, as a number, how many words each text has, and the distinct words' n-grams: how many each word has, and their buckets, by word."""
    known: dict[bytes, int] = {}
    numbers, sizes, of, to = [np.empty(0, np.int32)], [], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for body, at in in_blocks(texts, order):
        point, begin, end, doc = words_of(body, at)
        first, number = distinct_ranges(point, begin, end)
        here = np.array([known.setdefault(point[a:b].tobytes(), len(known)) for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)], np.int32)
        numbers.append(here[number])
        sizes.append(np.bincount(doc, minlength=len(at) - 1))
    number, words = np.concatenate(numbers), list(known)
    del numbers, known
    while words:  # they go as their n-grams come
        some, words = words[:WORDS_AT_ONCE], words[WORDS_AT_ONCE:]
        end = np.cumsum([len(w) // 4 for w in some])
        word, bucket = grams(np.frombuffer(b"".join(some), "<u4"), np.append(0, end[:-1]), end, s)
        by_word = np.argsort(word, kind="stable")
        of.append(np.bincount(word, minlength=len(some)))
        to.append(bucket[by_word].astype(np.int32))
    return number, np.concatenate(sizes), np.concatenate(of), np.concatenate(to)


def word_means(folded: np.ndarray, to: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The mean of each word's n-grams (``count`` of them from ``place`` on in ``to``; at least one), some words at a time."""
    out = np.empty(len(place))
    for k in range(0, len(place), WORDS_AT_ONCE):
        at, n = place[k : k + WORDS_AT_ONCE], count[k : k + WORDS_AT_ONCE]
        out[k : k + WORDS_AT_ONCE] = np.add.reduceat(folded[to[at[0] : at[-1] + n[-1]]], at - at[0]) / n
    return out


def fit(texts: pa.Array | pa.ChunkedArray, labels: np.ndarray, s: Settings = Settings(), order: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The folded model: a number for each bucket, already times the gain, and the intercept. ``order``: texts and labels are taken in it."""
    rng = np.random.default_rng(s.seed)
    order = np.arange(len(texts)) if order is None else order
    labels = labels[order]
    number, n, count, to = dictionary(texts, order, s)
    place, edge = np.cumsum(count) - count, np.append(0, np.cumsum(n))
    vectors = rng.normal(0, 0.1, (1 << s.buckets_log2, s.dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (s.dim, 2)), np.zeros(2)
    past = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, layer, bias)]
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        if epoch < s.random_epochs or not len(number):
            window = edge[:-1] + (rng.random(len(n)) * (np.maximum(n - s.window, 0) + 1)).astype(np.int64)
        else:
            folded = vectors @ (layer[:, 1] - layer[:, 0])
            window, _ = best_windows(word_means(folded, to, place, count), number, edge, s.window)  # every word has n-grams
        held = np.minimum(n, s.window)
        shuffled = rng.permutation(len(texts))
        for b in range(0, len(texts), s.batch):
            mine = shuffled[b : b + s.batch]
            words = gather(number, window[mine], held[mine]) if len(number) else number
            used_by = np.repeat(np.arange(len(mine)), held[mine])
            index = gather(to, place[words], count[words]) if len(words) else np.empty(0, np.int32)
            text = np.repeat(used_by, count[words])
            share = np.repeat((s.gain / held[mine][used_by] / count[words]).astype(np.float32), count[words])
            average = np.stack([np.bincount(text, vectors[index, k] * share, len(mine)) for k in range(s.dim)], axis=1)
            logit = average @ layer + bias
            wrong = np.exp(logit - logit.max(axis=1, keepdims=True))
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(mine)), labels[mine]] -= 1
            wrong /= len(mine)
            back = wrong @ layer.T
            used, local = np.unique(index, return_inverse=True)
            step = np.stack([np.bincount(local, back[text, k] * share, len(used)) for k in range(s.dim)], axis=1)
            past[0][used] += step**2
            vectors[used] -= rate * step / np.sqrt(past[0][used])
            for value, change, seen in ((layer, average.T @ wrong, past[1]), (bias, wrong.sum(axis=0), past[2])):
                seen += change**2
                value -= s.layer_rate * rate * change / np.sqrt(seen)
    return (s.gain * (vectors @ (layer[:, 1] - layer[:, 0]))).astype(np.float32), float(bias[1] - bias[0])


def scores(body: np.ndarray, at: np.ndarray, table_of: np.ndarray, intercept: float, s: Settings) -> np.ndarray:
    """The chance of label 1 for each text of a block."""
    point, begin, end, doc = words_of(body, at)
    best = np.zeros(len(at) - 1)
    if len(begin):
        first, number = distinct_ranges(point, begin, end)
        of, to = grams(point, begin[first], end[first], s)
        word = np.bincount(of, table_of[to], len(first)) / np.bincount(of, minlength=len(first))
        _, best = best_windows(word, number, np.append(0, np.cumsum(np.bincount(doc, minlength=len(best)))), s.window)
    return 1 / (1 + np.exp(-np.clip(best + intercept, -500, 500)))


def fifth(key: Column) -> Column:
    """Whether a row is held out: CRC-32 of its identifier as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row: the folded model, fitted in one task on the bounded sample."""
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~fifth(F.col(key))).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_label"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(s.rows)  # short rows, which may be broadcast
    rows = slim(docs.filter(F.col(key).isNotNull()), key, text).withColumnsRenamed({key: "_id", text: "_text"}).join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))

    def run(sample: pa.Table) -> pa.Table:
        order = pc.sort_indices(sample, [("_id", "ascending")]).to_numpy().astype(np.int64)  # no sorted copy of the texts
        y = sample["_label"].to_numpy().astype(np.int64)
        if len(set(y.tolist())) < 2:
            share = min(max(float(y.mean()), 1e-12), 1 - 1e-12)
            numbers, intercept = np.zeros(1 << s.buckets_log2, np.float32), float(np.log(share / (1 - share)))
        else:
            numbers, intercept = fit(sample["_text"], y, s, order)
        return pa.table({"numbers": pa.array([numbers.tobytes()], pa.binary()), "intercept": [intercept]})

    return written(rows.groupBy().applyInArrow(run, "numbers binary, intercept double"), "toxicity-model")


def score(docs: DataFrame, model: DataFrame, text: str = "text", name: str = "score", s: Settings = Settings()) -> DataFrame:
    """``docs`` with all its columns and the score of each row's text, which replaces a column of that name. The model is of a fixed size."""
    docs, row = docs.drop(name), model.first()
    numbers, intercept = (row["numbers"], row["intercept"]) if row else (np.zeros(1 << s.buckets_log2, np.float32).tobytes(), -500.0)
    shared = docs.sparkSession.sparkContext.broadcast((numbers, intercept))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, intercept = shared.value
        table_of = np.frombuffer(raw, np.float32)
        for batch in batches:
            body, at = text_bytes(pc.fill_null(batch.column(batch.schema.get_field_index(text)), ""))
            got = [scores(body[at[i] : at[j]], at[i : j + 1] - at[i], table_of, intercept, s) for i, j in blocks(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.empty(0))], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    return score(docs, train(docs, labels, s=s), name="_b_score", s=s).filter(F.col("_b_score") < threshold).drop("_b_score")


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    got = score(docs.select("doc_id", "text"), train(docs, labels, s=s), s=s)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), fifth(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_subword_bag_toxicity(spark, sf_dir) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
