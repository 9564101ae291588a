"""Near-duplicate documents by HyperMinHash.

A document is its set of ``width``-word shingles. Its sketch has ``REGISTERS`` buckets; a bucket
keeps, of the smallest hash that falls into it, the count of leading zeros and ``MANTISSA`` bits
after them, in 16 bits together; buckets that stay empty borrow a value for banding. ``BANDS`` bands of registers propose candidates: at a Jaccard similarity of
0.75 and with independent registers, 5 pairs in a million share no band. A candidate pair whose estimate from the registers, with
chance collisions taken out, lies ``SLACK`` below the threshold is dropped (by the normal law less than one pair in a
million at the threshold); all others are confirmed on the full sets.

Of small sets a few shared buckets make both chances much larger (sets of 4 and 3 shingles: 3 in
20,000 pairs fall below the cut). So pairs whose smaller set has at most ``FEW`` shingles are not left
to the sketch: all that share a rare shingle are candidates too, and none is dropped by its estimate.
With ``few=None`` that holds for sets of all sizes: no pair at the threshold is lost then, at the cost
of sending all shingles of all documents.

Documents with equal sets are one class and go on as one. Within a band, documents that are linked
already need no further look at each other, so links are sought in turns: first every document
with the one, among the bands' smallest members, with which it shares most bands; then with a
random member of each band; then all pairs between different components that are left: within a
band of up to ``DIRECT`` members directly, and among the members of larger bands and all small sets
where they share one of their rarest shingles, which no pair at the threshold lacks.

Null or empty texts, and such without words, have no shingles and no links; null identifiers can't
name a component: such rows have a null component and stay; rows that repeat an identifier are one
document with several texts; an empty table gives no rows; other columns are not read. A very long text is one block
of its task, which holds its bytes with some 24 bytes for each (hashes of ranges) and 8 bytes for each shingle; its full set travels as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chosen, slim, table, written
from barloom.llm.components import components
from barloom.llm.textblock import blocks, mixed, range_hashes, text_bytes, tidied

WIDTH = 5
PERCENT = 75
REGISTERS_LOG2 = 7
REGISTERS = 1 << REGISTERS_LOG2
BANDS = 32
ROWS = REGISTERS // BANDS
ZEROS, MANTISSA = 6, 10
PROBES = 64
#: Members of a band up to which all its pairs are looked at.
DIRECT = 16
#: Shingles of the smaller set up to which all pairs at the threshold are found, sketch or not.
FEW = 64
#: Five standard deviations of the estimate at 0.75.
SLACK = 0.2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingles(body: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block; a text with fewer words is one shingle."""
    body = _LOWER[body]
    word = ~_WHITE[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    begin = np.flatnonzero(word & (first[:-1] | ~np.append(False, word[:-1])))
    end = np.flatnonzero(word & (first[1:] | ~np.append(word[1:], False))) + 1
    edge = np.searchsorted(begin, at)
    hashes = range_hashes(body, begin, end)
    n = len(hashes)
    with np.errstate(over="ignore"):
        joined = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            joined[: n - k] = joined[: n - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
        joined = mixed(joined)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(joined[a : b - width + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = short * np.uint64(0xC2B2AE3D27D4EB4F) + h
                out.append(mixed(np.array([short])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set of hashes; 0: nothing fell into the bucket."""
    out = np.zeros(REGISTERS, np.uint32)
    bucket = (hashes >> np.uint64(64 - REGISTERS_LOG2)).astype(np.int64)
    least = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(hashes) else []
    rest = hashes[least] << np.uint64(REGISTERS_LOG2)  # of 57 bits, the highest first
    most = (1 << ZEROS) - 1
    zeros = np.zeros(len(rest), np.uint64)
    top = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        none = (top >> np.uint64(64 - step)) == 0
        zeros[none] += np.uint64(step)
        top[none] = top[none] << np.uint64(step)
    zeros = np.minimum(zeros, most - 1)
    bits = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[least]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | bits
    return out


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each register, where to look for a value if it is empty: PROBES places drawn by a hash, then its right neighbours."""
    drawn = mixed(np.arange(1, REGISTERS * PROBES + 1, dtype=np.uint64)).reshape(REGISTERS, PROBES) % np.uint64(REGISTERS)
    return np.concatenate([drawn.astype(np.int64), (np.arange(REGISTERS)[:, None] + np.arange(1, REGISTERS)) % REGISTERS], axis=1)


def filled(values: np.ndarray) -> np.ndarray:
    """Registers without empty ones: an empty one borrows the first value that its probes meet.

    So a register of two sets agrees about as often as they are similar, however small they are,
    and a band takes all its registers to agree. An empty set stays empty.
    """
    none = np.flatnonzero(values == 0)
    if not len(none) or len(none) == REGISTERS:
        return values
    met, out = values[_probes()[none]], values.copy()
    out[none] = met[np.arange(len(none)), (met != 0).argmax(axis=1)]
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """The keys of the bands; none for an empty set."""
    rows = filled(values).reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64) if rows.any() else key[:0].view(np.int64)


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, digest, bands`` of every document: size and digest of its set, keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            got = [(len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), bands(registers(h))) for i, j in blocks(at) for h in shingles(body[at[i] : at[j]], at[i : j + 1] - at[i])]
            size, digest, keys = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])

    return slim(docs, key, text).withColumn(key, F.col(key).cast("long")).mapInArrow(tidied(run), "id long, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n, hashes, registers`` of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            got = [h for i, j in blocks(at) for h in shingles(body[at[i] : at[j]], at[i : j + 1] - at[i])]
            size = pa.array([len(h) for h in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array([h.view(np.int64) for h in got], pa.list_(pa.int64())), pa.array([registers(h).view(np.int32) for h in got], pa.list_(pa.int32()))], names=["id", "n", "hashes", "registers"])

    return slim(docs, key, text).withColumn(key, F.col(key).cast("long")).mapInArrow(tidied(run), "id long, n long, hashes array<long>, registers array<int>")


def collisions(n: Column, m: Column) -> Column:
    """The share of registers that two unrelated sets of ``n`` and ``m`` shingles agree on by chance.

    A bucket's smallest hash has z zeros with a chance that the two sizes set; given equal zeros,
    the mantissas agree once in 2**MANTISSA.
    """

    def both(z: Column) -> Column:
        high = F.pow(F.lit(2.0), -z) / REGISTERS
        each = [F.pow(1 - high / 2, x) - F.pow(1 - high, x) for x in (n, m)]
        return each[0] * each[1]

    zeros = F.sequence(F.lit(0), F.lit((1 << ZEROS) - 2))
    return F.aggregate(zeros, F.lit(0.0), lambda a, z: a + both(z)) / 2.0**MANTISSA


def estimate(one: Column, other: Column, n: Column, m: Column) -> Column:
    """Jaccard similarity from registers: the share of those not empty in both that agree, less what agrees by chance between sets of ``n`` and ``m``."""
    pairs = F.zip_with(one, other, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
    used = F.filter(pairs, lambda x: x.isNotNull())
    same = F.aggregate(used, F.lit(0), lambda a, x: a + x)
    share = same / F.greatest(F.size(used), F.lit(1))
    chance = collisions(n, m)
    return (share - chance) / (F.lit(1.0) - chance)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, few: int | None = FEW) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose full sets are similar enough. Only pairs that sizes and registers leave open fetch their sets."""

    def beside(df: DataFrame, *columns: str) -> DataFrame:
        for end in ("b", "a"):
            df = df.join(sets.select(F.col("id").alias(end), *(F.col(c).alias(c[0] + end) for c in columns)), end)
        return df

    sized = beside(pairs, "n", "registers")
    likely = F.lit(few is None) | (F.least("na", "nb") <= (few or 0)) | (estimate(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb")) >= percent / 100 - SLACK)
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & likely
    left = written(sized.filter(near).select("a", "b", "na", "nb"), "estimated")
    common = F.size(F.array_intersect("ha", "hb"))
    return beside(left, "hashes").filter(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b")


def rare_first(sets: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``id, root, n, token, at, index`` for ``members`` (``id, root``): the rarest shingles of each set, as many as a similar set can't all lack.

    Shingles are ordered by how many members have them. Two sets that are similar enough share one
    within the first ``n - ceil(t n) + 1`` of the larger and (``index``) the first
    ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller, so what is common to very many documents is
    looked at only in sets that hold little else. Shingles of one member only are counted, not sent.
    """
    flat = written(sets.join(members, "id").select("id", "root", "n", F.explode("hashes").alias("token")), "shingles")
    often = flat.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    by_set = flat.join(often, "token").groupBy("id", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"))
    alone = F.col("n") - F.size("s")
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    some = by_set.select("id", "root", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), probe - alone).cast("int"))).alias("k", "x"))
    at = F.col("alone") + F.col("k")
    return some.select("id", "root", "n", F.col("x.token").alias("token"), at.alias("at"), (at < F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1).alias("index"))


def rare_pairs(prefixes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b``: pairs of different components that share a rare shingle and have enough shingles left after it to be similar."""
    x = prefixes.filter("index").select("token", *(F.col(c).alias(f"{c}_x") for c in ("id", "root", "n", "at")))
    y = prefixes.select("token", *(F.col(c).alias(f"{c}_y") for c in ("id", "root", "n", "at")))
    most = 1 + F.least(F.expr("n_x - at_x - 1"), F.expr("n_y - at_y - 1"))
    smaller = F.expr("n_x < n_y OR n_x = n_y AND id_x < id_y") & (F.col("n_x") * 100 >= F.col("n_y") * percent)
    enough = most * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    return x.join(y, "token").filter((F.col("root_x") != F.col("root_y")) & smaller & enough).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, few: int | None = FEW) -> DataFrame:
    """``id, n, component`` of every row of ``docs``. ``few``: see above; None finds every link."""
    every = written(sketched(docs, key, text), "sketches")
    some = every.filter("n > 0 AND id IS NOT NULL")
    classes = written(some.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")
    single = some.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").select("id", F.explode("bands").alias("band"))
    spread = written(single, "bands")
    shared = written(spread.join(spread.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1"), "band").select("band", "id", "least"), "shared-bands")
    # what can be, with another set, a pair whose smaller set has ``few`` shingles at most
    short = classes.filter((F.lit(True) if few is None else F.col("n") * percent <= few * 100) & (F.col("n") * 100 >= (F.col("n") + 1) * percent)).select(F.col("rep").alias("id"))
    needed = written(shared.select("id").unionByName(short).distinct().withColumnRenamed("id", key), "needed")
    sets = written(full_sets(chosen(docs, needed, key), key, text), "shingle-sets")

    # first turn: the smallest member with which a document shares most bands
    first = shared.filter("least <> id").groupBy("id", "least").agg(F.count("*").alias("bands")).groupBy("id").agg(F.max_by("least", F.struct("bands", -F.col("least"))).alias("a"))
    links = written(confirmed(first.select("a", F.col("id").alias("b")), sets, percent, few), "links")
    roots = written(components(links), "roots")

    for turn in ("random", "all"):
        here = shared.select("band", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        mixed_bands = here.groupBy("band").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("other"), F.min_by("root", F.xxhash64("id", F.lit(turn))).alias("other_root")).filter("low <> high")
        left = here.join(mixed_bands, "band")
        if turn == "random":
            pairs = left.filter("root <> other_root").select(F.col("other").alias("a"), F.col("id").alias("b"))
        else:
            left = written(left.select("band", "id", "root", "members"), "mixed-bands")
            small, large = left.filter(F.col("members") <= DIRECT), left.filter(F.col("members") > DIRECT)
            direct = small.select("band", F.col("id").alias("a"), F.col("root").alias("ra")).join(small.select("band", F.col("id").alias("b"), F.col("root").alias("rb")), "band").filter("ra < rb").select("a", "b")
            rooted = short.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
            prefixes = written(rare_first(sets, large.select("id", "root").unionByName(rooted).distinct(), percent), "rare-shingles")
            # a shingle within one component has no pair to offer
            prefixes = prefixes.join(prefixes.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token"), "token", "left_semi")
            pairs = direct.unionByName(rare_pairs(prefixes, percent))
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        links = links.unionByName(written(confirmed(pairs, sets, percent, few), "links"))
        roots = written(components(links), "roots")

    named = classes.drop("n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component"))
    linked = some.select("id", "n", "digest").join(named, "digest").select("id", "n", "component")
    return linked.unionByName(every.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component")))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    gone = written(assign(docs, key, text, percent).filter("id <> component").select(F.col("id").alias(key)).distinct(), "near-gone")
    return chosen(docs, gone, key, "left_anti").select(docs.columns)


def op4_hyperminhash_near_dedup(spark, sf_dir) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.coalesce(F.col("id") == F.col("component"), F.lit(True))).alias("kept")
    )


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n
    FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)
), five AS (
    SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM w
), s AS (
    SELECT DISTINCT doc_id, shingle FROM five WHERE pos <= greatest(n - 4, 1)
), sets AS (
    SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS same FROM s GROUP BY doc_id
), reps AS (
    SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY same
), r AS (
    SELECT rep, n, shingle FROM reps JOIN s ON rep = doc_id
), pairs AS (
    SELECT x.rep AS a, y.rep AS b, count(*) AS shared, any_value(x.n) AS n, any_value(y.n) AS m
    FROM r x JOIN r y ON x.shingle = y.shingle AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (n + m - shared)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT rep AS node, rep AS low FROM reps
    UNION
    SELECT ways.b, reached.low FROM reached JOIN ways ON reached.node = ways.a WHERE reached.low < ways.b
), roots AS (
    SELECT node, min(low) AS root FROM reached GROUP BY node
), named AS (
    SELECT doc_id, sets.n, root FROM sets JOIN reps USING (same) JOIN roots ON rep = node
)
SELECT doc_id, coalesce(named.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN named USING (doc_id)
"""
