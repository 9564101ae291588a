"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every record key draws one uniform number for each shard; the shard with the largest
``-weight / ln(u)`` takes the record. A shard's draw doesn't depend on the other shards, so a new
shard takes its own records from the others and moves nothing between those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc32_sql, numbered, table

SHARDS = 16
BITS = 52


def uniform(key: Column, shard: int) -> Column:
    """In (0, 1), from the first 52 bits of MD5 over ``shard:key``."""
    digest = F.md5(F.concat(F.lit(f"{shard}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**BITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``. Equal draws (which 52 bits all but exclude) go to the smaller shard. A null key counts as an empty one."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    drawn = [F.struct((F.lit(-float(w)) / F.log(uniform(key, s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    best = F.greatest(*drawn) if len(drawn) > 1 else drawn[0]
    return (-best["shard"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", text: str = "text", new_weight: float = 1.0) -> DataFrame:
    """Shard, slot and the shard after one more has been added, for each row of ``docs``.

    Null text counts as no bytes, so the size is 1; a null key is one key like any other; repeated
    rows each get a slot; an empty table gives no rows; other columns are not read. A very long text is
    one row where it is read; only its length and checksum go on.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, new_weight]).alias("grown_shard"),
    )
    return numbered(placed, "shard", [key, "size", "text_crc32"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_rendezvous_sharding(spark, sf_dir) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH drawn AS (
    SELECT doc_id, shard, -1.0 / ln((('0x' || substr(md5(shard || ':' || doc_id), 1, {BITS // 4}))::BIGINT + 0.5::DOUBLE) / {2**BITS}::DOUBLE) AS score
    FROM documents, range({SHARDS + 1}) AS shards(shard)
), placed AS (
    SELECT doc_id, arg_max(shard, score) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, score) AS grown_shard FROM drawn GROUP BY doc_id
)
SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("hex(encode(coalesce(text, '')))")} AS text_crc32, 'key' AS law,
    placed.shard::INTEGER AS shard, row_number() OVER (PARTITION BY placed.shard ORDER BY doc_id) - 1 AS slot, placed.grown_shard::INTEGER AS grown_shard
FROM documents JOIN placed USING (doc_id)
"""
