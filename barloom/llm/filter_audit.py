"""What each of five filters removes, in every order of the filters, by one product of matrices.

A document is reduced to the set of filters that it fails, a mask of five bits. For each part (a
language) the masks are counted three times: all documents, those of label ``quality`` 1, those of
label ``toxic`` 1. Stacked as rows, these histograms of 32 numbers are multiplied by integer matrices
of 32 by 600 (120 orders times 5 steps) that say which masks are kept after a step, removed in it,
redundant there, or fail nothing else. Texts are read once; only short rows are shuffled.

Null text counts as empty, a null language as the part ``''``. A document fails E where its text
equals that of any smaller identifier; a null identifier is smaller than none and has none smaller,
so it never fails E; rows that repeat an identifier and a text don't fail E by each other. Repeated
labels of an identifier count as the largest, null and missing ones as 0. An empty table gives no
rows. A very long text is held by its task with its words, some 60 bytes for each. Other columns of the table aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
WORD = r"[^\x20\x09-\x0D]+"
MARKED = r"[#$%&*|]"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(text: Column) -> Column:
    """The filters A to D that a text fails, by itself, as bits 0 to 3."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(MARKED)]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def histograms(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of each part fail just the filters of a mask, and how many of these have the labels.

    Texts leave their task as digests. A group of equal texts, however large, is counted by
    identifier and then by part and labels before it meets its smallest identifier.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(whole.cast("binary"), 256).alias("_digest"), own_mask(whole).alias("_own"))
    marked = labels.groupBy(F.col(key).alias("_id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"_{c}") for c in ("quality", "toxic")))
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_quality", "_toxic")]
    alike = ["_digest", "part", "_own", "_quality", "_toxic"]
    # partitioned by identifier since the join, so this takes no shuffle
    by_id = read.join(marked, "_id", "left").select("_id", "_digest", "part", "_own", *flags).groupBy("_id", *alike).agg(F.count("*").alias("_n"))
    groups = by_id.groupBy(*alike).agg(F.sum("_n").alias("_n"), F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("_n"))), F.lit(0)).alias("_named"), F.min_by("_n", "_id").alias("_first"), F.min("_id").alias("_least"))
    # a digest has a row for each part and pair of labels at most
    first = F.when(F.col("_least") == F.min("_least").over(Window.partitionBy("_digest")), F.col("_first")).otherwise(0)
    known = groups.withColumn("_copies", F.col("_named") - first)
    split = known.select("part", "_quality", "_toxic", F.explode(F.array(F.struct(F.col("_own").alias("mask"), (F.col("_n") - F.col("_copies")).alias("n")), F.struct((F.col("_own") + 16).alias("mask"), F.col("_copies").alias("n")))).alias("_x")).select("part", "_quality", "_toxic", "_x.*")
    return split.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_quality")).alias("good"), F.sum(F.col("n") * F.col("_toxic")).alias("toxic"))


@lru_cache(maxsize=1)
def matrices() -> dict[str, np.ndarray]:
    """For each outcome the masks (rows) that have it at each order and step (columns)."""
    mask = np.arange(MASKS)[:, None]
    bit = np.array([1 << FILTERS.index(order[step - 1]) for order, step in STEPS])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[: step - 1]) for order, step in STEPS])
    fails, earlier = (mask & bit) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": mask == bit}
    return {k: v.astype(np.int64) for k, v in found.items()}


@lru_cache(maxsize=1)
def same_filter() -> np.ndarray:
    """600 by 600: the steps, of whatever order, that apply the same filter."""
    of = np.array([FILTERS.index(order[step - 1]) for order, step in STEPS])
    return (of[:, None] == of[None, :]).astype(np.int64)


def outcomes(stacked: np.ndarray) -> dict[str, np.ndarray]:
    """``stacked`` has three rows (all, good, toxic) of 32 numbers for each part; the outcomes have a row of 600 for each part."""
    every, good, toxic = stacked.reshape(-1, 3, MASKS).transpose(1, 0, 2)
    of = matrices()
    found = {name: every @ m for name, m in of.items()}
    return found | {"good_lost": good @ of["removed"], "toxic_lost": toxic @ of["removed"], "shapley": found["removed"] @ same_filter()}


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order and step, zeros included."""
    counted = histograms(docs, labels, key, text, part)
    names = ("n", "good", "toxic")
    rows = counted.groupBy("part").agg(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in names for m in range(MASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [o for o, _ in STEPS]
        steps = np.array([s for _, s in STEPS], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                stacked = np.stack([c.to_numpy(zero_copy_only=False) for c in some.columns[1:]], axis=1).astype(np.int64)
                found = outcomes(stacked)
                parts = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(STEPS))))
                yield pa.RecordBatch.from_arrays(
                    [parts, pa.array(orders * some.num_rows), pa.array(np.tile(steps, some.num_rows)), *(pa.array(v.ravel()) for v in found.values())],
                    names=["part", "filter_order", "step", *found],
                )

    return rows.mapInArrow(run, SCHEMA)


def op12_filter_interaction_audit(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same by counting documents for each order and step.
ORACLE_SQL = r"""
WITH read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT read.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS C,
    regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E
  FROM read LEFT JOIN marked USING (doc_id)
), masks AS (
  SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END) || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
outcome AS (
  SELECT part, o, step, o[step] AS f, n, good, toxic, contains(failed, o[step]) AS here, length(translate(failed, o[1:step - 1], '')) < length(failed) AS earlier, failed = o[step] AS only_it
  FROM masks, steps
), counted AS (
  SELECT part, o, step, f,
    sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM outcome GROUP BY ALL
)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
