"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the smallest node that it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours meet at the smallest of these. Edges lead from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b``, any order); the root is the component's smallest node and not listed itself.

    A hot node costs a join that AQE splits; no component is held by a task. Each turn is written
    to the shared folder. Loops and repeated edges don't matter; no edges give no rows.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (seen["n"], seen["h"])
        now = written(_small(_large(now)), "edges")
