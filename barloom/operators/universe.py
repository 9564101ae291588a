"""Universes: list -> group -> subgroup -> tickers, as nested JSON and as rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "map<string, map<string, map<string, array<string>>>>"


def flattened(universe: DataFrame, column: str = "universe") -> DataFrame:
    """``list, group, subgroup, ticker, ord`` of one-row JSON text: names trimmed, tickers trimmed and in upper case, repeats and empty ones left out. ``ord`` is the nesting order."""
    rows = universe.select(F.from_json(F.col(column), SCHEMA).alias("u"))
    for level, name in (("u", "list"), ("groups", "group"), ("subgroups", "subgroup")):
        below = {"list": "groups", "group": "subgroups", "subgroup": "tickers"}[name]
        rows = rows.select("*", F.posexplode(level).alias(f"_{name}", name, below)).drop(level)
    cleaned = F.array_distinct(F.filter(F.transform("tickers", lambda t: F.upper(F.trim(t))), lambda t: t != ""))
    rows = rows.select(F.trim("list").alias("list"), F.trim("group").alias("group"), F.trim("subgroup").alias("subgroup"), "_list", "_group", "_subgroup", F.posexplode(cleaned).alias("_ticker", "ticker"))
    at = F.struct("_list", "_group", "_subgroup", "_ticker")
    return rows.filter("list <> '' AND group <> '' AND subgroup <> ''").groupBy("list", "group", "subgroup", "ticker").agg(F.min(at).alias("ord"))


def nested(rows: DataFrame) -> DataFrame:
    """Rows ``list, group, subgroup, ticker, ord`` as maps: one row for each list."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    subgroups = rows.groupBy("list", "group", "subgroup").agg(F.min("ord").alias("first"), order("ticker").alias("tickers"))
    groups = subgroups.groupBy("list", "group").agg(F.min("first").alias("first"), F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "subgroup", "tickers"))), lambda x: F.struct(x["subgroup"], x["tickers"]))).alias("subgroups"))
    entries = F.collect_list(F.struct("first", "group", "subgroups"))
    ordered = F.array_sort(entries, lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0))
    return groups.groupBy("list").agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["group"], x["subgroups"]))).alias("groups"))


def overlaid(defaults: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows of saved lists, and those of defaults whose list isn't saved."""
    return saved.unionByName(defaults.join(saved.select("list").distinct(), "list", "left_anti"))


def edited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Editor rows ``group, subgroup, ticker, X, row`` as clean rows and row errors: rows marked X and blank rows go, incomplete ones are errors, repeats go."""
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("group", "subgroup")} | {"ticker": F.upper(F.trim(F.coalesce("ticker", F.lit(""))))}
    kept = rows.filter(~F.coalesce("X", F.lit(False))).withColumns(text).filter("group <> '' OR subgroup <> '' OR ticker <> ''")
    whole = F.expr("group <> '' AND subgroup <> '' AND ticker <> ''")
    errors = kept.filter(~whole).select("row", F.format_string("Row %d: group, subgroup and ticker are needed.", F.col("row")).alias("error"))
    return kept.filter(whole).groupBy("group", "subgroup", "ticker").agg(F.min("row").alias("ord")), errors


def from_mapping(spark: SparkSession, universe: Mapping) -> DataFrame:
    return spark.createDataFrame([(json.dumps(universe),)], "universe string")


def save(universe: Mapping[str, Mapping[str, Mapping[str, Iterable[str]]]], path: str) -> None:
    """A universe is configuration, of a few kilobytes: the driver writes it."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(universe, out, indent=2, ensure_ascii=False)
