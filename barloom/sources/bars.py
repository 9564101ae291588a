"""Daily bars: ``symbol, ts, open, high, low, close, volume``, one row per symbol and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import finite

FIELDS = ("open", "high", "low", "close", "volume")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from(trades: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column | None = None) -> DataFrame:
    """Bars of single prices; ``order`` says which of a bar's prices came first. Partial aggregation runs before the only shuffle."""
    rows = trades.select(symbol.alias("symbol"), ts.alias("ts"), finite(price).alias("p"), order.alias("o"), (F.lit(1.0) if volume is None else finite(volume)).alias("v"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume")
    )


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of order totals: one symbol for each order priority."""
    o = read_table(spark, sf_dir, "orders")
    return bars_from(o, F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of line prices. Keys repeat, so the price takes part in the order."""
    li = read_table(spark, sf_dir, "lineitem")
    return bars_from(li, F.concat("l_returnflag", F.lit("-"), "l_linestatus"), F.to_date("l_shipdate"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice"), F.col("l_quantity"))


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values."""
    return hourly(read_table(spark, sf_dir, "events"))


def hourly(events: DataFrame) -> DataFrame:
    return bars_from(events, F.col("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")), F.col("value"), F.col("event_id"))


def normalised(raw: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Any frame as bars: names by case-insensitive match, missing fields as NULL columns, rows without a close left out."""
    have = {c.lower(): c for c in raw.columns}
    pick = [(finite(F.col(f"`{have[f]}`")) if f in have else F.lit(None).cast("double")).alias(f) for f in FIELDS]
    return raw.select(F.upper(F.trim(F.col(f"`{have[symbol]}`"))).alias("symbol"), F.to_date(F.col(f"`{have[ts]}`")).alias("ts"), *pick).filter("close IS NOT NULL")


def between(bars: DataFrame, start: str | None = None, end: str | None = None, least: int = 0) -> DataFrame:
    """Inclusive date window; goes down to the scan as a pushed filter. Fewer than ``least`` rows are an error (which takes a look at the rows)."""
    if start and end and start > end:
        raise ValueError("the start date lies after the end date")
    for limit, test in ((start, lambda c, x: c >= x), (end, lambda c, x: c <= x)):
        if limit:
            bars = bars.filter(test(F.col("ts"), F.lit(limit).cast("date")))
    if least and len(bars.limit(least).take(least)) < least:
        raise ValueError(f"the window has fewer than {least} rows")
    return bars
