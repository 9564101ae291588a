"""Weekly bars of a stream: an extension, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_stream(prices: DataFrame, late: str = "7 days") -> DataFrame:
    """``symbol, label, open, high, low, close, volume`` of a stream ``symbol, ts (timestamp), price, volume``. A week closes on Friday; what comes later than ``late`` is dropped by the watermark."""
    week = F.window("ts", "7 days", "7 days", "2 days")
    bars = prices.withWatermark("ts", late).groupBy("symbol", week.alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("symbol", F.date_sub(F.to_date("w.end"), 1).alias("label"), "open", "high", "low", "close", "volume")
