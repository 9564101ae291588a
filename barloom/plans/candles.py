"""Datasets behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import pct
from barloom.operators.recursive import with_recursive
from barloom.operators.resample import PARTIAL, monthly, weekly
from barloom.operators.rolling import bollinger, candle_up, roc, rolling_mean

VISIBLE, LEAST = 150, 20


def candles(bars: DataFrame, frame: str = "daily", visible: int = VISIBLE) -> DataFrame:
    """Candles with averages and bands over the whole history, of which the last ``visible`` (0: all) are kept; RSI, MACD and ROC are made on those. Symbols with fewer than LEAST candles have none."""
    framed = {"daily": lambda b: b, "weekly": lambda b: weekly(b, PARTIAL), "monthly": monthly}[frame](bars.filter("close IS NOT NULL"))
    series = bollinger(framed.withColumns({"sma50": rolling_mean("close", 50), "sma200": rolling_mean("close", 200)})).withColumn("up", candle_up())
    by = Window.partitionBy("symbol")
    shown = series.withColumns({"_nth": F.row_number().over(by.orderBy(F.desc("ts"))), "_n": F.count("*").over(by)})
    shown = shown.filter((F.col("_n") >= LEAST) & ((F.col("_nth") <= visible) | F.lit(visible == 0))).drop("_nth", "_n")
    return with_recursive(shown).withColumn("roc12", roc("close"))


def oscillators(shown: DataFrame) -> DataFrame:
    """What stands below candles: RSI, MACD with its sign class, ROC, and how far the close is from SMA200."""
    sign = F.when(F.col("macd_screen") >= 0, "pos").otherwise("neg")
    above = F.when(F.col("sma200") > 0, pct(F.col("close"), F.col("sma200")))
    return shown.select("symbol", "ts", F.col("rsi_screen").alias("rsi"), F.col("macd_screen").alias("macd_hist"), "roc12", above.alias("ppo200"), sign.alias("macd_sign"))


def value_range(df: DataFrame, columns: list[str], padding: float = 0.05) -> DataFrame:
    """``symbol, low, high`` over several columns, padded."""
    least, most = F.min(F.least(*columns)), F.max(F.greatest(*columns))
    return df.groupBy("symbol").agg((least - padding * (most - least)).alias("low"), (most + padding * (most - least)).alias("high"))


def color_scale(metrics: DataFrame, column: str, without: str | None = None) -> DataFrame:
    """Each row's place between the least and the greatest value, from 0 to 1; ``without`` names a ticker that isn't counted."""
    counted = F.when(F.col("Ticker") != without, F.col(f"`{column}`")) if without else F.col(f"`{column}`")
    ends = metrics.agg(F.min(counted).alias("_low"), F.max(counted).alias("_high"))
    placed = F.try_divide(F.col(f"`{column}`") - F.col("_low"), F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    return metrics.join(F.broadcast(ends)).withColumn("place", placed).drop("_low", "_high")  # one row
