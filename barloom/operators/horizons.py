"""As-of lookups over calendar horizons: one pass over the bars, no join between them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import pct

#: Horizon and calendar days.
HORIZONS = {"1D": 1, "1W": 7, "1M": 30, "3M": 90, "6M": 182, "12M": 365, "3Y": 1095, "5Y": 1825, "10Y": 3650}
#: Days that count for the 52-week high.
YEAR_AND_TENTH = 401


def with_last_day(bars: DataFrame) -> DataFrame:
    """Each symbol's last day beside each bar."""
    return bars.withColumn("today", F.max("ts").over(Window.partitionBy("symbol")))


def as_of(value: str, days: int) -> Column:
    """An aggregate: the last value that isn't NULL on or before ``today - days``."""
    return F.expr(f"max_by(`{value}`, ts) FILTER (WHERE `{value}` IS NOT NULL AND ts <= date_sub(today, {days}))")


def performance_aggregates(value: str = "close", horizons: Mapping[str, int] = HORIZONS) -> list[Column]:
    return [as_of(value, 0).alias("now"), *(as_of(value, d).alias(f"at_{h}") for h, d in horizons.items())]


def performance_columns(horizons: Mapping[str, int] = HORIZONS) -> list[Column]:
    return [pct(F.col("now"), F.col(f"at_{h}")).alias(f"Perf_{h}_%") for h in horizons]


def performance(bars: DataFrame, horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """``symbol, Perf_<horizon>_%``: change since each horizon; NULL where there is no value or it is 0."""
    return with_last_day(bars).groupBy("symbol").agg(*performance_aggregates("close", horizons)).select("symbol", *performance_columns(horizons))


def high_aggregates(close: str = "close", high: str = "high") -> list[Column]:
    return [F.max(F.when(F.col("ts") >= F.date_sub("today", YEAR_AND_TENTH), F.col(close))).alias("year_high"), F.max(high).alias("all_high")]


def high_columns() -> list[Column]:
    return [pct(F.col("now"), F.col("year_high")).alias("Price_vs_52W_High_%"), pct(F.col("now"), F.col("all_high")).alias("Price_vs_ATH_%")]


def below_highs(bars: DataFrame) -> DataFrame:
    """``symbol, Price_vs_52W_High_%, Price_vs_ATH_%``: the last close against the highest close of a year and against the highest high."""
    return with_last_day(bars).groupBy("symbol").agg(as_of("close", 0).alias("now"), *high_aggregates()).select("symbol", *high_columns())
