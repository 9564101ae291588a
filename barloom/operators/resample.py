"""Weekly and monthly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What happens to the last week if its Friday hasn't come, and to bars with missing prices.
COMPLETE, PARTIAL, STRICT = "complete", "partial", "strict"


def friday(ts: str = "ts"):
    """The Friday on or after a day: the label of its week."""
    return F.next_day(F.date_sub(F.col(ts), 1), "FRI")


def month_end(ts: str = "ts"):
    return F.last_day(F.col(ts))


def _grouped(bars: DataFrame, label) -> DataFrame:
    """First open, highest high, lowest low, last close (each of those that aren't NULL), summed volume."""
    first = F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts")))
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts")))
    return bars.groupBy("symbol", label.alias("label")).agg(
        first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.max("ts").alias("last_ts")
    )


def weekly(bars: DataFrame, rule: str = COMPLETE) -> DataFrame:
    """Weeks that end on Friday. ``complete``: the last week of a symbol goes if its Friday lies after its last day; ``strict``: bars with any missing price go and volume is left out."""
    weeks = _grouped(bars, friday())
    if rule == STRICT:
        return weeks.drop("volume", "last_ts").withColumnRenamed("label", "ts").dropna("any", subset=["open", "high", "low", "close"])
    if rule == COMPLETE:
        weeks = weeks.withColumn("_end", F.max("last_ts").over(Window.partitionBy("symbol"))).filter("label <= _end").drop("_end")
    elif rule != PARTIAL:
        raise ValueError(f"no such rule: {rule}")
    return weeks.filter("close IS NOT NULL").drop("last_ts").withColumnRenamed("label", "ts")


def monthly(bars: DataFrame) -> DataFrame:
    """Months labelled by their last day; the last one may be partial."""
    return _grouped(bars, month_end()).filter("close IS NOT NULL").drop("last_ts").withColumnRenamed("label", "ts")


def last_per_week(values: DataFrame, value: str = "equity", key: str = "series") -> DataFrame:
    """The last value of each series in each week that has one."""
    when = F.when(F.col(value).isNotNull(), F.col("date"))
    return values.groupBy(key, F.next_day(F.date_sub("date", 1), "FRI").alias("week")).agg(F.max_by(value, when).alias(value)).filter(F.col(value).isNotNull())
