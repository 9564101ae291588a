"""Performance of equity curves ``series, date, equity``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.rolling import forward_fill, running_drawdown

YEAR = 365.25


def growth(last: Column, first: Column, days: Column) -> Column:
    """Compound growth a year in percent; NULL without time or with ends that aren't positive."""
    return F.when((days > 0) & (first > 0) & (last > 0), (F.pow(last / first, YEAR / days) - 1) * 100)


def drawdown(curves: DataFrame) -> DataFrame:
    return curves.withColumn("drawdown", running_drawdown("equity", Window.partitionBy("series").orderBy("date")))


def headline(curves: DataFrame, risk_free_pct: float = 0.0, per_year: int = 252) -> DataFrame:
    """``series, cagr_pct, max_drawdown_pct, avg_drawdown_pct, sharpe``. Sharpe needs three points and returns that differ."""
    w = Window.partitionBy("series").orderBy("date")
    filled = drawdown(curves).withColumn("v", forward_fill("equity", w))
    change = F.try_divide(F.col("v"), F.lag("v").over(w)) - 1 - ((1 + risk_free_pct / 100) ** (1 / per_year) - 1)
    found = filled.withColumn("r", change).groupBy("series").agg(
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.min("drawdown").alias("worst"), F.avg("drawdown").alias("mean"), F.avg("r").alias("r"), F.stddev_pop("r").alias("std"), F.count("*").alias("n"),
    )
    return found.select(
        "series", growth(F.col("last"), F.col("first"), F.col("days")).alias("cagr_pct"), (F.col("worst") * 100).alias("max_drawdown_pct"), (F.col("mean") * 100).alias("avg_drawdown_pct"),
        F.when((F.col("n") >= 3) & (F.col("std") > 0), F.lit(float(per_year)) ** 0.5 * F.col("r") / F.col("std")).alias("sharpe"),
    )


def yearly(curves: DataFrame) -> DataFrame:
    """``series, year, performance_pct, max_drawdown_pct, cumulative_cagr_pct``: within each year, and since the series began."""
    whole = Window.partitionBy("series")
    rows = curves.withColumns({"year": F.year("date"), "start": F.min("date").over(whole), "begin": F.min_by("equity", "date").over(whole)})
    rows = rows.withColumn("drawdown", running_drawdown("equity", Window.partitionBy("series", "year").orderBy("date")))
    found = rows.groupBy("series", "year").agg(F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.min("drawdown").alias("worst"), F.max("date").alias("end"), F.first("start").alias("start"), F.first("begin").alias("begin"))
    return found.select("series", "year", ((F.col("last") / F.col("first") - 1) * 100).alias("performance_pct"), (F.col("worst") * 100).alias("max_drawdown_pct"), growth(F.col("last"), F.col("begin"), F.datediff("end", "start")).alias("cumulative_cagr_pct"))
