"""The metrics table: one row for each universe entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import pct
from barloom.operators.horizons import high_aggregates, high_columns, performance_aggregates, performance_columns
from barloom.operators.pivots import DivergenceSettings, best_divergence, with_divergences
from barloom.operators.recursive import with_recursive
from barloom.operators.resample import friday
from barloom.operators.rolling import band_columns, by_symbol, nth_last, roc, rolling_mean, rolling_std, spread_aggregates, spread_columns, with_crossings
from barloom.operators.screen import FLOWS

LEAST_BARS, DAILY_BARS, WEEKLY_BARS = 60, 250, 260
DIVERGENCES = (("RSI", "rsi_screen", "RSI"), ("MACD", "macd_screen", "MACD_HIST"), ("ROC", "roc12", "ROC"))


def clean(bars: DataFrame) -> DataFrame:
    """Bars with close, low and high, of symbols with enough of them."""
    whole = bars.dropna("any", subset=["close", "low", "high"])
    return whole.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).filter(F.col("_n") >= LEAST_BARS).drop("_n")


def last_value(c: str):
    good = F.col(c).isNotNull()
    return F.max_by(F.when(good, F.col(c)), F.when(good, F.col("ts")))


def latest_aggregates(nth_plus: str, nth_minus: str) -> list[Column]:
    change = lambda c, n: F.max(F.when(F.col(n) == 1, F.col(c))) - F.max(F.when(F.col(n) == 3, F.col(c)))
    return [
        last_value("rsi_screen").alias("RSI_14"), last_value("adx").alias("ADX_14"), last_value("di_plus").alias("DI_Plus_14"), last_value("di_minus").alias("DI_Minus_14"),
        change("di_plus", nth_plus).alias("DI_Plus_14_Delta2"), change("di_minus", nth_minus).alias("DI_Minus_14_Delta2"),
    ]


def latest_indicators(ind: DataFrame) -> DataFrame:
    """RSI, ADX and DI now, and the change of DI over two bars that have it."""
    nth = lambda c: nth_last(c, by_symbol(), Window.partitionBy("symbol"))
    return ind.withColumns({"_np": nth("di_plus"), "_nm": nth("di_minus")}).groupBy("symbol").agg(*latest_aggregates("_np", "_nm"))


def symbol_metrics(bars: DataFrame, settings: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """All metrics of each symbol with enough bars.

    One frame and one aggregate: recursions are made in one grouped pass, and all windows have the
    symbol in front, so after it the bars are shuffled once. ``ok`` marks bars with close, low and
    high, which daily values are made of; ``week`` marks the last bar of each complete week, whose
    closes are the weekly series.
    """
    ok = F.col("close").isNotNull() & F.col("low").isNotNull() & F.col("high").isNotNull()
    whole = Window.partitionBy("symbol")
    rows = bars.select("symbol", "ts", "close", "high", "low", ok.alias("ok")).withColumn("_n", F.count(F.when(F.col("ok"), 1)).over(whole)).filter(F.col("_n") >= LEAST_BARS).drop("_n")
    rows = with_recursive(rows, ("rsi_screen", "macd_screen", "adx", "di_plus", "di_minus"), "ok")

    # weeks, over all bars
    priced = Window.partitionBy("symbol", F.col("close").isNotNull()).orderBy("ts")
    last = F.coalesce(F.lead("_label").over(priced) != F.col("_label"), F.lit(True))
    rows = rows.withColumn("_label", friday()).withColumn("week", F.col("close").isNotNull() & last & (F.col("_label") <= F.max("ts").over(whole)))
    weekly, weeks = Window.partitionBy("symbol", "week").orderBy("ts"), Window.partitionBy("symbol", "week")
    in_week = F.when(F.col("week"), F.col("close"))
    rows = rows.withColumns({"_weekly": in_week}).withColumns({"_m": rolling_mean("_weekly", 50, w=weekly), "_s": rolling_std("_weekly", 50, w=weekly)})
    rows = with_crossings(rows, "w1", WEEKLY_BARS, weekly, weeks, close="_weekly")

    # days, over whole bars
    daily, days = Window.partitionBy("symbol", "ok").orderBy("ts"), Window.partitionBy("symbol", "ok")
    rows = rows.withColumns({f"_{c}": F.when(F.col("ok"), F.col(c)) for c in ("close", "high", "low")})
    rows = rows.withColumns({"today": F.max(F.when(F.col("ok"), F.col("ts"))).over(whole), "roc12": roc("_close", w=daily), "_spread": pct(F.col("_close"), rolling_mean("_close", 200, w=daily))})
    rows = with_crossings(rows, "d1", DAILY_BARS, daily, days, close="_close")
    rows = with_divergences(rows, [(label, c, name) for label, c, name in DIVERGENCES], settings, "_low", "_high", daily, days)
    rows = rows.withColumns({n: nth_last(c, daily, days) for n, c in (("_ns", "_spread"), ("_np", "di_plus"), ("_nm", "di_minus"))})

    found = rows.groupBy("symbol").agg(
        *performance_aggregates("_close"), *high_aggregates("_close", "_high"), *latest_aggregates("_np", "_nm"), *spread_aggregates("_spread", "_ns"),
        F.max_by(F.when(F.col("week"), F.struct("_weekly", "_m", "_s")), F.when(F.col("week"), F.col("ts"))).alias("w"),
        *(F.max(f"{a}_{b}").alias(f"{b.title()}Cross_{a.upper()}") for a in ("d1", "w1") for b in ("golden", "death")),
        *(best_divergence(label).alias(f"_{label}") for label, _, _ in DIVERGENCES),
    )
    return found.select(
        "symbol", *performance_columns(), *high_columns(), "RSI_14", "ADX_14", "DI_Plus_14", "DI_Minus_14", "DI_Plus_14_Delta2", "DI_Minus_14_Delta2", *spread_columns(),
        *band_columns(F.col("w._weekly"), F.col("w._m"), F.col("w._s")), *(f"{b}Cross_{a}" for a in ("D1", "W1") for b in ("Golden", "Death")),
        *(F.coalesce(f"_{label}.direction", F.lit("nothing")).alias(f"Div_6M_vs_{label}") for label, _, _ in DIVERGENCES), *(F.lit(None).cast("double").alias(c) for c in FLOWS),
    )


def metrics_table(universe: DataFrame, bars: DataFrame, settings: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """Each universe entry (``list, group, subgroup, ticker, ord``) with its symbol's metrics; symbols without enough bars have none, and no divergences."""
    return listed(universe, symbol_metrics(bars, settings))


def listed(universe: DataFrame, found: DataFrame) -> DataFrame:
    """Universe entries with the metrics of their symbols."""
    rows = universe.join(found, F.col("ticker") == F.col("symbol"), "left").drop("symbol")
    count = lambda way: sum((F.coalesce(F.col(f"Div_6M_vs_{label}") == way, F.lit(False)).cast("int") for label, _, _ in DIVERGENCES), F.lit(0))
    counted = rows.withColumns({"Divergence_Bull_Count": count("bull"), "Divergence_Bear_Count": count("bear")})
    return counted.withColumnsRenamed({"list": "List", "group": "Group", "subgroup": "Subgroup", "ticker": "Ticker"})
