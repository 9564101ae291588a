"""Rolling values as window functions, one partition for each symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barloom.functions.columns import pct


def by_symbol(key: str = "symbol", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def over_rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_symbol()).rowsBetween(-(n - 1), 0)


def rolling_mean(c: str, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    """NULL until ``need`` values (all n if not given) are in the frame."""
    frame = over_rows(n, w)
    return F.when(F.count(c).over(frame) >= (need or n), F.avg(c).over(frame))


def rolling_std(c: str, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    """Sample deviation; NULL until ``need`` values are in the frame."""
    frame = over_rows(n, w)
    return F.when(F.count(c).over(frame) >= (need or n), F.stddev_samp(c).over(frame))


def bollinger(bars: DataFrame, n: int = 50, width: float = 2.0) -> DataFrame:
    mid, std = rolling_mean("close", n), rolling_std("close", n)
    return bars.withColumns({"bb_mid": mid, "_std": std}).withColumns({"bb_upper": F.col("bb_mid") + width * F.col("_std"), "bb_lower": F.col("bb_mid") - width * F.col("_std")}).drop("_std")


def roc(c: str, n: int = 12, w: WindowSpec | None = None) -> Column:
    return pct(F.col(c), F.lag(c, n).over(w or by_symbol()))


def true_range(w: WindowSpec | None = None) -> Column:
    """The largest of three ranges; missing ones are skipped, so the first bar has high less low."""
    before = F.lag("close").over(w or by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def directional_moves(w: WindowSpec | None = None) -> tuple[Column, Column]:
    """Up and down moves that outdo the other one; else 0."""
    up = F.col("high") - F.lag("high").over(w or by_symbol())
    down = F.lag("low").over(w or by_symbol()) - F.col("low")
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def running_drawdown(value: str, w: WindowSpec) -> Column:
    return F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def forward_fill(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def candle_up(w: WindowSpec | None = None) -> Column:
    """Whether a close is no lower than the one before; the first one counts as up."""
    before = F.lag("close").over(w or by_symbol())
    return before.isNull() | (F.col("close") >= before)


def price_vs_averages(bars: DataFrame) -> DataFrame:
    """SMA50 and SMA200, and how far high, low and close are from them in percent."""
    with_sma = bars.withColumns({"sma50": rolling_mean("close", 50), "sma200": rolling_mean("close", 200)})
    return with_sma.withColumns(
        {f"{p}_vs_ma{n}": pct(F.col(p), F.col(f"sma{n}")) for p in ("high", "low") for n in (50, 200)} | {"close_vs_ma200": pct(F.col("close"), F.col("sma200"))}
    )


def nth_last(c: str, w: WindowSpec, whole: WindowSpec) -> Column:
    """1 for the last value that isn't NULL, 2 for the one before, and so on; NULL where there is none. Two running counts, no other sorting."""
    return F.when(F.col(c).isNotNull(), F.count(c).over(whole) - F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def spread_statistics(bars: DataFrame) -> DataFrame:
    """Of the close against SMA200, for each symbol: now, the mean of the last 756 values, its change in six months, and the trend."""
    from barloom.operators.horizons import with_last_day

    spread = with_last_day(bars.select("symbol", "ts", "close").withColumn("spread", pct(F.col("close"), rolling_mean("close", 200))))
    found = spread.withColumn("nth", nth_last("spread", by_symbol(), Window.partitionBy("symbol"))).groupBy("symbol").agg(*spread_aggregates("spread", "nth"))
    return found.select("symbol", *spread_columns())


def spread_aggregates(spread: str, nth: str) -> list[Column]:
    from barloom.operators.horizons import as_of

    return [as_of(spread, 0).alias("spread_now"), F.avg(F.when(F.col(nth) <= 756, F.col(spread))).alias("spread_mean"), as_of(spread, 182).alias("spread_ago")]


def spread_columns() -> list[Column]:
    now, ago = F.col("spread_now"), F.col("spread_ago")
    return [
        now.alias("SMA50w_vs_SMA200w_Spread_%"),
        F.col("spread_mean").alias("SMA50w_vs_SMA200w_Spread_Avg_36M_%"),
        pct(now, ago).alias("SMA_Spread_%_Change_6M_%"),
        F.when(now.isNotNull() & ago.isNotNull(), F.when(now - ago > 0, "bull").otherwise("bear")).alias("SMA_Trend"),
    ]


def recent_crossover(bars: DataFrame, least: int, lookback: int = 14, fast: int = 50, slow: int = 200) -> DataFrame:
    """``symbol, golden, death``: whether the fast average crossed the slow one in the last ``lookback`` bars that have both. Symbols with fewer than ``least`` bars have neither."""
    crossed = with_crossings(bars, "x", least, by_symbol(), Window.partitionBy("symbol"), lookback, fast, slow)
    return crossed.groupBy("symbol").agg(F.max("x_golden").alias("golden"), F.max("x_death").alias("death"))


def with_crossings(bars: DataFrame, name: str, least: int, w: WindowSpec, whole: WindowSpec, lookback: int = 14, fast: int = 50, slow: int = 200, close: str = "close") -> DataFrame:
    """``bars`` with ``<name>_golden`` and ``<name>_death``: 1 on a recent bar where the averages crossed, else 0."""
    f, s = F.col(f"_{name}_f"), F.col(f"_{name}_s")
    out = bars.withColumns({f"_{name}_f": rolling_mean(close, fast, w=w), f"_{name}_s": rolling_mean(close, slow, w=w), f"_{name}_bars": F.count(close).over(whole)})
    out = out.withColumn(f"_{name}_above", F.when(f.isNotNull() & s.isNotNull(), f > s))
    before = F.coalesce(F.last(f"_{name}_above", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    out = out.withColumns({f"_{name}_was": before, f"_{name}_nth": nth_last(f"_{name}_above", w, whole)})
    recent = (F.col(f"_{name}_nth") <= lookback) & (F.col(f"_{name}_bars") >= least)
    above, was = F.col(f"_{name}_above"), F.col(f"_{name}_was")
    flag = lambda x: F.coalesce((recent & x).cast("int"), F.lit(0))
    return out.select(*bars.columns, flag(above & ~was).alias(f"{name}_golden"), flag(~above & was).alias(f"{name}_death"))


def band_position(weekly: DataFrame, n: int = 50, width: float = 2.0) -> DataFrame:
    """Where each symbol's last weekly close lies in its bands, from -10 to 10, with the bands and the steps between."""
    stats = weekly.withColumns({"m": rolling_mean("close", n), "s": rolling_std("close", n)})
    last = stats.groupBy("symbol").agg(F.max_by(F.struct("close", "m", "s"), "ts").alias("w"))
    return last.filter("w.m IS NOT NULL AND w.s IS NOT NULL").select("symbol", *band_columns(F.col("w.close"), F.col("w.m"), F.col("w.s"), width))


def band_columns(c: Column, m: Column, s: Column, width: float = 2.0) -> list[Column]:
    """Position, bands and steps of a close ``c`` with mean ``m`` and deviation ``s``; all NULL if one of these is."""
    known = m.isNotNull() & s.isNotNull()
    flat = s <= 0
    upper, lower = m + width * s, m - width * s
    up, down = (upper - m) / 10, (m - lower) / 10
    steps = lambda far, step: F.greatest(F.lit(1), F.least(F.lit(9), F.ceil(F.try_divide(far, step)).cast("int")))
    position = F.when(flat | (up <= 1e-12) | (down <= 1e-12), 0).when(c >= upper, 10).when(c <= lower, -10).when(c > m, steps(c - m, up)).when(c < m, -steps(m - c, down)).otherwise(0)
    kept = lambda x: F.when(known & ~flat, x)
    return [
        F.when(known, position).cast("int").alias("BB_Position"), F.when(known, m).alias("BB_Mid"), kept(upper).alias("BB_Upper"), kept(lower).alias("BB_Lower"),
        kept(up).alias("BB_StepUp"), kept(down).alias("BB_StepDown"), F.when(known, c).alias("WeeklyClose_Last"),
    ]
