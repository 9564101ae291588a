"""The tester's pipelines: a live dataset with indicators, its ready part, and a whole backtest run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import pct
from barloom.operators import backtest, performance
from barloom.operators.recursive import with_recursive
from barloom.operators.resample import STRICT, weekly
from barloom.operators.rolling import roc, rolling_mean
from barloom.operators.rules import DIVERGENCES, INDICATORS
from barloom.sources.folders import fresh

FETCHED_YEARS, SHOWN_YEARS = 15, 5


TIMEFRAMES = ("daily", "weekly")
SIDES = ("Underlying", "Traded")
PRICES = ("open", "high", "low", "close")


def side_by_side(bars: DataFrame, underlying: str, traded: str, benchmarks: Sequence[str] = (), timeframe: str = "daily") -> DataFrame:
    """``date``, prices of both instruments under their prefixes and each benchmark's close, on days that both instruments have: one scan and one aggregate by day, however many symbols."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"no such timeframe: {timeframe}")
    own = bars.filter(F.col("symbol").isin(list(dict.fromkeys([underlying, traded, *benchmarks]))))
    framed = weekly(own, STRICT) if timeframe == "weekly" else own
    of = lambda symbol, c: F.max(F.when(F.col("symbol") == symbol, F.col(c)))
    pair = list(zip(SIDES, (underlying, traded), strict=True))
    prices = [of(symbol, c).alias(f"{side}_{c.title()}") for side, symbol in pair for c in PRICES]
    both = [F.count(F.when(F.col("symbol") == symbol, 1)).alias(f"_{side}") for side, symbol in pair]
    days = framed.groupBy(F.col("ts").alias("date")).agg(*prices, *(of(b, "close").alias(f"BMK_{b}_Close") for b in benchmarks), *both)
    return days.filter(" AND ".join(f"_{side} > 0" for side in SIDES)).drop(*(f"_{side}" for side in SIDES))


def live_dataset(bars: DataFrame, underlying: str, traded: str, benchmarks: Sequence[str] = (), timeframe: str = "daily") -> tuple[DataFrame, list[str]]:
    """The dataset and warnings. Days that both instruments have, their prices, and indicators of the underlying made on those days; benchmarks where they have a day.

    The dataset, a row for each day of one pair, is written once to the shared folder by a single scan of the bars: which columns it has
    depends on the data. A pair without common days is an error; benchmarks without any are left out with a warning.
    """
    pair = side_by_side(bars, underlying, traded, benchmarks, timeframe)
    close = pair.select("*", F.lit(f"{underlying}/{traded}").alias("symbol"), F.col("date").alias("ts"), *(F.col(f"Underlying_{c.title()}").alias(c) for c in ("high", "low", "close")))
    made = with_recursive(close, ("rsi_tester", "macd_tester")).withColumns({"SMA50": rolling_mean("close", 50), "SMA200": rolling_mean("close", 200), "ROC": roc("close")})
    against = [pct(F.col(c.lower()), F.col(f"SMA{n}")).alias(f"{c} vs MA{n}") for c in ("High", "Low") for n in (50, 200)]
    whole = made.select(*(f"`{c}`" for c in pair.columns), "SMA50", "SMA200", *against, F.col("rsi_tester").alias("RSI"), F.col("macd_tester").alias("MACD"), "ROC")
    path = fresh(bars.sparkSession, "live")
    whole.write.parquet(path)
    kept = bars.sparkSession.read.schema(whole.schema).parquet(path)
    have = kept.agg(F.count("*").alias("days"), *(F.count(f"`BMK_{b}_Close`").alias(b) for b in benchmarks)).first()
    if not have["days"]:
        raise ValueError(f"{underlying} and {traded} have no day in common")
    empty = [b for b in benchmarks if not have[b]]
    return kept.drop(*(f"BMK_{b}_Close" for b in empty)), [f"Benchmark without data left out: {b}" for b in empty]


def ready_part(dataset: DataFrame, columns: Sequence[str] = ("SMA200", "Traded_Close"), date: str = "date") -> DataFrame:
    """The dataset from its first row on that has all ``columns``. If there is none, an error is raised when read."""
    ready = F.lit(True)
    for c in columns:
        ready = ready & F.col(f"`{c}`").isNotNull()
    first = dataset.agg(F.min(F.when(ready, F.col(date))).alias("_first"))  # one row
    start = F.coalesce("_first", F.raise_error(F.lit("too little history for the chosen indicators")).cast("date"))
    return dataset.join(F.broadcast(first)).filter(F.col(date) >= start).drop("_first")


def auto_start(bars: DataFrame, underlying: str, traded: str, end: str, timeframe: str = "daily") -> DataFrame:
    """One row, ``start``: the first day on which the underlying's SMA200 and a traded price are there, of the last FETCHED_YEARS; else SHOWN_YEARS before ``end``."""
    last = F.lit(end).cast("date")
    fetched = bars.filter((F.col("ts") >= F.add_months(last, -12 * FETCHED_YEARS)) & (F.col("ts") <= last))
    pair = side_by_side(fetched, underlying, traded, (), timeframe).withColumn("_series", F.lit(1))
    with_sma = pair.withColumn("_sma", rolling_mean("Underlying_Close", 200, w=Window.partitionBy("_series").orderBy("date")))
    ready = F.col("_sma").isNotNull() & F.col("Traded_Close").isNotNull()
    return with_sma.agg(F.coalesce(F.min(F.when(ready, F.col("date"))), F.add_months(last, -12 * SHOWN_YEARS)).alias("start"))


def checked_rules(strategy: backtest.Strategy) -> None:
    """An error for a side without rules, a rule whose dates are the wrong way round, and a divergence of a price."""
    for name, rules in (("enter", strategy.enter), ("exit", strategy.exit)):
        if not rules:
            raise ValueError(f"the {name} side has no rule in use")
        for c in rules:
            if c.start and c.end and c.start > c.end:
                raise ValueError(f"{name} rule {c.row_id} starts after its end")
            if c.condition in DIVERGENCES and c.variable not in INDICATORS:
                raise ValueError(f"{name} rule {c.row_id}: only an indicator can diverge, not {c.variable}")


def moved_start(dataset: DataFrame, strategy: backtest.Strategy, start: str | None = None) -> DataFrame:
    """One row, ``warning``: that the run starts later than ``start`` (or the first day) as its indicators have no earlier values; NULL if it doesn't."""
    asked = dataset.filter(F.col("date") >= F.lit(start).cast("date")) if start else dataset
    ready = F.lit(True)
    for c in {c.variable for c in (*strategy.enter, *strategy.exit)} & set(INDICATORS):
        ready = ready & F.col(f"`{c}`").isNotNull()
    first = F.min(F.when(ready, F.col("date")))
    return asked.agg(F.when(first > F.min("date"), F.concat(F.lit("The run starts on "), first.cast("string"), F.lit(", when its indicators have values."))).alias("warning"))


@dataclass(frozen=True)
class Run:
    """All that a backtest run gives. Curves have the strategy's and the benchmarks' series."""

    bars: DataFrame
    trades: DataFrame
    warnings: DataFrame
    curves: DataFrame
    headline: DataFrame
    yearly: DataFrame


def backtest_run(dataset: DataFrame, strategy: backtest.Strategy, costs: backtest.Costs, benchmarks: Sequence[str] = (), start: str | None = None, end: str | None = None, risk_free_pct: float = 0.0, per_year: int = 252) -> Run:
    """One strategy on a live dataset: start after the warm-up of the indicators that its rules use, simulate, and compare with ``benchmarks`` (columns) on the same days."""
    checked_rules(strategy)
    used = sorted({c.variable for c in (*strategy.enter, *strategy.exit)} & set(INDICATORS))
    limits = [test(F.col("date"), F.lit(x).cast("date")) for x, test in ((start, lambda a, b: a >= b), (end, lambda a, b: a <= b)) if x]
    window = ready_part(dataset, used) if used else dataset
    for limit in limits:
        window = window.filter(limit)
    panel = window.withColumn("strategy_id", F.lit("Strategy"))
    run = backtest.simulate(panel, strategy, costs)
    curves = backtest.equity(run)
    if benchmarks:
        prices = window.select("date", F.explode(F.array(*(F.struct(F.lit(b).alias("series"), F.col(f"`{b}`").cast("double").alias("price")) for b in benchmarks))).alias("x")).select("x.series", "date", "x.price")
        curves = curves.unionByName(backtest.benchmark_curve(prices, costs.deposit))
    return Run(run, backtest.trades(run), backtest.warnings(run), curves, performance.headline(curves, risk_free_pct, per_year), performance.yearly(curves.filter("series = 'Strategy'")))
