"""A long-only simulator with execution at the next bar, one ordered fold for each strategy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.rolling import forward_fill
from barloom.operators.rules import Condition, reason, signal, with_divergences

ROW = "strategy_id string, date date, equity double, action string, signal_date date, ticker string, price double, shares double, commission double, reason string, warning string"

FIELDS = [x.split()[0] for x in ROW.split(", ")]
#: What a run says about prices it can't use.
SKIPPED = {"Buy": "Skipped buy on {day} for {ticker}: invalid close price.", "Sell": "Skipped sell on {day} for {ticker}: invalid close price."}
CARRIED = "Invalid mark-to-market price on {day} for {ticker}; carrying prior equity."
#: Between several warnings of a day.
BETWEEN = " | "


@dataclass(frozen=True)
class Strategy:
    enter_ticker: str
    exit_ticker: str
    enter: Sequence[Condition]
    exit: Sequence[Condition]


@dataclass(frozen=True)
class Costs:
    deposit: float = 10_000.0
    commission_pct: float = 0.0
    slippage_pct: float = 0.0

    def __post_init__(self):
        if self.deposit <= 0:
            raise ValueError("the deposit must be above 0")
        if self.commission_pct < 0 or self.slippage_pct < 0:
            raise ValueError("costs must not be negative")


@dataclass(frozen=True)
class Terms:
    """What a simulation goes by besides its days. Costs are shares of the money moved."""

    deposit: float
    cost: float
    slip: float
    enter_ticker: str
    exit_ticker: str
    bought: str
    sold: str


def walked(days: Iterable[tuple], terms: Terms) -> Iterator[tuple]:
    """``days`` are (date, enters, leaves, price) in order; for each the fields of ROW after the strategy. A trade is made on the day after its signal; only what the exit names can be left."""
    cash, shares, order, since, last = terms.deposit, 0.0, None, None, terms.deposit
    for day, enters, leaves, price in days:
        good, trade, said = pd.notna(price) and price > 0, (None,) * 7, []
        if order and not good:
            said.append(SKIPPED[order].format(day=day, ticker=terms.enter_ticker if order == "Buy" else terms.exit_ticker))
        elif order == "Buy" and cash > 0:
            fill, invested = price * (1 + terms.slip), cash / (1 + terms.cost)
            shares, fee = invested / fill, invested * terms.cost
            cash -= invested + fee
            trade = (order, since, terms.enter_ticker, fill, shares, fee, terms.bought)
        elif order == "Sell":
            fill = price * (1 - terms.slip)
            fee = shares * fill * terms.cost
            cash += shares * fill - fee
            trade, shares = (order, since, terms.exit_ticker, fill, shares, fee, terms.sold), 0.0
        if shares and not good:
            said.append(CARRIED.format(day=day, ticker=terms.enter_ticker))
        else:
            last = cash + shares * price if shares else cash
        can_leave = leaves and terms.enter_ticker == terms.exit_ticker
        order, since = ("Sell" if can_leave else None) if shares else ("Buy" if enters else None), day
        yield (day, last, *trade, BETWEEN.join(said) or None)


def simulate(panel: DataFrame, strategy: Strategy, costs: Costs = Costs(), start: str | None = None, end: str | None = None, key: str = "strategy_id", ts: str = "date", side: int = 3, lookback: int = 60) -> DataFrame:
    """One row for each bar in [start, end]: equity, the trade made on it if any, and what went wrong.

    The window is cut before signals are made, so what they see depends on it. A signal is acted on
    at the next bar's price; on the last bar there is none. A flat strategy looks at entries only,
    one that holds at exits only, and it can leave only what its exit names.
    """
    needed = {strategy.enter_ticker, strategy.exit_ticker, *(c.variable for c in (*strategy.enter, *strategy.exit))}
    if missing := sorted(needed - set(panel.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if start and end and start > end:
        raise ValueError("the start date lies after the end date")
    window = panel
    if start:
        window = window.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end:
        window = window.filter(F.col(ts) <= F.lit(end).cast("date"))
    for conditions, price in ((strategy.enter, strategy.enter_ticker), (strategy.exit, strategy.exit_ticker)):
        window = with_divergences(window, conditions, price, side, lookback, key, ts)
    columns = [key, ts, signal(strategy.enter, strategy.enter_ticker, ts).alias("_enter"), signal(strategy.exit, strategy.exit_ticker, ts).alias("_exit"), F.col(f"`{strategy.enter_ticker}`").cast("double").alias("_buy"), F.col(f"`{strategy.exit_ticker}`").cast("double").alias("_sell")]
    bought, sold = reason("Enter", strategy.enter), reason("Exit", strategy.exit)
    terms = Terms(costs.deposit, costs.commission_pct / 100, costs.slippage_pct / 100, strategy.enter_ticker, strategy.exit_ticker, bought, sold)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pdf.sort_values(ts)
        return pd.DataFrame([(pdf[key].iloc[0], *row) for row in walked(days[[ts, "_enter", "_exit", "_buy"]].itertuples(index=False), terms)], columns=FIELDS)

    return window.select(*columns).groupBy(key).applyInPandas(fold, ROW)


def checked(panel: DataFrame) -> DataFrame:
    """``panel``, if it has a row; else an error. This looks at one row."""
    if panel.isEmpty():
        raise ValueError("the panel has no rows")
    return panel


def trades(run: DataFrame) -> DataFrame:
    """Typed even if there are none, with the gross value of each."""
    return run.filter("action IS NOT NULL").select("strategy_id", "date", "signal_date", "action", "ticker", "price", "shares", "commission", "reason", (F.col("price") * F.col("shares")).alias("gross_value"))


def equity(run: DataFrame) -> DataFrame:
    return run.select(F.col("strategy_id").alias("series"), "date", "equity")


def warnings(run: DataFrame) -> DataFrame:
    return run.filter("warning IS NOT NULL").select("strategy_id", F.explode(F.split("warning", r" \| ")).alias("warning")).distinct()


def benchmark_curve(prices: DataFrame, deposit: float, key: str = "series", price: str = "price") -> DataFrame:
    """``series, date, equity``: the deposit, moved like each series' price, missing prices filled from before. A first price that isn't valid raises an error when read."""
    w = Window.partitionBy(key).orderBy("date")
    first = F.first(price).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    checked = F.when(first > 0, first).otherwise(F.raise_error(F.lit("a benchmark has no valid first price")).cast("double"))
    return prices.select(F.col(key).alias("series"), "date", (deposit * forward_fill(price, w) / checked).alias("equity"))
