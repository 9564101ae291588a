"""All saved strategies in one run: rules are data, so one plan serves any number of strategies.

A strategy's document is parsed to settings and arrays of rules (``store.configured``); its instrument's bars join
it, are cut to its dates, and each bar is held against the rules by higher-order functions: a side signals where as many of its rules hold as it has.
Then one ordered fold for each strategy. Bars are shuffled once, by strategy; a task holds one strategy's bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import any_of
from barloom.operators.backtest import FIELDS, ROW, Terms, walked
from barloom.operators.pivots import with_boolean_divergence
from barloom.operators.rules import DIVERGENCES, REASON
from barloom.sources.store import SIDES

KEY = "strategy_id"
#: Number and order of what can be wrong with a strategy.
PROBLEMS = ("no active enter rule", "no active exit rule", "a rule's start lies after its end", "a divergence of something that isn't an indicator", "the start lies after the end", "the deposit isn't above 0", "a cost is negative", "divergence settings that the run doesn't have", "no bars of its instrument in its dates")
#: Pivot window and lookback of a run's divergences.
WINDOWS = ((3, 60),)


def problems(configured: DataFrame, indicators: Sequence[str], bars: DataFrame | None = None, key: str = "symbol", ts: str = "date", windows: Sequence[tuple[int, int]] = WINDOWS) -> DataFrame:
    """``configured`` with ``problem``: the first of PROBLEMS that a strategy has, else NULL. ``configured`` has ``strategy_id, instrument`` beside the columns of ``store.configured``."""
    rules = F.concat(*SIDES)
    own = [(F.col("divergence_pivot_window") == side) & (F.col("divergence_lookback") == lookback) for side, lookback in windows]
    tests = [
        F.size("enter") == 0, F.size("exit") == 0, F.exists(rules, lambda r: r["start"] > r["end"]), F.exists(rules, lambda r: r["condition"].isin(*DIVERGENCES) & ~r["variable"].isin(list(indicators))),
        F.col("start") > F.col("end"), F.col("initial_deposit") <= 0, (F.col("commission_pct") < 0) | (F.col("slippage_pct") < 0),
        F.exists(rules, lambda r: r["condition"].isin(*DIVERGENCES)) & ~any_of(own),
    ]
    out = configured
    if bars is not None:
        days = bars.groupBy(F.col(key).alias("instrument")).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
        out = out.join(days, "instrument", "left")
        tests.append(F.coalesce((F.col("_from") > F.col("end")) | (F.col("_to") < F.col("start")), F.lit(True)))
    found = F.coalesce(*(F.when(test, text) for test, text in zip(tests, PROBLEMS, strict=False)))
    return out.withColumn("problem", found).drop("_from", "_to")


def told(side: str) -> Column:
    """Why a side's trades are made, as ``rules.reason`` has it."""
    rule = lambda r: F.concat(F.lit("r"), r["row_id"].cast("string"), F.lit(": "), r["variable"], F.lit(" "), r["condition"], F.when(r["condition"].isin(*DIVERGENCES), "").otherwise(F.format_string(" %.2f", r["value"])))
    before, after = REASON.format(side=side.title(), lower=side, rules="\0").split("\0")
    return F.concat(F.lit(before), F.array_join(F.transform(side, rule), "; "), F.lit(after))


def holds(rule: Column, numbers: Column, signals: Column, day: Column) -> Column:
    """Whether a rule holds on a bar, whose numbers and divergence signals are maps by name. Never NULL: what is missing doesn't hold."""
    value, limit = numbers[rule["variable"]], rule["value"]
    test = F.when(rule["condition"].isin(*DIVERGENCES), signals[F.concat_ws("|", rule["condition"], rule["variable"], F.col("_windows"))] if signals is not None else F.lit(False))
    for name, own in (("=", value == limit), (">", value > limit), ("<", value < limit), (">=", value >= limit), ("<=", value <= limit)):
        test = test.when(rule["condition"] == name, own)
    return F.coalesce(test & (day >= rule["start"]) & (day <= rule["end"]), F.lit(False))


def signalled(configured: DataFrame, bars: DataFrame, variables: Sequence[str], price: str = "close", key: str = "symbol", ts: str = "date", indicators: Sequence[str] = (), windows: Sequence[tuple[int, int]] = WINDOWS) -> DataFrame:
    """``strategy_id, date, enter, exit, price`` and the terms, for each bar in a strategy's dates. Divergences of ``indicators`` are looked for within these dates, with each of ``windows``, of which a strategy goes by its own."""
    sound = problems(configured, indicators, bars, key, ts, windows).filter("problem IS NULL").drop("problem")
    terms = ["initial_deposit", "commission_pct", "slippage_pct", "instrument"]
    rows = sound.join(bars.withColumnsRenamed({key: "instrument", ts: "date"}), "instrument").filter("date BETWEEN start AND end")
    rows = rows.select(KEY, "date", *terms, *SIDES, F.concat_ws("|", "divergence_pivot_window", "divergence_lookback").alias("_windows"), *dict.fromkeys([price, *variables, *indicators]))
    named = {}
    for indicator in indicators:
        for condition, (side, lookback) in product(DIVERGENCES, windows):
            column = named[f"{condition}|{indicator}|{side}|{lookback}"] = f"_{len(named)}"
            rows = with_boolean_divergence(rows, price, indicator, condition.startswith("bull"), column, side=side, lookback=lookback, key=KEY, ts="date")
    numbers = F.create_map(*(x for v in variables for x in (F.lit(v), F.col(f"`{v}`").cast("double"))))
    signals = F.create_map(*(x for n, c in named.items() for x in (F.lit(n), F.col(c)))) if named else None
    met = lambda s: F.forall(s, lambda r: holds(r, F.col("_numbers"), F.col("_signals") if named else None, F.col("date")))
    mapped = rows.withColumn("_numbers", numbers)
    if named:
        mapped = mapped.withColumn("_signals", signals)
    return mapped.select(KEY, "date", *terms, *(met(s).alias(s) for s in SIDES), F.col(f"`{price}`").cast("double").alias("price"), *(told(s).alias(f"{s}_told") for s in SIDES))


def run_all(configured: DataFrame, bars: DataFrame, variables: Sequence[str], price: str = "close", **settings) -> DataFrame:
    """A row as ``backtest.simulate`` has it for each bar of every sound strategy, each on its own instrument, dates and costs. Strategies with a problem have none; an empty table of either gives none."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        terms = Terms(first["initial_deposit"], first["commission_pct"] / 100, first["slippage_pct"] / 100, price, price, first["enter_told"], first["exit_told"])
        days = pdf.sort_values("date")[["date", "enter", "exit", "price"]].itertuples(index=False)
        return pd.DataFrame([(first[KEY], *row) for row in walked(days, terms)], columns=FIELDS)

    return signalled(configured, bars, variables, price, **settings).groupBy(KEY).applyInPandas(fold, ROW)
