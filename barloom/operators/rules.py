"""Rule rows compiled to column expressions."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import all_of
from barloom.operators.pivots import with_boolean_divergence

COMPARISONS = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
DIVERGENCES = ("bull divergence", "bear divergence")
#: How a trade tells its reason.
REASON = "{side} signal: all active {lower} conditions matched ({rules})"
#: Names of the live dataset's indicators.
INDICATORS = ("SMA50", "SMA200", "High vs MA50", "High vs MA200", "Low vs MA50", "Low vs MA200", "RSI", "MACD", "ROC")


@dataclass(frozen=True)
class Condition:
    row_id: int
    variable: str
    condition: str
    value: float | None = None
    start: str | None = None
    end: str | None = None
    price: str | None = None

    def __post_init__(self):
        if self.condition not in COMPARISONS and self.condition not in DIVERGENCES:
            raise ValueError(f"no such condition: {self.condition}")

    def text(self) -> str:
        given = "" if self.condition in DIVERGENCES or self.value is None else f" {self.value:.2f}"
        return f"r{self.row_id}: {self.variable} {self.condition}{given}"

    def signal_name(self, price: str) -> str:
        return f"_{self.condition.split()[0]}_{self.variable}_{self.price or price}"


def resolved(variable: str, source: str) -> str:
    """The column of a rule's variable: an indicator is itself, a price belongs to the underlying or the traded instrument."""
    if variable in INDICATORS:
        return variable
    if variable in ("Open", "High", "Low", "Close") and source in ("Underlying", "Traded"):
        return f"{source}_{variable}"
    raise ValueError(f"no such variable: {variable}")


def reason(side: str, conditions: Sequence[Condition]) -> str:
    """Why a trade was made, as text: the conditions by row number."""
    return REASON.format(side=side, lower=side.lower(), rules="; ".join(c.text() for c in sorted(conditions, key=lambda c: c.row_id)))


def with_divergences(df: DataFrame, conditions: Sequence[Condition], price: str, side: int = 3, lookback: int = 60, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """``df`` with a signal column for each different divergence that the conditions ask for."""
    for name, c in {c.signal_name(price): c for c in conditions if c.condition in DIVERGENCES}.items():
        df = with_boolean_divergence(df, c.price or price, c.variable, c.condition.startswith("bull"), name, side=side, lookback=lookback, key=key, ts=ts)
    return df


def compiled(c: Condition, price: str, ts: str = "ts") -> Column:
    """A condition as a column that is never NULL; dates are inclusive from midnight to midnight."""
    if c.condition in DIVERGENCES:
        test = F.col(f"`{c.signal_name(price)}`")
    elif c.value is None:
        test = F.lit(False)
    else:
        test = COMPARISONS[c.condition](F.col(f"`{c.variable}`"), F.lit(float(c.value)))
    for limit, inside in ((c.start, lambda x, y: x >= y), (c.end, lambda x, y: x <= y)):
        if limit:
            test = test & inside(F.col(ts), F.lit(limit).cast("timestamp_ntz" if "T" in limit or " " in limit else "date"))
    return F.coalesce(test, F.lit(False))


def signal(conditions: Sequence[Condition], price: str, ts: str = "ts") -> Column:
    """All conditions together; none: never."""
    return all_of([compiled(c, price, ts) for c in conditions])
