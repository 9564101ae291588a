"""Indicators that are recursions over a symbol's bars, all in one grouped pass.

A recursion needs each bar in turn, which window functions can't express; a symbol's bars (one row a
day) are a bounded group. Two conventions exist for RSI and MACD: the screener's and the tester's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.functions.columns import without_nan

COLUMNS = ("ewm12", "wilder14", "rsi_screen", "rsi_tester", "macd_screen", "macd_tester", "adx", "di_plus", "di_minus")


def wilder(values: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then each value pulls by 1/n. A missing one among the first n leaves all missing; a later one, what follows it."""
    out = np.full(len(values), np.nan)
    if len(values) >= n and not np.isnan(values[:n]).any():
        level = out[n - 1] = values[:n].mean()
        for i in range(n, len(values)):
            level = out[i] = level + (values[i] - level) / n
    return out


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, DI+ and DI-."""
    if not len(close):
        return close, close, close
    before = np.append(np.nan, close[:-1])
    spans = np.stack([high - low, np.abs(high - before), np.abs(low - before)])
    span = np.fmax.reduce(spans)
    up, down = np.append(np.nan, np.diff(high)), np.append(np.nan, -np.diff(low))
    smooth = [wilder(x, n) for x in (span, np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0))]
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(smooth[0] == 0, np.nan, smooth[0])
        plus, minus = 100 * smooth[1] / base, 100 * smooth[2] / base
        total = plus + minus
        index = 100 * np.abs(plus - minus) / np.where(total == 0, np.nan, total)
    adx = np.full(len(close), np.nan)
    adx[n - 1 :] = wilder(index[n - 1 :], n)
    return adx, plus, minus


def rsi_screen(close: pd.Series, n: int = 14) -> pd.Series:
    """The first bar counts as no change; valid from the n-th bar; no losses: 100."""
    move = close.diff().fillna(0.0)
    gain, loss = (x.ewm(alpha=1 / n, min_periods=n, adjust=False).mean() for x in (move.clip(lower=0), -move.clip(upper=0)))
    return (100 - 100 / (1 + gain / loss.where(loss != 0))).where(loss != 0, gain.where(gain.isna(), 100.0))


def rsi_tester(close: pd.Series, n: int = 14) -> pd.Series:
    """The first bar is missing; no losses: missing."""
    move = close.diff()
    gain, loss = (x.ewm(alpha=1 / n, adjust=False).mean() for x in (move.clip(lower=0), -move.clip(upper=0)))
    return 100 - 100 / (1 + gain / loss.where(loss != 0))


def macd_histogram(close: pd.Series, fast: int = 12, slow: int = 26, signal: int = 9, warm: bool = True) -> pd.Series:
    """``warm``: each average waits for as many bars as its span."""
    mean = lambda x, n: x.ewm(span=n, min_periods=n if warm else 0, adjust=False).mean()
    line = mean(close, fast) - mean(close, slow)
    return line - mean(line, signal)


def with_recursive(bars: DataFrame, columns: Sequence[str] = COLUMNS, where: str | None = None) -> DataFrame:
    """``bars`` with recursive indicators (all of COLUMNS, or some), one grouped pass over each symbol. ``where`` names a boolean column: other rows take no part and have none."""
    some = set(columns)

    def computed(pdf: pd.DataFrame) -> pd.DataFrame:
        close = pdf["close"].astype("float64")
        made = {
            "ewm12": lambda: close.ewm(span=12, adjust=False).mean(),
            "wilder14": lambda: wilder(close.to_numpy(), 14),
            "rsi_screen": lambda: rsi_screen(close),
            "rsi_tester": lambda: rsi_tester(close),
            "macd_screen": lambda: macd_histogram(close),
            "macd_tester": lambda: macd_histogram(close, warm=False),
        }
        out = {c: make() for c, make in made.items() if c in some}
        if some & {"adx", "di_plus", "di_minus"}:
            out |= zip(("adx", "di_plus", "di_minus"), directional(*(pdf[c].to_numpy("float64") for c in ("high", "low", "close"))), strict=True)
        return pd.DataFrame({c: out[c] for c in columns}, index=pdf.index)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        return pdf.join(computed(pdf if where is None else pdf[pdf[where]]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    return without_nan(bars.groupBy("symbol").applyInPandas(run, f"{kinds}, " + ", ".join(f"{c} double" for c in columns)))
