"""The recursions of ``recursive`` as steps: each holds a few numbers between one run of values and the next.

A step takes values in order and gives what the recursion has at each; taking a series at once or in
pieces gives the same. So a stream keeps only the numbers (``streaming.recursive``). As EWM and Wilder's level are
affine in what went before, a piece that isn't taken yet can be summed up by a few numbers too (``chunk``), and
``skip`` moves a step past it: pieces of one series are then worked on side by side (``by_chunks``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from barloom.functions.columns import without_nan

Values = np.ndarray


class Ewm:
    """``ewm(alpha, adjust=False)`` as pandas has it: a missing value keeps the level and lowers its weight; ``least`` values must have been there."""

    def __init__(self, alpha: float, least: int = 0):
        self.alpha, self.least = alpha, least
        self.held = [np.nan, 0.0, 0.0]  # level, values missing since the last one, values so far

    def _first(self, x: float, missing: float) -> float:
        """The level after a value that comes after so many missing ones."""
        level = self.held[0]
        weight = (1 - self.alpha) ** (missing + 1)
        return x if np.isnan(level) else (weight * level + self.alpha * x) / (weight + self.alpha)

    def take(self, x: Values) -> Values:
        level, missing, seen = self.held
        there = ~np.isnan(x)
        out, places = np.full(len(x), level), np.flatnonzero(there)
        if len(places):
            first = places[0]
            rest = x[first:].copy()
            rest[0] = self._first(rest[0], missing + first)
            out[first:] = pd.Series(rest).ewm(alpha=self.alpha, adjust=False).mean()
            self.held = [out[-1], float(len(x) - 1 - places[-1]), seen + len(places)]
        else:
            self.held = [level, missing + len(x), seen]
        return np.where(seen + np.cumsum(there) >= self.least, out, np.nan)

    def chunk(self, x: Values) -> list[float]:
        """Rows, values, missing ones before the first, the first, missing ones after the last, and what maps the level at the first to the one at the end."""
        places = np.flatnonzero(~np.isnan(x))
        if not len(places):
            return [len(x), 0, len(x), np.nan, 0, 1, 0]
        weight = (1 - self.alpha) ** np.diff(places).astype(float)
        rest = x[places[0] :].copy()
        rest[0] = 0.0
        offset = pd.Series(rest).ewm(alpha=self.alpha, adjust=False).mean().iloc[-1]
        return [len(x), len(places), places[0], x[places[0]], len(x) - 1 - places[-1], np.prod(weight / (weight + self.alpha)), offset]

    def skip(self, chunk: Values) -> None:
        rows, values, lead, first, tail, factor, offset = chunk
        level, missing, seen = self.held
        if values:
            self.held = [factor * self._first(first, missing + lead) + offset, tail, seen + values]
        else:
            self.held = [level, missing + rows, seen]


class Wilder:
    """The mean of the first n values, then each value pulls by 1/n. A missing one among the first n leaves all missing; a later one, what follows it."""

    def __init__(self, n: int):
        self.n = n
        self.held = [0.0, 0.0, np.nan]  # values so far (n at most), their sum until there are n, level

    def take(self, x: Values) -> Values:
        count, total, level = self.held
        out, need = np.full(len(x), np.nan), int(min(self.n - count, len(x)))
        if need:
            count, total = count + need, total + x[:need].sum()
            if count == self.n:
                level = out[need - 1] = total / self.n
        for i in range(need, len(x)):
            level = out[i] = level + (x[i] - level) / self.n
        self.held = [count, total, level]
        return out

    def chunk(self, x: Values) -> list[float]:
        """Rows, the first n values (filled up with 0), and the level at the end from a level of 0 before row r, for r from 0 to n."""
        first = np.zeros(self.n)
        first[: len(x)] = x[: self.n]
        keep, level, early = 1 - 1 / self.n, 0.0, [0.0]
        for i, value in enumerate(x.tolist()):
            level += (value - level) / self.n
            if i < self.n:
                early.append(level)
        early += [0.0] * (self.n + 1 - len(early))
        return [len(x), *first, *(level - keep ** max(len(x) - r, 0) * early[r] for r in range(self.n + 1))]

    def skip(self, chunk: Values) -> None:
        rows, first, ends = int(chunk[0]), chunk[1 : self.n + 1], chunk[self.n + 1 :]
        count, total, level = self.held
        need = int(min(self.n - count, rows))
        if need:
            count, total = count + need, total + first[:need].sum()
            if count == self.n:
                level = total / self.n
        if count == self.n and rows > need:
            level = (1 - 1 / self.n) ** (rows - need) * level + ends[need]
        self.held = [count, total, level]


def moved(x: Values, before: float) -> Values:
    return np.diff(x, prepend=before)


class Indicators:
    """All recursive indicators of a symbol, from high, low and close; the same columns as ``recursive.COLUMNS``."""

    N = 14

    def __init__(self):
        n = self.N
        self.before = [np.nan] * 3  # high, low, close of the last bar
        self.bars = 0
        self.steps = {
            "ewm12": Ewm(2 / 13), "wilder14": Wilder(n),
            "gain": Ewm(1 / n, n), "loss": Ewm(1 / n, n), "gain_t": Ewm(1 / n), "loss_t": Ewm(1 / n),
            "fast": Ewm(2 / 13, 12), "slow": Ewm(2 / 27, 26), "signal": Ewm(2 / 10, 9), "fast_t": Ewm(2 / 13), "slow_t": Ewm(2 / 27), "signal_t": Ewm(2 / 10),
            "span": Wilder(n), "up": Wilder(n), "down": Wilder(n), "index": Wilder(n),
        }

    def held(self) -> list[float]:
        return [float(self.bars), *self.before, *(x for s in self.steps.values() for x in s.held)]

    def restore(self, numbers: list[float]) -> None:
        self.bars, self.before, at = int(numbers[0]), list(numbers[1:4]), 4
        for s in self.steps.values():
            s.held, at = list(numbers[at : at + len(s.held)]), at + len(s.held)

    def take(self, high: Values, low: Values, close: Values) -> dict[str, Values]:
        step, n = self.steps, self.N
        take = lambda name, x: step[name].take(x)
        out = {"ewm12": take("ewm12", close), "wilder14": take("wilder14", close)}
        move = moved(close, self.before[2])
        known = np.where(np.isnan(move), 0.0, move)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain, loss = take("gain", np.maximum(known, 0)), take("loss", np.maximum(-known, 0))
            out["rsi_screen"] = np.where(loss == 0, np.where(np.isnan(gain), np.nan, 100.0), 100 - 100 / (1 + gain / loss))
            gain, loss = take("gain_t", np.maximum(move, 0)), take("loss_t", np.maximum(-move, 0))
            out["rsi_tester"] = 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss))
            for column, end in (("macd_screen", ""), ("macd_tester", "_t")):
                line = take(f"fast{end}", close) - take(f"slow{end}", close)
                out[column] = line - take(f"signal{end}", line)
            last = np.append(self.before[2], close[:-1])
            span = np.fmax.reduce([high - low, np.abs(high - last), np.abs(low - last)])
            up, down = moved(high, self.before[0]), -moved(low, self.before[1])
            wide, rise, fall = take("span", span), take("up", np.where((up > down) & (up > 0), up, 0.0)), take("down", np.where((down > up) & (down > 0), down, 0.0))
            base = np.where(wide == 0, np.nan, wide)
            out["di_plus"], out["di_minus"] = 100 * rise / base, 100 * fall / base
            total = out["di_plus"] + out["di_minus"]
            index = 100 * np.abs(out["di_plus"] - out["di_minus"]) / np.where(total == 0, np.nan, total)
        out["adx"] = np.full(len(close), np.nan)
        early = max(0, min(len(close), n - 1 - self.bars))  # bars before the first index
        out["adx"][early:] = take("index", index[early:])
        self.bars += len(close)
        self.before = [float(high[-1]), float(low[-1]), float(close[-1])]
        return out


def by_chunks(bars: DataFrame, chunk: Column, steps: Mapping[str, tuple[str, Callable[[], Ewm | Wilder]]]) -> DataFrame:
    """``bars`` with a column for each of ``steps`` (name to source column and step), as many tasks for a symbol as it has chunks.

    ``chunk`` must not fall as ``ts`` rises: a month of hourly bars, say. Each chunk becomes some thirty numbers; a symbol's
    chunks are then passed in order, which reads no bars, and each chunk runs from what it starts with. A task holds one chunk of a symbol, or the
    numbers of all chunks of one. Repeated ``ts`` of a symbol come in any order; missing numbers are as in ``Ewm`` and ``Wilder``; an empty table gives no rows.
    """
    rows = bars.withColumn("_chunk", chunk.cast("string"))
    sources = sorted({source for source, _ in steps.values()})

    def values(pdf: pd.DataFrame) -> dict[str, Values]:
        return {c: pdf[c].to_numpy("float64") for c in sources}

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        own = values(pdf.sort_values("ts"))
        told = [float(x) for source, make in steps.values() for x in make().chunk(own[source])]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "_chunk": pdf["_chunk"].iloc[:1], "_first": [pdf["ts"].min()], "_told": [told]})

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, made, starts = pdf.sort_values("_first"), [make() for _, make in steps.values()], []
        for told in pdf["_told"]:
            starts.append([float(x) for s in made for x in s.held])
            at, told = 0, np.asarray(told, float)
            for s, size in zip(made, sizes, strict=True):
                s.skip(told[at : at + size])
                at += size
        return pd.DataFrame({"symbol": pdf["symbol"], "_chunk": pdf["_chunk"], "_start": starts})

    def run(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        own, at, told = values(pdf), 0, list(starts["_start"].iloc[0])
        for name, (source, make) in steps.items():
            step = make()
            size = len(step.held)
            step.held, at = told[at : at + size], at + size
            pdf[name] = step.take(own[source])
        return pdf.drop(columns="_chunk")

    sizes = [len(make().chunk(np.zeros(1))) for _, make in steps.values()]
    ts = bars.schema["ts"].dataType.simpleString()
    told = rows.select("symbol", "_chunk", "ts", *sources).groupBy("symbol", "_chunk").applyInPandas(summed, f"symbol string, _chunk string, _first {ts}, _told array<double>")
    starts = told.groupBy("symbol").applyInPandas(passed, "symbol string, _chunk string, _start array<double>")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    both = rows.groupBy("symbol", "_chunk").cogroup(starts.groupBy("symbol", "_chunk"))
    return without_nan(both.applyInPandas(run, f"{kinds}, " + ", ".join(f"`{n}` double" for n in steps)))
