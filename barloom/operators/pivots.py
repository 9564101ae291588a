"""Pivots and divergences between prices and indicators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barloom.operators.rolling import by_symbol, rolling_std


def pivot(c: str, side: int, low: bool, w: WindowSpec | None = None) -> Column:
    """Whether a value is the least (or greatest) of the ``side`` bars on both sides and itself; ties count, a missing value near it doesn't let it be one."""
    frame = (w or by_symbol()).rowsBetween(-side, side)
    edge = (F.min if low else F.max)(c).over(frame)
    return F.coalesce((F.count(c).over(frame) == 2 * side + 1) & (F.col(c) == edge), F.lit(False))


def unique_pivot(c: str, side: int, low: bool, w: WindowSpec | None = None) -> Column:
    """As ``pivot``, but no other bar in the frame may have the same value, and missing values are passed over. The first and last ``side`` bars are none."""
    w = w or by_symbol()
    frame = w.rowsBetween(-side, side)
    edge = (F.min if low else F.max)(c).over(frame)
    same = F.size(F.filter(F.collect_list(c).over(frame), lambda v: v == F.col(c)))
    inside = (F.count(F.lit(1)).over(w.rowsBetween(-side, -1)) == side) & (F.count(F.lit(1)).over(w.rowsBetween(1, side)) == side)
    return F.coalesce(inside & (F.col(c) == edge) & (same == 1), F.lit(False))


def nearest_indicator_pivot(ind: str, is_pivot: str, k: int, w: WindowSpec | None = None) -> Column:
    """The nearest indicator pivot within k bars as ``struct(distance, i, v)``; of two as near the earlier one. Needs a bar number ``i``."""
    near = F.collect_list(F.when(F.col(is_pivot), F.struct(F.col("i"), F.col(ind).alias("v")))).over((w or by_symbol()).rowsBetween(-k, k))
    return F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["i"] - F.col("i")).alias("distance"), p["i"].alias("i"), p["v"].alias("v"))))


@dataclass(frozen=True)
class DivergenceSettings:
    """Fixed default values of the screener."""

    pivot_window: int = 3
    lookback_bars: int = 60
    alignment_tolerance: int = 2
    min_price_move: float = 0.005
    min_ind_move_rsi: float = 4.0
    min_ind_move_macd_std: float = 0.5
    min_ind_move_roc_std: float = 0.7
    rolling_std_n: int = 20
    max_span: int = 40
    wp: float = 0.35
    wi: float = 0.40
    wt: float = 0.15
    wz: float = 0.10
    eps: float = 1e-9


def matched_pivots(bars: DataFrame, price: str, ind: str, low: bool, s: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """``symbol, i, p, v, t_ind, std, n`` for each price pivot with an indicator pivot near it."""
    numbered = bars.withColumns({"i": F.row_number().over(by_symbol()) - 1, "n": F.count("*").over(Window.partitionBy("symbol")), "std": rolling_std(ind, s.rolling_std_n, 5)})
    marked = numbered.withColumns({"_pp": pivot(price, s.pivot_window, low), "_ip": pivot(ind, s.pivot_window, low)})
    found = marked.withColumn("near", nearest_indicator_pivot(ind, "_ip", s.alignment_tolerance)).filter("_pp AND near IS NOT NULL")
    return found.select("symbol", "i", F.col(price).alias("p"), F.col("near.v").alias("v"), F.col("near.i").alias("t_ind"), "std", "n")


def with_divergences(bars: DataFrame, kinds: Sequence[tuple[str, str, str]], s: DivergenceSettings = DivergenceSettings(), low: str = "low", high: str = "high", w: WindowSpec | None = None, whole: WindowSpec | None = None) -> DataFrame:
    """``bars`` with ``<label>_low`` and ``<label>_high`` for each (label, indicator, name) of ``kinds``: the scored divergence that ends on a bar, if any.

    A candidate goes from one matched pivot to the next. ``name`` (RSI, MACD_HIST or ROC) says how
    far an indicator must move. Candidates are ``struct(score, side, t2, direction, type)`` and the
    greatest is the best: of equal scores lows before highs, then the oldest. Both sides and all
    indicators are columns of one frame, so they share its sorting.
    """
    w, whole = w or by_symbol(), whole or Window.partitionBy("symbol")
    prices = {"low": low, "high": high}
    both = [(label, ind, name, side) for label, ind, name in kinds for side in prices]
    out = bars.withColumns({"i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)} | {f"_{side}_p": pivot(c, s.pivot_window, side == "low", w) for side, c in prices.items()} | {f"_{label}_std": rolling_std(ind, s.rolling_std_n, 5, w) for label, ind, _ in kinds} | {f"_{label}_{side}_ip": pivot(ind, s.pivot_window, side == "low", w) for label, ind, _, side in both})
    # as text from here on: a column of many parts costs a call to the JVM for each, text costs one
    around = w.rowsBetween(-s.alignment_tolerance, s.alignment_tolerance)
    out = out.withColumns({f"_{label}_{side}_near": F.collect_list(F.expr(f"if(`_{label}_{side}_ip`, struct(i, `{ind}` AS v), NULL)")).over(around) for label, ind, _, side in both})
    nearest = lambda near: f"array_min(transform({near}, x -> struct(abs(x.i - i) AS distance, x.i AS i, x.v AS v))).v"
    own = lambda label, side: F.expr(f"if(`_{side}_p` AND size(`_{label}_{side}_near`) > 0, struct(i, `{prices[side]}` AS p, {nearest(f'`_{label}_{side}_near`')} AS v), NULL)")
    out = out.withColumns({f"_{label}_{side}_now": own(label, side) for label, _, _, side in both})
    out = out.withColumns({f"_{label}_{side}_was": F.last(f"_{label}_{side}_now", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for label, _, _, side in both})
    out = out.withColumns({f"{label}_{side}": _candidate(f"`_{label}_{side}_was`", f"`_{label}_{side}_now`", f"`_{label}_std`", "_n", side == "low", name, s) for label, _, name, side in both})
    return out.select(*bars.columns, *(f"{label}_{side}" for label, _, _, side in both))


def _candidate(was: str, now: str, std: str, n: str, low: bool, name: str, s: DivergenceSettings) -> Column:
    """A candidate from one matched pivot to the next, as an expression over columns of these names."""
    number = lambda x: f"CAST({x!r} AS double)"
    span, dv, dp = f"({now}.i - {was}.i)", f"({now}.v - {was}.v)", f"try_divide({now}.p - {was}.p, if({was}.p <> 0, {was}.p, NULL))"
    sd, eps = f"coalesce({std}, CAST(0 AS double))", number(s.eps)
    need = {"RSI": number(s.min_ind_move_rsi), "MACD_HIST": f"{number(s.min_ind_move_macd_std)} * ({std} + {eps})", "ROC": f"{number(s.min_ind_move_roc_std)} * ({std} + {eps})"}[name]
    rises, falls = f"{dp} > 0 AND {dv} < 0", f"{dp} < 0 AND {dv} > 0"
    regular, hidden = (falls, rises) if low else (rises, falls)
    way = "bull" if low else "bear"
    kind = f"CASE WHEN {regular} THEN 'regular_{way}' WHEN {hidden} THEN 'hidden_{way}' END"
    if name == "RSI":
        zone = f"least({now}.v, {was}.v) < 30" if low else f"greatest({now}.v, {was}.v) > 70"
    else:
        zone = f"({now}.v * {was}.v < 0 OR {sd} > 0 AND greatest(abs({now}.v), abs({was}.v)) >= 1.5 * {sd})"
    within = lambda x: f"greatest(CAST(0 AS double), least(CAST(1 AS double), {x}))"
    score = f"{number(s.wp)} * abs({dp}) + {number(s.wi)} * abs({dv}) / ({sd} + {eps}) + {number(s.wt)} * {within(f'{span} / {s.max_span}')} + {number(s.wz)} * CAST({zone} AS double)"
    near = f"{now}.i >= greatest(0, {n} - {s.lookback_bars}) AND {span} > 0 AND {span} <= {s.max_span} AND abs({dp}) >= {number(s.min_price_move)} AND abs({dv}) >= {need}"
    return F.expr(f"CASE WHEN {near} AND {kind} IS NOT NULL THEN struct(100 * {within(score)} AS score, {1 if low else 0} AS side, -{now}.i AS t2, '{way}' AS direction, {kind} AS type) END")


def parted(price_change: str, ind_change: str, least: float = 0.0) -> Column:
    """Whether two changes of more than ``least`` go apart: named after the indicator's way, "bull" or "bear"; else "nothing". NULL if one is missing."""
    apart = f"sign(`{price_change}`) = -sign(`{ind_change}`) AND least(abs(`{price_change}`), abs(`{ind_change}`)) > CAST({least!r} AS double)"
    return F.expr(f"CASE WHEN `{price_change}` IS NULL OR `{ind_change}` IS NULL THEN NULL WHEN {apart} THEN if(`{ind_change}` > 0, 'bull', 'bear') ELSE 'nothing' END")


def best_divergence(label: str) -> Column:
    """An aggregate over ``with_divergences``: the best candidate of both sides."""
    return F.greatest(F.max(f"{label}_low"), F.max(f"{label}_high"))


def scored_divergence(bars: DataFrame, ind: str, name: str, s: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """``symbol, direction, score, type`` for every symbol of ``bars``: the best candidate, else "nothing"."""
    found = with_divergences(bars, [("d", ind, name)], s).groupBy("symbol").agg(best_divergence("d").alias("b"))
    return found.select("symbol", F.coalesce("b.direction", F.lit("nothing")).alias("direction"), F.col("b.score").alias("score"), F.coalesce("b.type", F.lit("none")).alias("type"))


def boolean_divergence(price: str, ind: str, bull: bool, side: int = 3, lookback: int = 60, causal: bool = False, key: str = "symbol", ts: str = "ts") -> list[tuple[str, Column]]:
    """Steps (name, column) that end in ``signal``: at a price pivot, whether price and indicator went apart since each one's previous pivot within ``lookback`` bars.

    A pivot is known ``side`` bars later. The signal stands on the pivot itself, as the tester has
    it; ``causal`` moves it to where it is known.
    """
    w = by_symbol(key, ts)
    before = w.rowsBetween(-lookback, -1)
    then_p = F.last(F.when(F.col("_pp"), F.col(price)), ignorenulls=True).over(before)
    then_i = F.last(F.when(F.col("_ip"), F.col(ind)), ignorenulls=True).over(before)
    apart = (F.col(price) < F.col("_p1")) & (F.col(ind) > F.col("_i1")) if bull else (F.col(price) > F.col("_p1")) & (F.col(ind) < F.col("_i1"))
    steps = [("_pp", unique_pivot(price, side, bull, w)), ("_ip", unique_pivot(ind, side, bull, w)), ("_p1", then_p), ("_i1", then_i), ("signal", F.coalesce(F.col("_pp") & apart, F.lit(False)))]
    return steps + [("signal", F.coalesce(F.lag("signal", side).over(w), F.lit(False)))] if causal else steps


def with_boolean_divergence(bars: DataFrame, price: str, ind: str, bull: bool, name: str = "signal", **settings) -> DataFrame:
    """``bars`` with the boolean divergence as column ``name``."""
    out = bars
    for step, column in boolean_divergence(price, ind, bull, **settings):
        out = out.withColumn(step, column)
    return out.select(*bars.columns, F.col("signal").alias(name))
