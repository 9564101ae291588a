"""Screening filters over the metrics table. Each is a condition; Catalyst merges them into one filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import finite

ANY = "All"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def conditions() -> dict[str, dict[str, Column]]:
    """Filter and choice to condition."""
    adx = _c("ADX_14") > 25
    return {
        "rsi": {"oversold": _c("RSI_14") < 30, "overbought": _c("RSI_14") > 70, "either": (_c("RSI_14") < 30) | (_c("RSI_14") > 70)},
        "trend": {"bull": _c("SMA_Trend") == "bull", "bear": _c("SMA_Trend") == "bear", "either": _c("SMA_Trend").isin("bull", "bear")},
        "divergence": {f"{d}{n}": (_c(f"Divergence_{d.title()}_Count") >= 2) if n == 2 else (_c(f"Divergence_{d.title()}_Count") == 3) for d in ("bull", "bear") for n in (2, 3)},
        "adx": {"bull": adx & (_c("DI_Plus_14") > _c("DI_Minus_14")), "bear": adx & (_c("DI_Plus_14") < _c("DI_Minus_14"))},
        "cross": {"golden_d1": _c("GoldenCross_D1") == 1, "death_d1": _c("DeathCross_D1") == 1, "golden_w1": _c("GoldenCross_W1") == 1, "death_w1": _c("DeathCross_W1") == 1},
        "bands": {"high": _c("BB_Position") >= 5, "low": _c("BB_Position") <= -5},
    }


def screened(metrics: DataFrame, group: str = ANY, subgroup: str = ANY, **chosen: str) -> DataFrame:
    """Rows that meet all chosen filters; a condition that is NULL isn't met."""
    for name, value in (("Group", group), ("Subgroup", subgroup)):
        if value != ANY:
            metrics = metrics.filter(_c(name) == value)
    known = conditions()
    for name, choice in chosen.items():
        metrics = metrics.filter(known[name][choice])
    return metrics


def options(metrics: DataFrame, column: str, group: str = ANY) -> DataFrame:
    """The choices of a filter: sorted distinct values."""
    return screened(metrics, group).select(column).distinct().filter(_c(column).isNotNull()).orderBy(column)


def top(metrics: DataFrame, column: str, n: int = 5, need: bool = False, order: str = "ord") -> DataFrame:
    """The n largest values, missing ones last (``need``: left out), ties in universe order: no full sort."""
    rows = metrics.filter(_c(column).isNotNull()) if need else metrics
    return rows.orderBy(_c(column).desc_nulls_last(), order).limit(n)


def top_by_flows(metrics: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The n largest three-month flows, and one row that says whether there were none to choose from."""
    column = "FundFlows_3M_%"
    return top(metrics, column, n, need=True), metrics.agg((F.count(_c(column)) == 0).alias("flow_unavailable"))


def in_order(rows: DataFrame, order: DataFrame, key: str, position: str = "position") -> DataFrame:
    """``rows`` with the place that ``order`` (``key, position``) gives them; those that it doesn't name have none and sort last."""
    return rows.join(order.select(key, position), key, "left").orderBy(F.col(position).asc_nulls_last(), key)


def numbered_rows(rows: DataFrame, by: str, order: str = "ord", name: str = "Order") -> DataFrame:
    """``rows`` with a number from 0 within each ``by``, in ``order``."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("int"))


def chart_frame(metrics: DataFrame, by: str = "List", numeric: Sequence[str] = ()) -> DataFrame:
    """Rows of a bar chart: the label of the axis, the place on it, and ``numeric`` columns as numbers, NULL where they hold something else."""
    labelled = metrics.withColumn("TickerAxis", F.concat("Ticker", F.lit(" ("), "Subgroup", F.lit(")")))
    numbers = {c: finite(F.col(f"`{c}`").try_cast("double")) for c in numeric if c in metrics.columns}
    return numbered_rows(labelled.withColumns(numbers) if numbers else labelled, by)


def chart_bars(frame: DataFrame, metric: str, dot: str | None = None) -> DataFrame:
    """The bars of one metric: rows of a chart frame that have it, with the value of the dot if there is one."""
    return frame.filter(_c(metric).isNotNull()).select("Order", "TickerAxis", "Ticker", "Group", "Subgroup", _c(metric), *([_c(dot)] if dot else []))


#: Columns that a source of flows brings.
FLOWS = ("FundFlows_1M_%", "FundFlows_3M_%")


def with_flows(metrics: DataFrame, flows: DataFrame) -> DataFrame:
    """``metrics`` with the flows of each ticker (``ticker`` and the columns of FLOWS) where they are known."""
    return metrics.drop(*FLOWS).join(flows.select(F.col("ticker").alias("Ticker"), *(_c(c) for c in FLOWS)), "Ticker", "left")


def subgroup_of_ticker(rows: DataFrame) -> DataFrame:
    """``ticker, subgroup``: where a ticker comes first."""
    return rows.groupBy("ticker").agg(F.min_by("subgroup", "ord").alias("subgroup"))
