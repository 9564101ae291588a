"""Recursive indicators of a stream of bars, from keyed state: an extension.

A symbol's state is some fifty numbers (``stepwise.Indicators``), whatever the length of its history, so a batch
reads its new bars only. State is in the state store under the stream's checkpoint: a restarted stream goes on
where it was, on whatever executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.columns import without_nan
from barloom.operators.recursive import COLUMNS
from barloom.operators.stepwise import Indicators

BARS = "symbol string, ts date, open double, high double, low double, close double, volume double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IndicatorState(StatefulProcessor):
    """A symbol's new bars with their indicators. Bars that aren't later than the last one taken can't be folded in any more and are left out; of equal days in a batch the first stays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("indicators", "last date, numbers array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).sort_values("ts", kind="stable", ignore_index=True).drop_duplicates("ts", ignore_index=True)
        own = Indicators()
        if self.kept.exists():
            last, numbers = self.kept.get()
            own.restore(list(numbers))
            new = new[new["ts"] > last].reset_index(drop=True)
        if len(new):
            found = own.take(*(new[c].to_numpy("float64") for c in ("high", "low", "close")))
            self.kept.update((new["ts"].iloc[-1], own.held()))
            yield pd.DataFrame({"symbol": key[0], "ts": new["ts"], **{c: found[c] for c in COLUMNS}})

    def close(self) -> None:
        pass


def indicator_stream(bars: DataFrame) -> DataFrame:
    """``symbol, ts`` and the recursive indicators of each new bar of a stream ``symbol, ts, high, low, close``, whose symbols' days rise from batch to batch."""
    new = bars.select("symbol", "ts", "high", "low", "close").filter("symbol IS NOT NULL AND ts IS NOT NULL")
    made = new.groupBy("symbol").transformWithStateInPandas(IndicatorState(), "symbol string, ts date, " + ", ".join(f"{c} double" for c in COLUMNS), "Append", "None")
    return without_nan(made)


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs this state store; the session's own choice comes back after the stream."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def refreshed(spark: SparkSession, landed: str, out: str, checkpoint: str, files: int | None = None) -> None:
    """Takes all Parquet bars that have come into the folder ``landed`` since the last call, ``files`` of them in a batch at most, and adds their indicators to the table at ``out``."""
    source = spark.readStream.schema(BARS)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    with keyed_store(spark):
        indicator_stream(source.parquet(landed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed(bars: DataFrame, cuts: list[str]) -> DataFrame:
    """The indicators of ``bars`` as a stream gives them that gets the days before the first of ``cuts``, then those before the second, and so on, and is started anew for each."""
    from pyspark.sql import functions as F

    from barloom.sources.folders import fresh

    spark, (landed, out, checkpoint) = bars.sparkSession, (fresh(bars.sparkSession, n) for n in ("bars", "indicators", "stream"))
    columns = [c.split()[0] for c in BARS.split(", ")]
    edges = [None, *cuts, None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = bars
        for edge, inside in ((low, lambda d: F.col("ts") >= d), (high, lambda d: F.col("ts") < d)):
            if edge:
                part = part.filter(inside(F.lit(edge).cast("date")))
        part.select(*columns).write.mode("append").parquet(landed)
        refreshed(spark, landed, out, checkpoint)
    return spark.read.schema("symbol string, ts date, " + ", ".join(f"{c} double" for c in COLUMNS)).parquet(out)
