"""What a run exports: CSV with two places."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_places(df: DataFrame) -> DataFrame:
    """All doubles with two places, halves to the even side."""
    return df.select(*(F.bround(F.col(f"`{n}`"), 2).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def display_text(df: DataFrame) -> DataFrame:
    """All doubles as text with two places; empty where there is none."""
    shown = lambda n: F.coalesce(F.format_string("%.2f", F.bround(F.col(f"`{n}`"), 2)), F.lit("")).alias(n)
    return df.select(*(F.when(F.col(f"`{n}`").isNull(), "").otherwise(shown(n)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def wide_curves(curves: DataFrame, series: list[str]) -> DataFrame:
    """``date`` and a column for each of ``series``, two places."""
    return two_places(curves.groupBy("date").pivot("series", series).agg(F.max("equity")))


def write_equity(curves: DataFrame, series: list[str], path: str) -> None:
    wide_curves(curves, series).orderBy("date").write.csv(path, header=True, mode="overwrite")


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` computed once for all that is done within, and released after it."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()
