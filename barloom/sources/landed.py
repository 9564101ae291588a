"""Bars that a downloader has landed as Parquet, a folder (or file) for each symbol, as a data source.

A symbol is a partition. What a query asks of ``symbol`` and ``ts`` is pushed: symbols that it doesn't want aren't partitions,
and days go down to the Parquet files' statistics. Only the columns of the read schema are read. A read that
fails is tried again; where a period has no rows for a symbol the next one of ``periods`` is read.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "symbol string, ts date, open double, high double, low double, close double, volume double"
TRIES, WAIT = 3, 0.25
#: What a path template stands for: bars adjusted for splits and dividends, or as they were traded.
KINDS = {True: "adjusted", False: "unadjusted"}
#: How a comparison with a day limits days: the first that may come, the last that may.
LIMITS = {
    EqualTo: lambda d: (d, d), GreaterThanOrEqual: lambda d: (d, None), LessThanOrEqual: lambda d: (None, d),
    GreaterThan: lambda d: (d + dt.timedelta(days=1), None), LessThan: lambda d: (None, d - dt.timedelta(days=1)),
}


@dataclass
class SymbolPartition(InputPartition):
    symbol: str
    start: dt.date | None
    end: dt.date | None


class LandedReader(DataSourceReader):
    """Options: ``path`` with ``{symbol}`` in it, and ``{period}`` and ``{kind}`` if it has these; ``symbols`` and ``periods`` (joined by commas), ``adjusted`` (true unless it says false), ``start`` and ``end`` (inclusive dates). A symbol without rows in any period has none."""

    def __init__(self, options: dict, schema: StructType):
        listed = lambda name: [s.strip() for s in options.get(name, "").split(",") if s.strip()]
        self.path, self.symbols, self.periods = options["path"], listed("symbols"), listed("periods") or [""]
        self.kind = KINDS[options.get("adjusted", "true").lower() != "false"]
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        day = lambda name: dt.date.fromisoformat(options[name]) if options.get(name) else None
        self.start, self.end = day("start"), day("end")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes limits of ``ts`` and choices of ``symbol``; gives back what Spark has to look at itself."""
        for f in filters:
            of, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if of == ("ts",) and type(f) in LIMITS and type(value) is dt.date:
                low, high = LIMITS[type(f)](value)
                self.start = max(filter(None, (self.start, low)), default=None)
                self.end = min(filter(None, (self.end, high)), default=None)
            elif of == ("symbol",) and type(f) in (EqualTo, In):
                wanted = {value} if type(f) is EqualTo else set(value)
                self.symbols = [s for s in self.symbols if s in wanted]
            else:
                yield f

    def partitions(self) -> list[SymbolPartition]:
        return [SymbolPartition(s, self.start, self.end) for s in dict.fromkeys(self.symbols)]

    def read(self, partition: SymbolPartition) -> Iterator:
        for period in self.periods:
            path = self.path.replace("{symbol}", partition.symbol).replace("{period}", period).replace("{kind}", self.kind)
            if (rows := tried(path)) is not None and rows.count_rows():
                yield from selected(rows, partition, self.columns)
                return


def tried(path: str):
    """The Parquet files at a path, or None if there is nothing. A read that fails is tried again after a while."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    for k in range(TRIES):
        try:
            where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            return ds.dataset(inner, filesystem=where, format="parquet")
        except FileNotFoundError:
            return None
        except OSError:
            if k + 1 == TRIES:
                raise
            time.sleep(WAIT * (k + 1))


def selected(rows, partition: SymbolPartition, columns: list[tuple[str, str]]) -> Iterator:
    """A symbol's rows in batches: columns by case-insensitive name, missing ones as nulls, days within the partition's limits."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    have = {n.lower(): n for n in rows.schema.names}
    test = None
    for limit, inside in ((partition.start, lambda c, x: c >= x), (partition.end, lambda c, x: c <= x)):
        if limit:
            own = inside(ds.field(have["ts"]), pa.scalar(limit))
            test = own if test is None else test & own
    kinds = {"date": pa.date32(), "double": pa.float64(), "string": pa.string()}
    wanted = [have[n.lower()] for n, _ in columns if n != "symbol" and n.lower() in have]
    for batch in rows.to_batches(columns=wanted or [have["ts"]], filter=test):
        made = []
        for name, kind in columns:
            if name == "symbol":
                made.append(pa.array([partition.symbol] * batch.num_rows, pa.string()))
            elif name.lower() in have:
                made.append(batch.column(wanted.index(have[name.lower()])).cast(kinds[kind]))
            else:
                made.append(pa.nulls(batch.num_rows, kinds[kind]))
        yield pa.RecordBatch.from_arrays(made, names=[n for n, _ in columns])


class LandedBars(DataSource):
    """``spark.dataSource.register(LandedBars)``, then ``spark.read.format("landed_bars")``; a schema of some of the columns reads only these."""

    @classmethod
    def name(cls) -> str:
        return "landed_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options, schema)


def land(bars: DataFrame, root: str, period: str, adjusted: bool = True) -> None:
    """Writes bars as ``landed`` finds them: a folder for each symbol, below period and kind."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").partitionBy("symbol").parquet(f"{root}/{period}/{KINDS[adjusted]}")


def landed(spark: SparkSession, root: str, symbols: Iterable[str], schema: str = SCHEMA, adjusted: bool = True, periods: Iterable[str] = ("10y", "max")) -> DataFrame:
    """Landed bars of some symbols; filters of day and symbol are pushed to the files."""
    spark.dataSource.register(LandedBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; only Python sources with pushFilters take part
    options = {"path": f"{root}/{{period}}/{{kind}}/symbol={{symbol}}", "symbols": ",".join(symbols), "periods": ",".join(periods), "adjusted": str(adjusted).lower()}
    return spark.read.format("landed_bars").schema(schema).options(**options).load()
