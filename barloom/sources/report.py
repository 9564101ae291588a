"""A run's report as one CSV file: headline, yearly results and trades under each other, written by a data source sink.

Tasks write their lines beside the file, under names of their own; the commit puts them together in order and then moves the whole to
its place, so a reader sees a whole report or none. An abort takes the tasks' lines away; a task that runs twice has two names, of which the commit takes one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What stands before the second and the third table.
TITLES = {"headline": None, "yearly": "Yearly Results (Strategy)", "trades": "Executed Transactions"}


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: tuple | None


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.folder = path, f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[Row]) -> Part:
        """Lines of one task, which come in order."""
        where, folder = _files(self.folder)
        where.create_dir(folder, recursive=True)
        path, first = f"{folder}/{uuid.uuid4().hex}", None
        with where.open_output_stream(path) as out:
            for row in iterator:
                first = first or (row["section"], row["place"])
                out.write(row["line"].encode() + b"\n")
        return Part(path, first)

    def commit(self, messages: list[Part | None]) -> None:
        where, folder = _files(self.folder)
        where.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with where.open_output_stream(whole) as out:
            for part in sorted((m for m in messages if m and m.first), key=lambda m: m.first):
                with where.open_input_stream(part.path) as lines:
                    while some := lines.read(1 << 20):
                        out.write(some)
        where.move(whole, _files(self.path)[1])
        where.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        where, folder = _files(self.folder)
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)


class ReportSink(DataSource):
    """``spark.dataSource.register(ReportSink)``; takes ``section int, place long, line string``, sorted, and the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "report_csv"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])


def csv_field(name: str, kind: str) -> Column:
    """A field as CSV has it: doubles with two places, nothing where there is none, quotes where a text needs them."""
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        text = F.format_string("%.2f", F.bround(c, 2))
    else:
        plain = c.cast("string")
        text = F.when(plain.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)
    return F.when(c.isNull(), "").otherwise(text)


def lines(df: DataFrame, section: int, order: list[str], title: str | None) -> DataFrame:
    """A table as ``section, place, line``: its title after an empty line, its header, and its rows by ``order``."""
    from pyspark.sql.window import Window

    rows = df.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), F.concat_ws(",", *(csv_field(n, t) for n, t in df.dtypes)).alias("line"))
    head = [*([(-2, ""), (-1, title)] if title else []), (0, ",".join(df.columns))]
    above = df.sparkSession.createDataFrame(head, "place long, line string")
    return above.unionByName(rows).select(F.lit(section).alias("section"), "place", "line")


def report(headline: DataFrame, yearly: DataFrame, trades: DataFrame) -> DataFrame:
    """The report's lines, in order. Each table has a row for a series, a year or a trade of one run, so one task numbers it; trades only if there are any."""
    tables = [(headline, "headline", headline.columns[:1]), (yearly, "yearly", yearly.columns[:2]), (trades, "trades", ["date"])]
    found = None
    for section, (df, name, order) in enumerate(tables):
        own = lines(df, section, order, TITLES[name])
        if name == "trades":
            some = df.agg((F.count("*") > 0).alias("_some"))  # one row
            own = own.join(F.broadcast(some)).filter("_some").drop("_some")
        found = own if found is None else found.unionByName(own)
    return found


def write_report(headline: DataFrame, yearly: DataFrame, trades: DataFrame, path: str) -> None:
    """One CSV file at ``path``, whole or not at all."""
    spark = headline.sparkSession
    spark.dataSource.register(ReportSink)
    report(headline, yearly, trades).repartitionByRange("section", "place").sortWithinPartitions("section", "place").write.format("report_csv").option("path", path).mode("append").save()
