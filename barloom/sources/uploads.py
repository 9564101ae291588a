"""Uploaded tables: CSV of unknown layout, column profiles, and time series made of them."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import NO_VALUE, date_of_text, number_of_text

#: The share of values that must parse.
SHARE = 0.8
SNIFFED_ROWS = 50
DELIMITERS = ",;\t|"
#: Fixed value: what a choice shows where nothing is chosen.
NOTHING = "(None)"


def sniffed(head: list[str]) -> str:
    """The delimiter that the header has and with which most lines have as many fields as it; of equal ones the first in DELIMITERS."""
    fields = lambda line, d: len(next(csv.reader([line], delimiter=d), []))
    agree = {d: sum(fields(line, d) == fields(head[0], d) for line in head) for d in DELIMITERS if fields(head[0], d) > 1}
    return max(agree, key=agree.get) if agree else DELIMITERS[0]


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """An upload as text columns, and what is observed as it is read: ``lines`` and, of these, ``left_out``.

    The delimiter of a CSV is sniffed from its first lines; lines with too many or too few fields are left out. Counts come from
    the pass that reads the rows: ``get`` waits for an action on the frame.
    """
    if not path:
        raise ValueError("no file")
    counts = Observation("upload")
    if path.lower().endswith(".xlsx"):
        from barloom.sources.workbook import read_workbook

        return read_workbook(spark, path).observe(counts, F.count(F.lit(1)).alias("lines"), F.lit(0).cast("long").alias("left_out")), counts
    if not path.lower().endswith(".csv"):
        raise ValueError(f"unsupported file type: {path}")
    head = [r[0] for r in spark.read.text(path).limit(SNIFFED_ROWS).collect()]
    if not head:
        raise ValueError("the file is empty")
    delimiter = sniffed(head)
    names = next(csv.reader([head[0]], delimiter=delimiter))
    schema = ", ".join(f"`{n}` string" for n in names) + ", _corrupt string"
    # whole lines are parsed whatever columns are asked for, as a line's number of fields says whether it stays
    raw = spark.read.option("columnPruning", "false").csv(path, header=True, sep=delimiter, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, escape='"')
    seen = raw.observe(counts, F.count(F.lit(1)).alias("lines"), F.count("_corrupt").alias("left_out"), F.count(F.col(f"`{names[0]}`")).alias("first_column"))
    return seen.filter("_corrupt IS NULL").drop("_corrupt"), counts


@dataclass(frozen=True)
class Counts:
    """What was lost on the way from an upload to a series; there once an action has run over the series."""

    before: Observation
    after: Observation
    columns: tuple[str, ...]

    def lost(self) -> dict[str, int]:
        """Of each column, how many values are no numbers; words for nothing aren't values."""
        return {c: self.before.get[f"lost_{k}"] for k, c in enumerate(self.columns)}

    def repeated(self) -> int:
        """Rows whose date an earlier row had."""
        return self.before.get["rows"] - self.after.get["days"]

    def check(self) -> None:
        """An error if a column has fewer than SHARE numbers among its values."""
        for k, c in enumerate(self.columns):
            given = self.before.get[f"given_{k}"]
            if given - self.before.get[f"lost_{k}"] < SHARE * given or not given:
                raise ValueError(f"not a numeric column: {c}")


def numeric_series(df: DataFrame, date: str, order: str, columns: Iterable[str]) -> tuple[DataFrame, Counts]:
    """``df`` with ``date`` parsed, ``columns`` as numbers and one row for each date (``time_series``), and counts from the same pass over the data."""
    names = tuple(columns)
    before, after = Observation("upload_values"), Observation("upload_days")
    tests = [(F.coalesce(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*NO_VALUE), F.lit(False)), number_of_text(F.col(f"`{c}`"))) for c in names]
    aggregates = [F.count(F.when(given, 1)).alias(f"given_{k}") for k, (given, _) in enumerate(tests)] + [F.count(F.when(given & number.isNull(), 1)).alias(f"lost_{k}") for k, (given, number) in enumerate(tests)]
    seen = df.observe(before, F.count(F.lit(1)).alias("rows"), *aggregates)
    series = time_series(seen.withColumns({c: number for c, (_, number) in zip(names, tests, strict=True)}), date, order)
    return series.observe(after, F.count(F.lit(1)).alias("days")), Counts(before, after, names)


def profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``column, date_share, number_share``: how many of each column's values parse as a date (of all rows) and as a number (of those not missing). One pass over all columns."""
    names = list(columns or df.columns)
    shares = [F.struct(F.lit(c).alias("column"), F.avg(date_of_text(F.col(f"`{c}`")).isNotNull().cast("double")).alias("date_share"), F.avg(F.when(F.col(f"`{c}`").isNotNull(), number_of_text(F.col(f"`{c}`")).isNotNull().cast("double"))).alias("number_share")) for c in names]
    return df.agg(F.array(*shares).alias("s")).select(F.inline("s"))


def numeric(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with columns as numbers, and a row for each column with its share of values that parse and how many were lost; fewer than SHARE is an error when that is read."""
    names = list(columns)
    found = profile(df, names)
    checked = found.select("column", F.when(F.col("number_share") >= SHARE, F.col("number_share")).otherwise(F.raise_error(F.concat(F.lit("not a numeric column: "), "column")).cast("double")).alias("number_share"))
    return df.withColumns({c: number_of_text(F.col(f"`{c}`")) for c in names}), checked


def time_series(df: DataFrame, date: str, order: str) -> DataFrame:
    """``df`` with ``date`` parsed, one row for each date: the first by ``order``. A date that doesn't parse raises an error when read."""
    parsed = F.coalesce(date_of_text(F.col(f"`{date}`")), F.raise_error(F.lit("a date doesn't parse")).cast("timestamp"))
    return first_per_date(df.withColumn("date", parsed), "date", order)


def first_per_date(df: DataFrame, date: str, order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(date).orderBy(order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def repeated_dates(df: DataFrame, date: str) -> DataFrame:
    """One row, ``repeated``: how many rows ``first_per_date`` leaves out."""
    return df.agg((F.count("*") - F.count_distinct(F.col(date))).alias("repeated"))


def joined(underlying: DataFrame, traded: DataFrame, benchmarks: dict[str, DataFrame] | None = None) -> DataFrame:
    """The tester's live dataset: days that both have, prices under prefixes; benchmarks join where they have a day. All sides are ``date, open, high, low, close``."""
    named = lambda df, p: df.select("date", *(F.col(c).alias(f"{p}_{c.title()}") for c in ("open", "high", "low", "close")))
    out = named(underlying, "Underlying").join(named(traded, "Traded"), "date")
    for name, b in (benchmarks or {}).items():
        out = out.join(b.select("date", F.col("close").alias(f"BMK_{name}_Close")), "date", "left")
    return out


def warm_start(df: DataFrame, columns: Iterable[str], date: str = "ts", key: str = "symbol") -> DataFrame:
    """``key, start``: the first date on which none of the columns is missing."""
    ready = F.lit(True)
    for c in columns:
        ready = ready & F.col(f"`{c}`").isNotNull()
    return df.groupBy(key).agg(F.min(F.when(ready, F.col(date))).alias("start"))


def as_records(df: DataFrame) -> DataFrame:
    """Rows as JSON text: dates as yyyy-MM-dd, missing values kept."""
    dated = [F.date_format(F.col(f"`{n}`"), "yyyy-MM-dd").alias(n) if t in ("date", "timestamp", "timestamp_ntz") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*dated), {"ignoreNullFields": "false"}).alias("record"))


#: Where a saved strategy keeps its rows, the first that has some.
SAVED_PARTS = ("full_input_table", "underlying_inputs")


def saved_tables(documents: DataFrame, name: str = "name", document: str = "document") -> DataFrame:
    """``name, row, values`` of every row saved with a strategy, in documents of whatever shape: ``values`` is a map of the columns that a row has, as text. Rows come from the first of SAVED_PARTS that has any; text that is no JSON has none."""
    parsed = documents.select(F.col(name).alias("name"), F.try_parse_json(F.col(document)).alias("_v"))
    rows = F.coalesce(*(F.when(F.size(part) > 0, part) for part in (F.try_variant_get("_v", f"$.{p}.data", "array<map<string,string>>") for p in SAVED_PARTS)))
    return parsed.select("name", F.posexplode(rows).alias("row", "values"))


def saved_rows(spark: SparkSession, path: str, *names: str | None) -> DataFrame:
    """The rows (``row``, a map) saved with the first of ``names`` that the store at ``path`` has: the one to be loaded, the one selected, the one loaded last. If it has none of them, or no rows, an error is raised when read."""
    wanted = [n for n in names if n and n != NOTHING]
    store = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("name", "_d"))
    order = F.array_position(F.array(*map(F.lit, wanted)).cast("array<string>"), F.col("name"))
    first = store.filter(order > 0).agg(F.min_by(F.struct("name", F.to_json("_d").alias("document")), order).alias("x"))  # one row
    known = F.when(F.col("x").isNotNull(), F.col("x.document")).otherwise(F.raise_error(F.lit("no such saved strategy")).cast("string"))
    one = first.select(F.coalesce(F.col("x.name"), F.lit("")).alias("name"), known.alias("document"))
    rows = saved_tables(one)
    none = one.join(rows.agg(F.count("*").alias("_n"))).select(F.when(F.col("_n") == 0, F.raise_error(F.lit("the saved strategy has no rows")).cast("map<string,string>")).alias("row"), F.col("document").alias("_d"))
    return rows.select(F.col("values").alias("row")).unionByName(none.filter("row IS NOT NULL AND _d IS NOT NULL").select("row"))
