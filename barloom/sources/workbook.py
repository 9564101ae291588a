"""Sheets of XLSX workbooks, read by tasks as a stream of the sheet's XML: a data source without any spreadsheet library.

A workbook is a zip of XML. A partition reads the rows of a range of the first sheet (or a named one); the sheet is one compressed
stream, so each passes over the rows before its own, but none holds more than its batch and the workbook's shared strings.
Cells are text: numbers as they are stored, dates (by their cell's format) as ISO days or times, booleans as TRUE and FALSE, missing cells null. The first row has the
names; a name that is missing or repeated gets the column's number.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed values of the format: the built-in number formats that are dates, and the day that serial numbers count from.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
ORIGIN = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}
ROWS, BATCH = 50_000, 2_000


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _stream(archive: zipfile.ZipFile, name: str, wanted: str) -> Iterator:
    """The elements of one kind, each forgotten once it's been looked at."""
    with archive.open(name) as raw:
        events = ElementTree.iterparse(raw, ("start", "end"))
        _, root = next(events)
        inner = root
        for event, element in events:
            if event == "start" and _tag(element) in ("sheetData", "sst"):
                inner = element
            if event == "end" and _tag(element) == wanted:
                yield element
                inner.clear()
                root.clear()


def _text(element) -> str:
    """All runs of a string, without how it is read aloud."""
    out = []
    for child in element:
        if _tag(child) == "t":
            out.append(child.text or "")
        elif _tag(child) == "r":
            out += [t.text or "" for t in child if _tag(t) == "t"]
    return "".join(out)


class Workbook:
    def __init__(self, path: str, sheet: str | None = None):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.archive = zipfile.ZipFile(where.open_input_file(inner))
        read = lambda name: ElementTree.fromstring(self.archive.read(name))
        names, book = set(self.archive.namelist()), read("xl/workbook.xml")
        sheets = [(s.get("name"), next(v for k, v in s.attrib.items() if k.endswith("}id"))) for s in book.iter() if _tag(s) == "sheet"]
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        found = [i for n, i in sheets if sheet in (None, n)]
        if not found:
            raise ValueError(f"no such sheet: {sheet}")
        target = targets[found[0]]
        self.sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.origin = ORIGIN[any(p.get("date1904") in ("1", "true") for p in book.iter() if _tag(p) == "workbookPr")]
        self.dates = self._date_styles(read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        self.shared = [_text(e) for e in _stream(self.archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []

    @staticmethod
    def _date_styles(styles) -> set[int]:
        """Numbers of the cell styles that show dates."""
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter() if _tag(f) == "numFmt"}
        dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[dmyhs]", code, re.I)}
        cells = next((e for e in styles.iter() if _tag(e) == "cellXfs"), ())
        return {k for k, x in enumerate(cells) if int(x.get("numFmtId", 0)) in dated}

    def _value(self, cell) -> str | None:
        kind, inner = cell.get("t", "n"), {_tag(x): x for x in cell}
        if kind == "inlineStr":
            return _text(inner["is"]) if "is" in inner else None
        text = inner["v"].text if "v" in inner else None
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(text)]
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            time = self.origin + dt.timedelta(seconds=round(float(text) * 86_400))
            return time.strftime("%Y-%m-%d" if time.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
        return text

    def rows(self) -> Iterator[dict[int, str]]:
        """Values by column of each row that the sheet has."""
        for row in _stream(self.archive, self.sheet, "row"):
            values, at = {}, -1
            for cell in row:
                letters = re.match("[A-Z]+", cell.get("r", ""))
                at = _number(letters[0]) if letters else at + 1
                if (value := self._value(cell)) is not None:
                    values[at] = value
            yield values

    def size(self) -> int:
        return sum(1 for _ in _stream(self.archive, self.sheet, "row"))


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def columns(book: Workbook) -> list[tuple[int, str]]:
    head, seen = next(book.rows(), {}), set()
    out = []
    for k in range(max(head, default=-1) + 1):
        name = head.get(k, "").strip()
        name = name if name and name not in seen else f"column_{k + 1}"
        seen.add(name)
        out.append((k, name))
    return out


@dataclass
class Range(InputPartition):
    first: int
    past: int | None


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.sheet, self.names = options["path"], options.get("sheet"), schema.names
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[Range]:
        size = Workbook(self.path, self.sheet).size()
        edges = [*range(1, max(size, 2), self.rows), None]
        return [Range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        book = Workbook(self.path, self.sheet)
        place = {name: k for k, name in columns(book)}
        held: list[dict[int, str]] = []
        batch = lambda: pa.table({n: pa.array([r.get(place[n]) for r in held], pa.string()) for n in self.names}).to_batches()
        for k, row in enumerate(book.rows()):
            if partition.past is not None and k >= partition.past:
                break
            if k >= partition.first and row:
                held.append(row)
                if len(held) == BATCH:
                    yield from batch()
                    held = []
        if held:
            yield from batch()


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("path", ...)``; options ``sheet`` and ``rows`` (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for _, n in columns(Workbook(self.options["path"], self.options.get("sheet")))])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options, schema)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    options = {"path": path, "rows": str(rows)} | ({"sheet": sheet} if sheet else {})
    return spark.read.format("workbook").options(**options).load()
