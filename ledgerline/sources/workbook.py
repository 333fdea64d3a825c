"""Spreadsheet workbooks as a Spark data source, by the zip and XML readers of the standard library.

`spark.read.format("workbook").load(path)` gives one row a sheet row: sheet, row (from 1), cells (array of text); each
sheet of each workbook is a partition, and a sheet's XML is read as a stream, row by row. Shared strings, inline
strings, booleans, errors, cached formula results and dates by number format are read; sheets without a cell are one
row without cells, so that no sheet is lost unseen. Files are found on a folder that all executors share.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .delimited import HEAD_ROWS, header_row, unique_names

# The file format's name spaces and its built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 22}


def _local(path: str) -> Path:
    return Path(unquote(urlparse(path).path) if path.startswith("file:") else path)


def _column(ref: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _texts(node: ET.Element) -> str:
    """All runs of a string; phonetic hints are none."""
    return "".join(t.text or "" for r in (node, *node.findall(f"{MAIN}r")) for t in r.findall(f"{MAIN}t"))


class Book:
    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(_local(path))
        self.names = set(self.zip.namelist())

    def sheets(self) -> list[tuple[str, str]]:
        """(name, part) of the worksheets in order."""
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        out = []
        for s in book.iter(f"{MAIN}sheet"):
            target = links.get(s.get(LINK), "")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if part in self.names and "worksheets" in part:
                out.append((s.get("name"), part))
        return out

    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.names:
            return []
        return [_texts(si) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]

    def dated(self) -> tuple[set[int], datetime]:
        """Styles whose numbers are dates, and the day that numbers count from."""
        styles: set[int] = set()
        if "xl/styles.xml" in self.names:
            root = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search("[ymd]", re.sub(r'"[^"]*"|\\.|\[[^]]*\]', "", f.get("formatCode", "")).lower())}
            xfs = root.find(f"{MAIN}cellXfs")
            styles = {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        props = ET.fromstring(self.zip.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        since_1904 = props is not None and props.get("date1904") in ("1", "true")
        return styles, datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        strings, (dates, origin) = self.strings(), self.dated()
        with self.zip.open(part) as f:
            number = 0
            for _, row in ET.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self.value(cell, strings, dates, origin)
                row.clear()
                yield number, cells

    @staticmethod
    def value(cell: ET.Element, strings: list[str], dates: set[int], origin: datetime) -> str | None:
        kind, v = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{MAIN}is")
            return None if inline is None else _texts(inline)
        if v is None:
            return None
        if kind == "s":
            return strings[int(v)]
        if kind == "b":
            return "true" if v == "1" else "false"
        if kind == "n" and int(cell.get("s", 0)) in dates:
            day = origin + timedelta(seconds=round(float(v) * 86_400))
            return day.date().isoformat() if day.time() == datetime.min.time() else day.isoformat(sep=" ")
        if kind == "n" and re.fullmatch(r"-?\d+\.0+", v):
            return v.split(".")[0]
        return v


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str, part: str):
        self.path, self.sheet, self.part = path, sheet, part


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = _local(options["path"])
        self.paths = sorted(str(p) for p in path.glob("*.xlsx")) if path.is_dir() else [str(path)]

    def partitions(self) -> list[InputPartition]:
        """One a sheet; workbooks without any have none."""
        return [SheetPartition(p, name, part) for p in self.paths for name, part in Book(p).sheets()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, SheetPartition):
            return
        some = False
        for number, cells in Book(partition.path).rows(partition.part):
            some = True
            yield partition.path, partition.sheet, number, cells
        if not some:
            yield partition.path, partition.sheet, 0, []


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row long, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(dict(self.options))


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells of a workbook or a folder of workbooks; an empty sheet is one row 0 without cells."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").load(path)


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A frame of text for each sheet of a workbook (not a folder), named by its header row; rows without a filled cell and
    what stands above the header are left out. A sheet without rows has no frame."""
    rows = sheet_rows(spark, path)
    shapes = rows.groupBy("sheet").agg(F.max(F.size("cells")).alias("width")).collect()  # one row a sheet
    out = {}
    for name, width in sorted((s.sheet, s.width) for s in shapes if s.width > 0):
        own = rows.filter((F.col("sheet") == name) & F.exists("cells", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
        head = [(r.row, r.cells + [None] * (width - len(r.cells))) for r in own.orderBy("row").limit(HEAD_ROWS).collect()]
        if not head:
            continue
        at = header_row([cells for _, cells in head])
        names = unique_names(head[at][1])
        out[name] = own.filter(F.col("row") > head[at][0]).select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return out
