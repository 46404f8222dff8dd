"""Workbooks (.xlsx) as rows of texts. Spark reads the files; a task takes the rows of a sheet out of one file after another."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from itertools import chain, count, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
# Formats of dates that a workbook doesn't define itself, and what doesn't count in those that it does.
DATE_FORMATS = (14, 15, 16, 17, 22)
NO_FORMAT = r'"[^"]*"|\[[^\]]*\]|\\.'
# Signs that XML lacks, and how the values of a type are written.
NO_SIGN = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
KINDS = {
    "bigint": r"^[+-]?\d+$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "boolean": "(?i)^(true|false)$",
    "date": r"^\d{4}-\d{1,2}-\d{1,2}$", "timestamp": r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$",
}
#: Rows that a task hands over at once.
ROWS = 5000
CELLS = "path string, row long, cells array<string>"


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def number_text(text: str, first_day: datetime | None) -> str:
    """A number in its shortest form; as a day counted from first_day, a date, or a date and a time to the second."""
    number = float(text)
    if first_day is not None:
        at = first_day + timedelta(seconds=round(number * 86400))
        return str(at) if at.time() != datetime.min.time() else str(at.date())
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


class Book:
    """The first sheet of a workbook, with what its cells refer to."""

    def __init__(self, content: bytes):
        self.parts = zipfile.ZipFile(io.BytesIO(content))
        book = self.part("xl/workbook.xml")
        settings = book.find(f"{MAIN}workbookPr")
        old = settings is not None and settings.get("date1904") in ("1", "true")
        self.first_day = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)
        link = book.find(f"{MAIN}sheets/{MAIN}sheet").get(f"{{{LINKS}}}id")
        self.sheet = next(posixpath.join("/xl", r.get("Target"))[1:] for r in self.part("xl/_rels/workbook.xml.rels") if r.get("Id") == link)
        self.shared = ["".join(t.text or "" for t in (*s.findall(f"{MAIN}t"), *s.findall(f"{MAIN}r/{MAIN}t"))) for s in self.part("xl/sharedStrings.xml")]
        styles = self.part("xl/styles.xml")
        dates = {str(f) for f in DATE_FORMATS} | {f.get("numFmtId") for f in styles.iter(f"{MAIN}numFmt") if re.search("[yd]", re.sub(NO_FORMAT, "", f.get("formatCode").lower()))}
        self.dated = {str(i) for i, x in enumerate(styles.findall(f"{MAIN}cellXfs/{MAIN}xf")) if x.get("numFmtId") in dates}

    def part(self, name: str):
        return ElementTree.fromstring(self.parts.read(name)) if name in self.parts.namelist() else ElementTree.Element("none")

    def value(self, cell) -> str | None:
        """The cell as a text; None where it is empty or an error."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in (*cell.findall(f"{MAIN}is/{MAIN}t"), *cell.findall(f"{MAIN}is/{MAIN}r/{MAIN}t")))
        text = cell.findtext(f"{MAIN}v")
        if not text or kind == "e":
            return "" if kind == "str" else None
        if kind == "s":
            return self.shared[int(text)]
        if kind == "b":
            return "true" if text == "1" else "false"
        return number_text(text, self.first_day if cell.get("s") in self.dated else None) if kind == "n" else text

    def rows(self) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of each row that the sheet states, in order."""
        place = 0
        with self.parts.open(self.sheet) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag == f"{MAIN}row":
                    place, cells = int(row.get("r", place + 1)), []
                    for cell in row.iter(f"{MAIN}c"):
                        at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at - len(cells)) + [self.value(cell)]
                    row.clear()
                    yield place, cells


def sheet_cells(files: DataFrame) -> DataFrame:
    """path, row (as the sheet numbers it) and cells, a text each, of the first sheet of every workbook in files (path, content).

    A task holds the contents that Spark deals it, spark.sql.files.maxPartitionBytes or one file, and the shared texts of
    one workbook; rows stream. A format limits a sheet to 1,048,576 rows, so no file grows with the data. A file that is
    no workbook is an error.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = Book(content.as_py()).rows()
                while part := list(islice(rows, ROWS)):
                    columns = [pa.array([path.as_py()] * len(part)), pa.array([r for r, _ in part], pa.int64()), pa.array([c for _, c in part], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "row", "cells"])

    return files.select("path", "content").mapInArrow(read, CELLS)


def column_names(cells: list[str | None]) -> list[str]:
    """Header cells as names: trimmed, an empty one by its place, a repeated one with how often it came before."""
    found: list[str] = []
    for at, cell in enumerate(cells):
        name = (cell or "").strip() or f"column_{at + 1}"
        found.append(next(n for n in chain([name], (f"{name}_{i}" for i in count(1))) if n not in found))
    return found


def read_sheet(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """SRC-01, SRC-02, SRC-12: the first sheet of one workbook, every column a text; rows without a cell go.

    The first row with a cell is the header. With ``place`` a column of that name has the row's number after the header.
    A sheet without rows is an error.
    """
    if not path.lower().endswith(".xlsx"):
        raise ValueError(f"not an .xlsx file: {path}")
    cells = sheet_cells(spark.read.format("binaryFile").load(path)).where(F.exists("cells", lambda c: F.length(c) > 0))
    head = cells.first()  # one file is one task, which hands its rows over in order
    if head is None:
        raise ValueError(f"no rows in {path}")
    names = column_names(head["cells"])
    numbered = [(F.col("row") - head["row"]).alias(place)] if place else []
    return cells.where(F.col("row") > head["row"]).select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)), *numbered)


def with_types(df: DataFrame) -> DataFrame:
    """SRC-03: columns of texts as the narrowest of long, double, boolean, date and timestamp that reads all their values; empty columns stay texts."""
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    fits = lambda c, k: F.bool_and(F.when(text(c).isNotNull(), text(c).rlike(KINDS[k]) & text(c).try_cast(k).isNotNull()))
    names = df.columns
    if not names:
        return df
    tested = df.agg(*(F.array(*(fits(c, k) for k in KINDS)).alias(f"_{i}") for i, c in enumerate(names))).first()
    found = [next((k for k, fit in zip(KINDS, tested[i], strict=True) if fit), None) for i in range(len(names))]
    return df.select(*((text(c).try_cast(k) if k else F.col(f"`{c}`")).alias(c) for c, k in zip(names, found, strict=True)))


def workbook(names: list[str], rows: Iterable[Iterable[object]]) -> bytes:
    """A workbook of one sheet: a header and rows of numbers and texts; signs that XML lacks become U+FFFD."""

    def cell(value: object) -> str:
        if value is None or value != value:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(NO_SIGN.sub(chr(0xFFFD), str(value)))}</t></is></c>'

    top, kind = '<?xml version="1.0" encoding="UTF-8"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as parts:
        parts.writestr("[Content_Types].xml", f'{top}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        for name, target, to in (("_rels/.rels", "xl/workbook.xml", "officeDocument"), ("xl/_rels/workbook.xml.rels", "worksheets/sheet1.xml", "worksheet")):
            parts.writestr(name, f'{top}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/{to}" Target="{target}"/></Relationships>')
        parts.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        with parts.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{top}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for row in (names, *rows):
                sheet.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame) -> DataFrame:
    """SNK-10 to SNK-12 as workbooks: path (a name) and content, one for each batch of rows that a task sees.

    A batch has spark.sql.execution.arrow.maxRecordsPerBatch rows at most (10,000 unless set), far below what a sheet holds. Numbers stay
    numbers, all else becomes text, null an empty cell.
    """
    names = df.columns

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            if batch.num_rows:
                content = workbook(names, zip(*(c.to_pylist() for c in batch.columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([f"{task:05d}-{at:05d}.xlsx"]), pa.array([content], pa.binary())], names=["path", "content"])

    return df.mapInArrow(write, "path string, content binary")
