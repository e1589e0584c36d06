"""Sheets of xlsx files as typed rows."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates and times (fixed values), and what makes one's own format such.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_DATE_CODE = re.compile(r"[ymdhs]", re.IGNORECASE)
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')
_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%S")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


class Book:
    """A workbook: names of its sheets, and their rows, read one after the other."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        root = lambda name: ElementTree.fromstring(self.zip.read(name)) if name in names else ElementTree.Element("none")
        self.shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in root("xl/sharedStrings.xml").iter(f"{_S}si")]
        styles, book = root("xl/styles.xml"), root("xl/workbook.xml")
        own = {int(f.get("numFmtId")): _QUOTED.sub("", f.get("formatCode", "")) for f in styles.iter(f"{_S}numFmt")}
        formats = [int(x.get("numFmtId", 0)) for x in styles.iterfind(f"{_S}cellXfs/{_S}xf")]
        self.dated = [f in _DATES or bool(_DATE_CODE.search(own.get(f, ""))) for f in formats]
        setting = book.find(f"{_S}workbookPr")
        late = setting is not None and setting.get("date1904") in ("1", "true")
        self.zero = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
        links = {r.get("Id"): r.get("Target", "") for r in root("xl/_rels/workbook.xml.rels")}
        self.sheets: dict[str, str] = {}
        for s in book.iter(f"{_S}sheet"):
            target = links.get(s.get(f"{_R}id"), "")
            self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, object]]]:
        """Row number and cells by column: text, bool, float, or a datetime where the format shows one; blank cells are left out."""
        last = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, e in ElementTree.iterparse(f):  # a row at a time
                if e.tag != f"{_S}row":
                    continue
                last = int(e.get("r", last + 1))
                cells, at = {}, -1
                for c in e.iterfind(f"{_S}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    value = self._value(c)
                    if value is not None and value != "":
                        cells[at] = value
                yield last, cells
                e.clear()

    def _value(self, c):
        kind, v = c.get("t", "n"), c.find(f"{_S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind != "n":
            return v.text
        style = int(c.get("s", 0))
        number = float(v.text)
        if style < len(self.dated) and self.dated[style]:
            return self.zero + dt.timedelta(microseconds=round(number * 86_400_000) * 1000)
        return number


def convert(value, kind: T.DataType):
    """A cell as the type; raises ValueError if it can't be."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        if isinstance(value, float):
            return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
        return str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(value, str):
        value = value.strip()
        if value == "":
            return None
    if isinstance(kind, T.BooleanType):
        known = {True: True, False: False, 1.0: True, 0.0: False, "true": True, "false": False, "1": True, "0": False}
        value = value.lower() if isinstance(value, str) else value
        if value not in known:
            raise ValueError(value)
        return known[value]
    if isinstance(kind, (T.DateType, T.TimestampType)):
        if isinstance(value, str):
            for form in _FORMATS:
                try:
                    value = dt.datetime.strptime(value, form)
                    break
                except ValueError:
                    continue
        if not isinstance(value, dt.datetime):
            raise ValueError(value)
        return value.date() if isinstance(kind, T.DateType) else value
    if isinstance(value, (dt.datetime, bool)):
        raise ValueError(value)
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        raise ValueError(value) from None
    if not number.is_finite():
        raise ValueError(value)
    if isinstance(kind, T.DecimalType):
        return number
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(number)
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
    if number != number.to_integral_value() or not -(1 << bits - 1) <= number < 1 << bits - 1:
        raise ValueError(value)
    return int(number)


def read_sheets(spark: SparkSession, path: str, schema: str | T.StructType, sheet: str | None = None, head: int = 1) -> DataFrame:
    """path, sheet, row, the schema's columns, and bad: rows of the sheet (the first, if none is named) of each xlsx file.

    Columns are found by their titles in row ``head``; only those in the schema are read, one that a
    sheet lacks is null.  A cell that is not of its type is null, and its title is in bad.  Rows without
    a cell are left out.  Dates come from numbers whose format shows a date, or from text such as
    2024-01-31; blanks are null.  A file that is no workbook, or has no such sheet, is one row with
    a null row number and bad = [*].  Files are read by Spark, one in each task's turn, whole.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.IntegerType()), *wanted.fields, T.StructField("bad", T.ArrayType(T.StringType()))])
    names = out.names

    def rows_of(name: str, content: bytes) -> Iterator[tuple]:
        nothing = [None] * len(wanted.fields)
        try:
            book = Book(content)
            title = sheet if sheet is not None else next(iter(book.sheets), None)
            rows = book.rows(title)
            columns: dict[str, int] = {}
            for number, cells in rows:
                if number < head:
                    continue
                if number == head:
                    for at, text in sorted(cells.items()):
                        columns.setdefault(str(text).strip(), at)
                    continue
                if not cells:
                    continue
                values, bad = [], []
                for f in wanted.fields:
                    try:
                        values.append(convert(cells.get(columns.get(f.name, -1)), f.dataType))
                    except ValueError:
                        values.append(None)
                        bad.append(f.name)
                yield (name, title, number, *values, bad)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
            yield (name, sheet, None, *nothing, ["*"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: list[tuple] = []
            for name, content in zip(b["path"], b["content"], strict=True):
                for row in rows_of(name, content):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield _frame(held, names)
                        held = []
            if held:
                yield _frame(held, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, out)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})
