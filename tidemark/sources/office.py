"""Office files (docx, xlsx, pptx) as elements, with the standard library's zip and XML readers, file by file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.chunking import ELEMENT

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _element(kind, text=None, level=None, header=None, rows=None) -> dict:
    return {"kind": kind, "level": level, "text": text, "header": header, "rows": rows}


def _docx(z: zipfile.ZipFile) -> Iterator[dict]:
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body"):
        if e.tag == f"{_W}p" and words(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.search(r"(?:Heading|标题)\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            yield _element("heading", words(e).strip(), min(6, max(1, int(m[1])))) if m else _element("paragraph", words(e).strip())
        elif e.tag == f"{_W}tbl":
            rows = [[words(c).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if rows:
                yield _element("table", header=rows[0], rows=rows[1:])


def _xlsx(z: zipfile.ZipFile) -> Iterator[dict]:
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]

    def value(c) -> str:
        v = c.find(f"{_S}v")
        if c.get("t") == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        raw = v.text or "" if v is not None else ""
        return shared[int(raw)] if c.get("t") == "s" and raw else raw

    for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
        rows = [[value(c) for c in r.iter(f"{_S}c")] for r in ElementTree.fromstring(z.read(name)).iter(f"{_S}row")]
        if rows:
            yield _element("table", header=rows[0], rows=rows[1:])


def _pptx(z: zipfile.ZipFile) -> Iterator[dict]:
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
        for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p"):
            text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
            if text:
                yield _element("paragraph", text)


_READERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


def parse(name: str, content: bytes) -> list[dict]:
    """The elements of a file; one that can't be read has none."""
    reader = _READERS.get(name.rsplit(".", 1)[-1].lower())
    try:
        return list(reader(zipfile.ZipFile(io.BytesIO(content)))) if reader else []
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError):
        return []


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, elements) of the office files in a folder; a file is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "elements": [parse(p, c) for p, c in zip(b["path"], b["content"], strict=True)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, elements array<{ELEMENT}>").where(F.size("elements") >= 0)
