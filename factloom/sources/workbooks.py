"""XLSX workbooks, one per task. A sheet has at most 1,048,576 rows by format."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.delimited import drop_blank_rows
from factloom.sources.headers import NO_HEADER, NO_ROWS, ParseError, normalize_columns

# The message shown to the user and names of the file format.
BROKEN = "This Excel file couldn't be read. Save it as .xlsx and try again."
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # built-in number formats that show a date or time
CELLS = "path string, row int, cells array<string>, error string"
BATCH = 20_000


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == sheet.get(f"{REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {}
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        custom[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code, re.IGNORECASE))
    formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return [i in DATE_FORMATS or custom.get(i, False) for i in ids]


def _text(cell: ElementTree.Element, shared: list[str], dates: list[bool]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind != "n":
        return value
    style = int(cell.get("s", 0))
    number = float(value)
    if style < len(dates) and dates[style]:
        stamp = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)
        return (stamp + datetime.timedelta(microseconds=500)).strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number.is_integer() and abs(number) < 2**53 else repr(number)


def _column(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - 64
    return index - 1


def _rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]
        dates = _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            events = ElementTree.iterparse(sheet, ("start", "end"))
            _, top = next(events)
            for event, element in events:
                if event == "end" and element.tag == f"{MAIN}row":
                    cells: list[str | None] = []
                    for i, cell in enumerate(element.iter(f"{MAIN}c")):
                        at = _column(cell.get("r")) if cell.get("r") else i
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = _text(cell, shared, dates)
                    yield cells
                    # The emptied row would stay in the tree under its parent.
                    element.clear()
                    for part in top:
                        if part.tag == f"{MAIN}sheetData":
                            part.clear()


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            columns = ["path", "row", "cells", "error"]
            try:
                # Read to the end first: a workbook damaged anywhere gives no row at all.
                for _ in _rows(content):
                    pass
            except Exception:  # any damage to the file is the user's message
                yield pd.DataFrame([(path, -1, None, BROKEN)], columns=columns)
                continue
            held = []
            for i, cells in enumerate(_rows(content)):
                held.append((path, i, cells, None))
                if len(held) == BATCH:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            yield pd.DataFrame(held, columns=columns)


def read_xlsx_folder(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, row, cells, error)`` of the first sheet of every workbook."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    rows = files.mapInPandas(_decode, CELLS)
    midnight = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) 00:00:00$"
    return rows.withColumn("cells", F.transform("cells", lambda c: F.regexp_replace(c, midnight, "$1")))


def read_xlsx_strings(spark: SparkSession, path: str) -> DataFrame:
    """One workbook as an all-string table with normalised names."""
    rows = read_xlsx_folder(spark, path)
    head = rows.filter(F.col("row") <= 0).select("cells", "error").first()
    if head is not None and head["error"]:
        raise ParseError(head["error"])
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    cells = (list(head["cells"]) if head else []) + [None] * ((width or 0) - len(head["cells"] if head else []))
    if not any((c or "").strip() for c in cells):
        raise ParseError(NO_HEADER)
    body = rows.filter(F.col("row") > 0).select(*(F.get("cells", F.lit(i)).alias(f"_{i}") for i in range(len(cells))))
    body = drop_blank_rows(body)
    if body.isEmpty():
        raise ParseError(NO_ROWS)
    return normalize_columns(body, cells)
