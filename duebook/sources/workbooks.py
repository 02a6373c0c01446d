"""XLSX workbooks: zipped XML, read row by row with typed cells as text. Spark's scan gives the bytes, so any store will do."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spread import spread

#: Fixed values of the format: built-in numbers of date formats, and the day before day 1 of dates.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_ZERO = datetime.datetime(1899, 12, 30)
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a part by its local name; what was read is let go."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        for _, e in ElementTree.iterparse(part):
            if _local(e.tag) == tag:
                yield e
                e.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of a string with its runs, without readings for pronunciation."""
    if _local(e.tag) == "rPh":
        return ""
    return (e.text or "" if _local(e.tag) == "t" else "") + "".join(_text(c) for c in e)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    own = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in _elements(book, "xl/styles.xml", "numFmt")}
    dated = {k for k, code in own.items() if re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code), re.I)} | (DATE_FORMATS - set(own))
    for styles in _elements(book, "xl/styles.xml", "cellXfs"):
        return {k for k, e in enumerate(styles) if int(e.get("numFmtId") or 0) in dated}
    return set()


def _active_sheet(book: zipfile.ZipFile) -> str:
    places = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    active = next((int(e.get("activeTab") or 0) for e in _elements(book, "xl/workbook.xml", "workbookView")), 0)
    ids = [e.get(_RELATION) for e in _elements(book, "xl/workbook.xml", "sheet")]
    target = places[ids[min(active, len(ids) - 1)]]
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def cell_text(kind: str, raw: str, dated: bool) -> str:
    """A typed value as text: whole numbers without a point, dates with their time, true and false by name."""
    if kind == "b":
        return str(raw.strip() == "1")
    if kind not in ("n", ""):
        return raw.strip()
    if not raw.strip():
        return ""
    value = float(raw)
    if dated and value >= 1:
        return str(DAY_ZERO + datetime.timedelta(milliseconds=round(value * 86_400_000)))
    return str(int(value)) if value.is_integer() else str(value)


def _column(reference: str) -> int:
    k = 0
    for c in re.match("[A-Z]+", reference).group():
        k = 26 * k + ord(c) - 64
    return k - 1


def rows_of(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells as text) of the active sheet's rows that hold anything."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dated = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")], _date_styles(book)
        number = 0
        for row in _elements(book, _active_sheet(book), "row"):
            number = int(row.get("r") or number + 1)
            cells: list[str] = []
            for c in row:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                kind, value = c.get("t") or "n", next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                if kind == "inlineStr":
                    value = "".join(_text(v) for v in c)
                elif kind == "s":
                    kind, value = "str", shared[int(value)]
                cells[at] = cell_text(kind, value, int(c.get("s") or 0) in dated)
            if any(cells):
                yield number, cells


_ROWS = "path string, row_number long, cells array<string>, problem string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["path", "row_number", "cells", "problem"], [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held: list[tuple] = []
            try:
                for number, cells in rows_of(content or b""):
                    held.append((path, number, cells, None))
                    if len(held) >= 4096:
                        yield batch_of(held)
                        held = []
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
                held.append((path, None, None, "unreadable workbook"))
            yield batch_of(held)


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, row_number, cells, problem) of workbooks (path, content); a file that can't be read, or not to its end, has a row with ``problem``.

    A task holds as many files at once as spark.sql.execution.arrow.maxRecordsPerBatch allows.
    """
    return spread(files.select("path", "content")).mapInArrow(_read, _ROWS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all .xlsx files under ``path``; a task reads whole files, so their number spreads the work."""
    return workbook_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path))


def with_headers(rows: DataFrame, headers: dict[str, tuple[str, ...]]) -> DataFrame:
    """(path, row_number, fields...) of the rows below each file's first one, whose texts name the columns; the first alias in order wins."""
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), "(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+", "_"), "^_|_$", "")
    # the first row goes along with the others, so that no file is read twice
    so_far = Window.partitionBy("path").orderBy("row_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = rows.filter("problem IS NULL").withColumns({"head": F.first("cells").over(so_far), "top": F.first("row_number").over(so_far)}).filter("row_number > top")
    below = below.withColumn("head", F.transform("head", key))
    place = lambda aliases: F.coalesce(*(F.nullif(F.array_position("head", a), F.lit(0)) for a in aliases))
    return below.select("path", "row_number", *(F.trim(F.get("cells", (place(aliases) - 1).cast("int"))).alias(f) for f, aliases in headers.items()))
