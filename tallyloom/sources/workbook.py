"""Workbooks: many ``.xlsx`` files to rows, one task per file.

Spark has no reader for the format, so a small worker unzips each file once and yields the wanted cells; selecting, typing
and everything after stays with Spark. A file that cannot be read to its end gives no rows but one that says why.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import field
from tallyloom.sources.delimited import FILE, RECORD

BATCH_ROWS = 10_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_FAULTS = (
    zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError, RuntimeError, NotImplementedError, TypeError,
)


class NoSheet(ValueError):
    """The workbook has no sheet of the name asked for."""


def read_workbooks(files: DataFrame, columns: list[str], sheet: str = "", header: bool = True, marked: bool = False) -> DataFrame:
    """The wanted columns of one sheet of every workbook in ``files`` (path, content).

    ``sheet`` names the sheet, else the first one is read. With ``header`` the first row names
    the columns, else the wanted columns are the first ones in order. A column that a workbook
    lacks is null. Cells come as text. ``marked`` adds ``FILE`` and ``RECORD`` and keeps a row, without cells, for every
    workbook that cannot be read, with the reason in ``RECORD``.
    """
    cells = "".join(f", c{i} string" for i in range(len(columns)))

    def wanted(rows: Iterator[list]) -> Iterator[list]:
        places = None if header else list(range(len(columns)))
        for row in rows:
            if places is None:
                places = _places(row, columns)
            else:
                yield [row[p] if 0 <= p < len(row) else None for p in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, sheet, wanted, [pa.string()] * len(columns))

    rows = files.select("path", "content").mapInArrow(run, f"path string, fault string, row bigint{cells}")
    named = [field(f"c{i}").alias(name) for i, name in enumerate(columns)]
    if marked:
        return rows.select(F.col("path").alias(FILE), F.col("fault").alias(RECORD), *named)
    return rows.where("fault IS NULL").select(*named)


def column_names(files: DataFrame, sheet: str = "", header: bool = True) -> list[str]:
    """Every column of one sheet of the workbooks, in the order in which they first stand.

    With ``header`` no more than the first row of a sheet is read. Without it columns are named by place, ``@1`` and on.
    """
    if not header:
        widest = workbook_cells(files, sheet).agg(F.max(F.size("cells"))).first()[0] or 0
        return [f"@{i + 1}" for i in range(widest)]
    named = workbook_cells(files, sheet, most=1).select(F.posexplode("cells").alias("pos", "name")).where("name <> ''")
    return [r["name"] for r in named.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").collect()]


def faulty_workbooks(files: DataFrame, sheet: str = "") -> DataFrame:
    """(path, reason) of the workbooks that cannot be read; they give no rows."""
    rows = read_workbooks(files, [], sheet, marked=True)
    return rows.where(F.col(RECORD).isNotNull()).select(F.col(FILE).alias("path"), F.col(RECORD).alias("reason"))


def workbook_cells(files: DataFrame, sheet: str = "", most: int | None = None) -> DataFrame:
    """Rows (path, row, cells) of one sheet of every workbook, cells as an array of text; at most the first ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first(rows: Iterator[list]) -> Iterator[list]:
            for i, row in enumerate(rows):
                if i == most:
                    return
                yield [row]

        return _batches(batches, sheet, first, [pa.list_(pa.string())])

    rows = files.select("path", "content").mapInArrow(run, "path string, fault string, row bigint, cells array<string>")
    return rows.where("fault IS NULL").drop("fault")


def _batches(
    batches: Iterator[pa.RecordBatch], sheet: str, pick: Callable[[Iterator[list]], Iterator[list]], types: list[pa.DataType]
) -> Iterator[pa.RecordBatch]:
    """Output batches of all workbooks. Those of one are held until its end has been read; a sheet has 1,048,576 rows at most."""
    names = ["path", "fault", "row", *(["cells"] if types == [pa.list_(pa.string())] else [f"c{i}" for i in range(len(types))])]

    def batch_of(path: str, start: int, rows: list[list], fault: str | None = None) -> pa.RecordBatch:
        n = 1 if fault else len(rows)
        columns = [[None] * n for _ in types] if fault or not rows else [list(c) for c in zip(*rows)]
        arrays = [pa.array([path] * n), pa.array([fault] * n, pa.string()), pa.array(range(start, start + n), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            path, held, rows, start = batch.column(0)[i].as_py(), [], [], 0
            try:
                for row in pick(_sheet_rows(batch.column(1)[i].as_py(), sheet)):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        held.append(batch_of(path, start, rows))
                        start, rows = start + len(rows), []
                if rows:
                    held.append(batch_of(path, start, rows))
            except _FAULTS as error:
                held = [batch_of(path, 0, [], f"{type(error).__name__}: {error}")]
            yield from held


def _places(labels: list, columns: list[str]) -> list[int]:
    exact = {label: i for i, label in reversed(list(enumerate(labels)))}
    folded = {(label or "").lower(): i for i, label in reversed(list(enumerate(labels)))}
    return [exact.get(c, folded.get(c.lower(), -1)) for c in columns]


def _nodes(stream, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one tag as they end; what has been handed out is let go, so memory stays that of one element."""
    events = ElementTree.iterparse(stream, ("start", "end"))
    open_nodes: list[ElementTree.Element] = []
    for event, node in events:
        if event == "start":
            open_nodes.append(node)
            continue
        open_nodes.pop()
        if node.tag == tag:
            yield node
            if open_nodes:
                open_nodes[-1].clear()


def _sheet_rows(content: bytes, sheet: str) -> Iterator[list]:
    """Rows of one sheet as lists of text, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part = _sheet_part(book, sheet)
        shared = _shared_strings(book)
        with book.open(part) as stream:
            for node in _nodes(stream, _MAIN + "row"):
                cells: list = []
                for cell in node.iter(_MAIN + "c"):
                    place = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (place + 1 - len(cells)))
                    cells[place] = _cell_text(cell, shared)
                yield cells


def _sheet_part(book: zipfile.ZipFile, sheet: str) -> str:
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")
    targets = {
        link.get("Id"): link.get("Target")
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    for entry in listed:
        if not sheet or entry.get("name") == sheet:
            target = targets[entry.get(_REL + "id")]
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise NoSheet(sheet)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as stream:
        return ["".join(t.text or "" for t in item.iter(_MAIN + "t")) for item in _nodes(stream, _MAIN + "si")]


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter.upper()) - ord("A") + 1
    return number - 1


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    value = cell.find(_MAIN + "v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return None if kind == "e" else value.text


__all__ = ["column_names", "faulty_workbooks", "read_workbooks", "workbook_cells"]
