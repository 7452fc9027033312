"""Files and file contents that Spark writes from the given tables, to be read back by queries."""

from __future__ import annotations

import base64
import io
import json
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.sources.app_files import handfuls
from workload.derive import read, spread

_CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="xml" ContentType="application/xml"/></Types>'
)
_WORKBOOK = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="Cover" sheetId="1" r:id="rId1"/><sheet name="Data" sheetId="2" r:id="rId2"/>'
    "</sheets></workbook>"
)
_LINKS = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>'
)
_SHEET = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
)


def _cell(column: int, row: int, value) -> str:
    place = f'{chr(ord("A") + column)}{row}'
    if value is None:
        return ""
    if isinstance(value, str):
        return f'<c r="{place}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{place}"><v>{value!r}</v></c>'


def workbook(rows: list[list]) -> bytes:
    """A small workbook of two sheets; the rows stand on the second, named ``Data``."""
    lines = "".join(
        f'<row r="{r}">{"".join(_cell(c, r, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _CONTENT_TYPES)
        book.writestr("xl/workbook.xml", _WORKBOOK)
        book.writestr("xl/_rels/workbook.xml.rels", _LINKS)
        book.writestr("xl/worksheets/sheet1.xml", _SHEET.format(""))
        book.writestr("xl/worksheets/sheet2.xml", _SHEET.format(lines))
    return out.getvalue()


def party_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): customers as workbooks, one per batch of rows."""
    customer = read(spark, sf_dir, "customer")

    def books(batches):
        for batch in batches:
            header = ["Customer Key", "Name", "Balance", "Segment"]
            table = batch[["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]].astype(object).values.tolist()
            yield pd.DataFrame({"path": [f"from-{table[0][0]}.xlsx"], "content": [workbook([header, *table])]})

    return customer.mapInPandas(books, "path string, content binary")


def written_files(files: DataFrame, path: str) -> str:
    """Each ``content`` as a file of its own below ``path``, with one line end behind it."""
    files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def document_app_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): an app file for every document.

    It holds a framed header, the whole text as a script object in a compressed stream, a
    compressed stream that is no text, and the whole text again in base64.
    """

    def files(batches):
        for batch in batches:
            for few in handfuls(batch, "text"):
                rows = zip(*(few.column(c).to_pylist() for c in ("doc_id", "lang", "source", "text")))
                content = pa.array([app_file(*row) for row in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), content], ["doc_id", "content"])
        pa.default_memory_pool().release_unused()

    columns = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return columns.mapInArrow(files, "doc_id bigint, content binary")


def app_file(doc_id: int, lang: str, source: str, text: str | None) -> bytes:
    frame = b"\x01\x00\x00\x00"
    header = f'{{"{fixed.HEADER_KEY}":"1.{doc_id}",'.encode() + frame + f'"buildno":"{lang}"}}'.encode()
    script = zlib.compress(json.dumps({"qScript": text}).encode() + b"\x00", (1, 6, 9)[len(text or "") % 3])
    sheet = zlib.compress(json.dumps({"qMetaData": {"qType": "sheet"}, "qRoot": {}}).encode())
    hidden = base64.b64encode(json.dumps({"source": source, "text": text}).encode()).decode()
    coded = f'{{"{fixed.BASE64_KEY}":"{hidden}"}}'.encode()
    binary = zlib.compress(b"\xff\xfe\xfd" * 20)
    return b"\x00\x02".join([header, script, binary, coded, sheet, b"\x78\x9c broken"])


def written(df: DataFrame, path: str, fmt: str, **options) -> str:
    df.write.format(fmt).options(**options).save(path)
    return path


def written_lines(lines: DataFrame, header: str, path: str) -> str:
    """Lines as they are, below a header in every file."""
    lines.toDF(header).write.options(header=True, sep="\u0001", quote="\u0000", escape="\u0000").csv(path)
    return path


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select(*[F.col(c).cast("string") for c in df.columns])
