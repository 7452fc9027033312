"""App files: binary containers whose compressed streams hold JSON objects.

Only the inflating runs in a Python worker, one file at a time, and it yields raw text; what
the text means is told by column expressions in ``operators.catalog``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions.columns import field
from tallyloom.operators.catalog import json_value

#: Bytes of values that a worker takes, and characters that it gives, at once, unless one value has more.
TAKEN, GIVEN = 1 << 22, 1 << 22
BLOBS = "offset bigint, n_bytes bigint, text string"


def read_app_files(spark: SparkSession, path: str, suffix: str = fixed.APP_FILE_SUFFIX) -> DataFrame:
    """App files below a folder: path and content, one row per file."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{suffix}")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )


def inflate(files: DataFrame, app: str, content: str = "content", max_stream_bytes: int | None = None) -> DataFrame:
    """Every compressed stream of every file: ``app``, its offset, size and text.

    The text is null where the stream is not UTF-8. ``max_stream_bytes`` bounds the compressed
    bytes read from one offset; by default a stream is read to its end.
    """
    kind = files.schema[app].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in handfuls(batch, "content"):
                yield from _streams(few, max_stream_bytes)
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for later tasks

    named = files.select(field(app).alias("app"), field(content).alias("content"))
    return named.mapInArrow(work, f"app {kind}, {BLOBS}")


def handfuls(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a few at a time: their values of ``column`` are bounded in sum, however many rows a batch has."""
    first = size = 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + n > TAKEN:
            yield batch.slice(first, at - first)
            first, size = at, 0
        size += n + 1
    if first < batch.num_rows:
        yield batch.slice(first)


def _streams(files: pa.RecordBatch, limit: int | None) -> Iterator[pa.RecordBatch]:
    kinds = [files.schema.field("app").type, pa.int64(), pa.int64(), pa.string()]

    def given(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["app", "offset", "n_bytes", "text"])

    held, size = [], 0
    for name, data in zip(files.column("app").to_pylist(), files.column("content")):
        data = data.as_py()
        for offset in _magic_offsets(data):
            plain = _inflate_at(data, offset, limit)
            if plain is None:
                continue
            held.append((name, offset, len(plain), _text(plain)))
            size += len(plain)
            if size >= GIVEN:
                yield given(held)
                held, size = [], 0
    if held:
        yield given(held)


def _magic_offsets(data: bytes) -> list[int]:
    found = []
    at = data.find(b"\x78")
    while at >= 0:
        if data[at : at + 2] in fixed.ZLIB_MAGICS:
            found.append(at)
        at = data.find(b"\x78", at + 1)
    return found


def _inflate_at(data: bytes, offset: int, limit: int | None) -> bytes | None:
    end = len(data) if limit is None else min(len(data), offset + limit)
    for bits in fixed.INFLATE_WINDOW_BITS:
        try:
            return b"".join(_pieces(memoryview(data), offset, end, zlib.decompressobj(bits)))
        except zlib.error:
            continue
    return None


def _pieces(data: memoryview, start: int, end: int, stream) -> Iterator[bytes]:
    """The plain bytes of one stream. Fed piece by piece, because the decoder copies all input
    that follows a stream, which for a large file would be most of it, again and again."""
    step = 1 << 12
    while start < end and not stream.eof:
        yield stream.decompress(data[start : min(start + step, end)])
        start += step
        step = min(step * 2, 1 << 20)


def _text(plain: bytes) -> str | None:
    try:
        return plain.decode("utf-8").rstrip("\x00")
    except UnicodeDecodeError:
        return None


def _unframed(content):
    """The bytes as one character each, framing removed, so that text patterns can search them."""
    framing = fixed.FRAMING_BYTES.decode("latin-1")
    return F.replace(F.decode(content, "ISO-8859-1"), F.lit(framing), F.lit(""))


def _as_utf8(latin):
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def headers(files: DataFrame, app: str, content: str = "content") -> DataFrame:
    """The header object of every file that has a readable one: ``app``, ``header`` (JSON), ``version``."""
    pattern = r'\{[^{}]*"' + fixed.HEADER_KEY + r'"[^{}]*\}'
    found = _as_utf8(F.regexp_extract(_unframed(field(content)), pattern, 0))
    return (
        files.select(field(app).alias("app"), found.alias("header"))
        .where(F.json_object_keys("header").isNotNull())
        .withColumn("version", json_value(F.col("header"), fixed.HEADER_KEY))
    )


def base64_objects(files: DataFrame, app: str, content: str = "content") -> DataFrame:
    """Objects stored as base64 text: ``app``, position, JSON text. Unreadable ones are left out."""
    pattern = fixed.BASE64_KEY + r'":"([A-Za-z0-9+/=]{20,}+)"'
    coded = F.regexp_extract_all(_unframed(field(content)), F.lit(pattern), F.lit(1))
    plain = F.rtrim(
        F.make_valid_utf8(F.try_to_binary(F.col("coded"), F.lit("base64")).cast("string")), F.lit("\x00")
    )
    return (
        files.select(field(app).alias("app"), F.posexplode(coded).alias("pos", "coded"))
        .select("app", "pos", plain.alias("object"))
        .where(F.json_object_keys("object").isNotNull() | F.try_parse_json("object").isNotNull())
    )
