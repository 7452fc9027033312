"""Delimited text: every file binds its cells by its own header, every line can be traced to its file.

One light pass reads the header of each file. Files of one folder may order their columns differently, lack some or have others:
all are then read by position in one scan, and a small table from file to layout tells which cell is which column.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions.columns import field
from tallyloom.functions.measures import actual_name
from tallyloom.session import stored

#: Columns that ``marked`` rows have beside their cells: the file, and the text of a record that is not as it should be.
FILE, RECORD = "_file", "_record"
#: What can be wrong: a line of more or fewer cells (it stays a row), a record that is none (no row), a file that is none
#: (no rows), a cell that does not fit its type (null in its row).
CELLS, UNREADABLE, FAULTY, MISFIT = "cell count", "unreadable record", "unreadable file", "cell type"
_BLOCK = ("file_path", "file_size", "file_block_start", "file_block_length")


def delimiter_of(options: dict) -> str:
    given = options.get("delimiter", ",")
    given = "," if given in (True, "") else str(given)
    return "\t" if given.lower() in ("\\t", "tab") else given


def charset_of(options: dict) -> str:
    return fixed.CODEPAGE_CHARSETS.get(str(options.get("codepage", "")).strip(), "")


def is_whole(options: dict) -> bool:
    """Line ends inside quotes, or of two bytes, cannot be found by splitting the file at bytes."""
    return bool(options.get("multiline")) or charset_of(options) in ("UTF-16LE", "UTF-16BE")


def _reader(spark: SparkSession, options: dict):
    reader = spark.read.option("sep", delimiter_of(options)).option("quote", '"').option("escape", '"')
    charset = charset_of(options)
    if charset:
        if not charset.upper().startswith(("UTF", "ISO-8859-1")):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("encoding", charset)
    return reader.option("multiLine", True) if is_whole(options) else reader


def cells_of(line: str, delimiter: str) -> list[str]:
    """The cells of one line; quotes hold delimiters, and double quotes in them stand for one."""
    if len(delimiter) > 1:
        return [c[1:-1] if len(c) > 1 and c[0] == c[-1] == '"' else c for c in line.split(delimiter)]
    return next(csv.reader([line], delimiter=delimiter), [])


def unique_labels(labels: list[str]) -> list[str]:
    """Column names of a header: an empty one is named by place, equal ones (case ignored) have their place added."""
    lowered = [label.lower() for label in labels]
    return [
        f"_c{i}" if not label else f"{label}{i}" if lowered.count(label.lower()) > 1 else label for i, label in enumerate(labels)
    ]


def headers(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """(file, names): the header of every file that has one, its first line that is not blank.

    A block that is not the last of its file fills a task alone, so a task stops after the first lines of it, and of
    a large file little more than its last block is read.
    """
    delimiter, charset, quoted = delimiter_of(options), charset_of(options) or "utf-8", bool(options.get("multiline"))

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_line, done = None, None, False
        for batch in batches:
            found = []
            for path, size, start, length, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (path, start) != at:
                    at, open_line, done = (path, start), "", start != 0
                if done:
                    continue
                line = raw[: len(raw) // 2 * 2 if charset.startswith("UTF-16") else None].decode(charset, "replace")
                open_line = f"{open_line}\n{line}" if open_line.strip() else line.lstrip("\ufeff")
                if open_line.strip() and not (quoted and open_line.count('"') % 2):
                    found.append((path, unique_labels(cells_of(open_line, delimiter))))
                    done = True
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.list_(pa.string()))], ["file", "names"])
            if done and batch.num_rows and start + length < size:
                return

    lines = spark.read.text(path).select(*[f"_metadata.{c}" for c in _BLOCK], F.col("value").cast("binary"))
    return lines.mapInArrow(first_lines, "file string, names array<string>")


def _known(layouts: list[list[str]]) -> list[str]:
    """All columns of all layouts in the order in which they first stand; case tells none apart."""
    names: dict[str, str] = {}
    for layout in layouts:
        for name in layout:
            names.setdefault(name.lower(), name)
    return list(names.values())


def _n_cells(record: Column, delimiter: str) -> Column:
    """How many cells a line has; delimiters inside quotes do not count."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.when(record.isNotNull(), F.size(F.split(bare, r"\Q" + delimiter + r"\E", -1)))


def read_delimited(
    spark: SparkSession, path: str, options: dict | None = None, columns: list[str] | None = None, marked: bool = False
) -> DataFrame:
    """Delimited text, every cell as text.

    With ``embedded_labels`` the first line of each file names its columns; a column that a file lacks is null there.
    ``columns`` are then the ones wanted (none: all that any file has; those in no file are left out). Without labels
    ``columns`` name the cells by position.

    ``marked`` adds ``FILE`` and ``RECORD``: the line, where it has more or fewer cells than its header (than ``columns``
    without one). Such lines keep the cells that they have.
    """
    options = options or {}
    reader = _reader(spark, options)
    if not options.get("embedded_labels"):
        names = list(dict.fromkeys(columns or []))
        if not names:
            rows = reader.csv(path)
            return _marks(rows, F.lit(None).cast("string")) if marked else rows
        if not marked:
            return reader.schema(_text(names)).csv(path)
        # cells that are not asked for count too
        reader = reader.option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False)
        rows = reader.schema(_text([*names, RECORD])).csv(path)
        return _marks(rows, pinned(field(RECORD), field(names[0])))
    files = stored(headers(spark, path, options), "headers")
    found = files.groupBy("names").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first")).orderBy("first").collect()
    layouts = [list(r["names"]) for r in found]
    known = _known(layouts)
    if columns:
        known = list(dict.fromkeys(n for n in (actual_name(known, c) for c in columns) if n))
    width = max(map(len, layouts), default=0)
    places = [f"_c{i}" for i in range(width)]
    reader = reader.option("header", True)
    if len(layouts) == 1 and not marked:
        # enforced, as the names have been read from the files
        return reader.schema(_text(layouts[0])).csv(path).select(*[field(_same(layouts[0], n)).alias(n) for n in known])
    # with a cell more than the widest header every line is taken down as it stands, but for those that have just that cell more
    extra = ["_past", RECORD] if marked else []
    if marked:
        reader = reader.option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False)
    rows = reader.schema(_text([*places, *extra])).csv(path).withColumn(FILE, F.col("_metadata.file_path"))
    common = max(range(len(found)), key=lambda i: found[i]["n"], default=0)
    if len(layouts) > 1:
        numbers = spark.createDataFrame([(names, i) for i, names in enumerate(layouts) if i != common], "names array<string>, layout int")
        others = stored(files.join(numbers, "names").select(F.col("file").alias(FILE), "layout"), "layouts")
        rows = rows.join(others, FILE, "left")
    else:
        rows = rows.withColumn("layout", F.lit(None).cast("int"))
    layout = F.coalesce("layout", F.lit(common))
    cells = [_cell(layouts, n, layout, places).alias(n) for n in known]
    if not marked:
        return rows.select(*cells)
    own = F.get(F.array(*[F.lit(len(names)) for names in layouts]), layout)
    longer = F.to_csv(F.struct(*places, "_past"), {"sep": delimiter_of(options), "escape": '"'})
    record = F.when(F.col(RECORD).isNull(), longer).otherwise(F.col(RECORD))
    odd = F.when(_n_cells(record, delimiter_of(options)) != own, record)
    return rows.select(FILE, odd.alias(RECORD), *cells)


def pinned(record: Column, other: Column) -> Column:
    """``record`` in a form that needs ``other`` to be read: readers refuse queries of broken records alone."""
    return F.substring(F.concat(record, F.coalesce(other.cast("string"), F.lit(""))), F.lit(1), F.length(record))


def _text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _same(layout: list[str], name: str) -> str | None:
    return next((n for n in layout if n.lower() == name.lower()), None)


def _cell(layouts: list[list[str]], name: str, layout: Column, places: list[str]) -> Column:
    """The cell that ``name`` has in each layout; only places that some layout has it at are read."""
    at = [names.index(own) if (own := _same(names, name)) else None for names in layouts]
    by_place: dict[int, list[int]] = {}
    for number, place in enumerate(at):
        if place is not None:
            by_place.setdefault(place, []).append(number)
    if len(by_place) == 1 and None not in at:
        return F.col(places[at[0]])
    return reduce(lambda rest, p: rest.when(layout.isin(by_place[p]), F.col(places[p])), by_place, F.when(F.lit(False), F.lit(None).cast("string")))


def _marks(rows: DataFrame, record: Column) -> DataFrame:
    own = [c for c in rows.columns if c != RECORD]
    return rows.select(F.col("_metadata.file_path").alias(FILE), record.alias(RECORD), *[field(c) for c in own])
