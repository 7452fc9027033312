"""Loads: one spec in, a typed DataFrame and its status out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions.columns import field, let, strip_chars, strip_space
from tallyloom.functions.types import DATETIME, SPARK_TYPES, STRING, TypeBook, typed
from tallyloom.functions.measures import actual_name
from tallyloom.plans.aggregate import aggregate
from tallyloom.sources.delimited import CELLS, FAULTY, FILE, RECORD, UNREADABLE, delimiter_of, pinned, read_delimited
from tallyloom.sources.spec import Field, LoadSpec, LoadStatus, Source
from tallyloom.sources.workbook import column_names, read_workbooks

_UNUSED = "_unused"
CONNECTED, SCHEMA_ONLY = "connected", "schema-only"
REASONS = {
    "qvd": "The file format is closed and has no public reader.",
    "fixed": "A fixed-width file needs column positions, which the load does not give.",
    "html": "An HTML page needs a table position, which the load does not give.",
    "sql": "The query runs against a connection that the app does not hold.",
    "xls": "The workbook format before 2007 is closed and has no public reader.",
    "xml": "An XML file needs the tag of its rows, which the load does not give.",
    "unknown": "The load does not name a source that can be told.",
}


def reason_for(kind: str) -> str:
    return REASONS.get(kind, REASONS["unknown"])


def join_root(root: str, path: str) -> str:
    """A path below the root folder: forward slashes, no leading slash, connection name dropped.

    Without a root the path is taken as it is.
    """
    if not root:
        return path
    relative = path.replace("\\", "/")
    if relative.lower().startswith("lib://"):
        relative = relative[len("lib://"):].partition("/")[2]
    return f"{root.rstrip('/')}/{relative.lstrip('/')}"


def load_table(
    spark: SparkSession, spec: LoadSpec, types: TypeBook | None = None, root: str = "", earlier: dict[str, DataFrame] | None = None
) -> tuple[DataFrame, LoadStatus]:
    """Read one load. An unreadable source gives its schema, no rows and the reason.

    A resident load reads the frame of that name (lower case) in ``earlier``, else a view of the session.
    """
    types = with_tags(types, [spec])
    kind = spec.source.resolved_kind()
    raw = (earlier or {}).get(spec.source.view.lower()) if kind == "resident" else None
    raw = _read(spark, spec, kind, root, types) if raw is None else raw
    if raw is None:
        wanted = [f.name for f in spec.fields]
        empty = T.StructType([T.StructField(n, SPARK_TYPES[types.type_of(n)]) for n in wanted])
        df, status, reason, dropped = spark.createDataFrame([], empty), SCHEMA_ONLY, reason_for(kind), []
    else:
        df = shape(raw, spec, types, serial_dates=kind == "excel")
        status, reason, dropped = CONNECTED, "", spec.dropped()
    typed_columns = sum(not isinstance(f.dataType, T.StringType) for f in df.schema)
    return df, LoadStatus(
        spec.name, kind, spec.source.path or spec.source.view, status, reason, tuple(df.columns),
        typed_columns, tuple((f.name, f.expression) for f in dropped), spec.unapplied_filter,
    )


def with_tags(types: TypeBook | None, specs: list[LoadSpec]) -> TypeBook:
    """The evidence with the tags of the loads added; the book that was given stays as it is."""
    known = types.copy() if types else TypeBook()
    for spec in specs:
        known.add_tags({f.name: f.tags for f in spec.fields if f.tags})
    return known


def _wanted(spec: LoadSpec) -> list[str]:
    return [f.column for f in spec.physical()]


def _read(spark: SparkSession, spec: LoadSpec, kind: str, root: str, types: TypeBook) -> DataFrame | None:
    source = spec.source
    path = join_root(root, source.path)
    everything = spec.star or not spec.fields
    if kind == "delimited":
        by_place = not source.options.get("embedded_labels")
        return read_delimited(spark, path, source.options, None if everything and not by_place else _columns_read(spec))
    if kind == "excel":
        return _read_workbooks(spark, spec, path)
    if kind == "inline":
        return read_inline(spark, source.text, delimiter_of(source.options))
    if kind == "resident":
        return spark.table(source.view)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "xml"):
        # all columns are known only once all rows have been looked at; they come as text
        schema = None if everything else _text_schema(_wanted(spec))
        return _read_records(spark, source, kind, path, schema)
    if kind == "sql" and source.text:
        return spark.sql(source.text)
    return None


def _columns_read(spec: LoadSpec) -> list[str]:
    """The columns of the fields and those that only a filter, a group or an order names; all if that cannot be told."""
    if spec.where or spec.order_by or any(f.measure for f in spec.fields):
        return [] if spec.source.options.get("embedded_labels") else _wanted(spec)
    return _wanted(spec)


def _read_workbooks(spark: SparkSession, spec: LoadSpec, path: str, marked: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    sheet, header = _sheet_name(spec.source.options), bool(spec.source.options.get("embedded_labels"))
    wanted = _wanted(spec)
    if spec.star or not spec.fields:
        own = column_names(files, sheet, header)
        wanted = own + [w for w in wanted if actual_name(own, w) is None]
    return read_workbooks(files, wanted, sheet, header, marked)


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])


def _read_records(spark: SparkSession, source: Source, kind: str, path: str, schema: T.StructType | None, marked: bool = False) -> DataFrame | None:
    """JSON or XML records as text; one that cannot be read is no row, but ``marked`` keeps it as ``RECORD``."""
    tag = _row_tag(source.options)
    if kind == "xml" and not tag:
        return None

    def reader(mode: str):
        chosen = spark.read.option("mode", mode).option("columnNameOfCorruptRecord", RECORD)
        if kind == "json":
            return chosen.option("multiLine", bool(source.options.get("multiline"))).option("primitivesAsString", True)
        return chosen.option("rowTag", tag).option("inferSchema", False)

    if marked and schema is None:
        found = reader("PERMISSIVE").format(kind).load(path).schema
        schema = T.StructType([c for c in found if c.name != RECORD])
    if marked:
        schema = T.StructType([*schema, *_text_schema([_UNUSED, RECORD])])
    chosen = reader("PERMISSIVE" if marked else "DROPMALFORMED").format(kind)
    rows = (chosen.schema(schema) if schema else chosen).load(path)
    if not marked:
        return rows
    return rows.withColumns({FILE: F.col("_metadata.file_path"), RECORD: pinned(F.col(RECORD), F.col(_UNUSED))}).drop(_UNUSED)


def read_marked(spark: SparkSession, spec: LoadSpec, kind: str, root: str) -> DataFrame | None:
    """The cells of a load beside their ``FILE``, the ``RECORD`` that is not as it should be, and the ``_reason``.

    None for sources whose records cannot go wrong one by one.
    """
    source, path = spec.source, join_root(root, spec.source.path)
    everything = spec.star or not spec.fields
    if kind == "delimited":
        by_place = not source.options.get("embedded_labels")
        rows, reason = read_delimited(spark, path, source.options, None if everything and not by_place else _columns_read(spec), True), CELLS
    elif kind == "excel":
        rows, reason = _read_workbooks(spark, spec, path, marked=True), FAULTY
    elif kind in ("json", "xml"):
        schema = None if everything else _text_schema(_wanted(spec))
        rows, reason = _read_records(spark, source, kind, path, schema, marked=True), UNREADABLE
    else:
        return None
    return rows.withColumn("_reason", F.when(F.col(RECORD).isNotNull(), reason))


def _row_tag(options: dict) -> str:
    """The tag of an XML row: given, or the last step of the table's path in a script."""
    tag = options.get("row_tag") or options.get("table") or ""
    return "" if tag is True else str(tag).strip("[]/ ").rsplit("/", 1)[-1]


def _sheet_name(options: dict) -> str:
    sheet = options.get("table", "")
    return "" if sheet is True else str(sheet).strip().rstrip("$")


def inline_rows(text: Column, delimiter: str | Column = ",") -> Column:
    """The cells of a block of text: an array of lines, each an array of trimmed, unquoted cells."""
    pattern = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    quoted = F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))
    lines = F.filter(F.split(text, r"\R"), lambda line: strip_space(line) != "")
    return F.transform(
        lines,
        lambda line: F.transform(F.split(line, quoted), lambda c: strip_chars(strip_space(c), "'\"")),
    )


def inline_body(text: Column, delimiter: str | Column = ",") -> Column:
    """The lines below the header of a block of text."""
    return let(inline_rows(text, delimiter), lambda rows: F.slice(rows, F.lit(2), F.size(rows)))


def read_inline(spark: SparkSession, text: str, delimiter: str = ",") -> DataFrame:
    """A table written into the load: the first line names the columns.

    Short rows are filled with empty text, long rows are cut to the header.
    """
    header_line = next((line for line in text.splitlines() if line.strip()), "")
    names = [cell.strip().strip("'\"") for cell in header_line.split(delimiter)]
    cells = spark.range(0, 1, 1, 1).select(F.explode(inline_body(F.lit(text), delimiter)).alias("cells"))
    return cells.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def select_or_null(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; one that is missing is null."""
    out = []
    for name in names:
        found = actual_name(df.columns, name)
        out.append(field(found).alias(name) if found else F.lit(None).cast("string").alias(name))
    return df.select(*out)


def shape(df: DataFrame, spec: LoadSpec, types: TypeBook, serial_dates: bool = False) -> DataFrame:
    """A load's rows: typed, filtered, grouped, selected under their new names, distinct, ordered."""
    by_source = {f.column.lower(): f.name for f in spec.fields if not f.measure}
    cells = [
        cell(c, types.type_of(by_source.get(c.name.lower(), c.name)), serial_dates) for c in df.schema
    ]
    rows = df.select(*cells)
    if spec.where:
        rows = rows.where(F.expr(spec.where))
    if spec.group_by:
        measures = [f.measure.named(f.name) for f in spec.fields if f.measure]
        rows = aggregate(rows, list(spec.group_by), measures)
    # an aggregate already carries its field's name
    fields = [replace(f, source="") if f.measure else f for f in spec.physical()]
    fields = fields or [Field(c) for c in rows.columns]
    if spec.star:
        given = {f.name.lower() for f in spec.physical()}
        fields = [Field(c) for c in rows.columns if c.lower() not in given] + spec.physical()
    out = []
    for f in fields:
        found = actual_name(rows.columns, f.column)
        kind = SPARK_TYPES[types.type_of(f.name)]
        out.append(field(found).alias(f.name) if found else F.lit(None).cast(kind).alias(f.name))
    rows = rows.select(*out)
    if spec.distinct:
        rows = rows.distinct()
    return rows.orderBy(*[field(c) for c in spec.order_by]) if spec.order_by else rows


def cell(column: T.StructField, type_name: str, serial_dates: bool) -> Column:
    """Text takes the type its evidence speaks for; a source's own types stay."""
    if not isinstance(column.dataType, T.StringType) or type_name == STRING:
        return field(column.name)
    return typed(field(column.name), type_name, serial_dates=serial_dates and type_name == DATETIME).alias(
        column.name
    )


def concatenate(loads: list[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Loads of one name (case ignored) as one table: all rows, fields in first-seen order."""
    tables: dict[str, tuple[str, DataFrame]] = {}
    for name, df in loads:
        key = name.lower()
        if key in tables:
            first_name, first = tables[key]
            tables[key] = (first_name, append(first, df))
        else:
            tables[key] = (name, df)
    return {name: df for name, df in tables.values()}


def append(first: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of ``more`` below those of ``first``, matched by name without regard to case."""
    renamed = [
        field(c).alias(actual_name(first.columns, c) or c) for c in more.columns
    ]
    return first.unionByName(more.select(*renamed), allowMissingColumns=True)


def load_all(
    spark: SparkSession, specs: list[LoadSpec], types: TypeBook | None = None, root: str = ""
) -> tuple[dict[str, DataFrame], list[LoadStatus]]:
    """Every load of an app, in order; later resident loads read the tables of this app alone.

    Mapping tables and ``__`` helper tables can be read by later loads but are not returned.
    Tags count for every field of that name, whichever load has them.
    """
    types = with_tags(types, specs)
    tables: dict[str, tuple[str, DataFrame]] = {}
    hidden, statuses = set(), []
    for spec in specs:
        df, status = load_table(spark, spec, types, root, {k: frame for k, (_, frame) in tables.items()})
        statuses.append(status)
        name = spec.concatenate_to or spec.name
        key = name.lower()
        if key in tables:
            name, first = tables[key]
            df = append(first, df)
        tables[key] = (name, df)
        if spec.is_mapping or spec.is_hidden or spec.name.startswith("__"):
            hidden.add(key)
    return {name: df for key, (name, df) in tables.items() if key not in hidden}, statuses


__all__ = ["Field", "LoadSpec", "LoadStatus", "Source", "load_all", "load_table"]
