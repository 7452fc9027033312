"""Catalogue objects of many apps as flat tables: sheets, charts, fields, tables, variables.

Input is a DataFrame with ``app``, ``offset`` and ``text``, one JSON object per row, as
``sources.app_files.inflate`` yields it. Each object is told by its keys, then read once with
an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import any_of, let

SCRIPT, SHEET, MODEL, PROPERTIES, VARIABLES = "script", "sheet", "data_model", "app_properties", "variables"

# --- fixed values: keys of the stored objects
_PLAIN_SHEET = (
    "qRoot struct<qProperty: struct<qInfo: struct<qId: string>, rank: double,{}"
    " qMetaDef: struct<title: string, description: string>>,"
    " qChildren: array<struct<qProperty: string, qChildren: array<struct<qProperty: string>>>>>"
)
_SHEET = _PLAIN_SHEET.format(" creationDate: string, columns: bigint, rows: bigint, cells: string,")
_PLAIN_CHART = (
    "qInfo struct<qId: string, qType: string>, visualization string, title string, qHyperCubeDef struct<"
    "qDimensions: array<struct<qDef: struct<qFieldDefs: array<string>, qFieldLabels: array<string>,"
    " qSortCriterias: array<string>>>>,"
    " qMeasures: array<struct<qDef: struct<qDef: string, qLabel: string, qNumFormat: string>>>>"
)
_CHART = _PLAIN_CHART + ", subtitle string, footnote string, showTitles boolean"
SETTINGS = (
    "color", "legend", "orientation", "gridLine", "dataPoint", "dimensionAxis", "measureAxis", "tooltip", "barGrouping",
    "lineType", "donut", "scrollbar", "version",
)
_CHART += "".join(f", {key} string" for key in SETTINGS)
_PLAIN_MODEL = (
    "qfields array<struct<qname: string, qsrc_tables: array<string>, qcardinal: bigint,"
    " qtotal_count: bigint, qis_numeric: boolean, qtags: array<string>, qbyte_size: bigint,"
    " qis_system: boolean, qis_hidden: boolean>>,"
    " qtables array<struct<qname: string, qno_of_rows: bigint, qno_of_fields: bigint,"
    " qno_of_key_fields: bigint, qbyte_size: bigint, qis_system: boolean>>"
)
_MODEL = _PLAIN_MODEL + ", qreload_meta string, qstatic_byte_size bigint, qusage string"
_PROPERTIES = (
    "qTitle string, qLastReloadTime string, qSavedInProductVersion string, qUsage string, owner string, qThumbnail string"
)
_VARIABLES = (
    "qId string, qEntryList array<struct<qProperties: struct<qName: string, qDefinition: string>,"
    " qIsScriptCreated: boolean>>"
)
_SCHEMAS = {SCRIPT: "qScript string", SHEET: _SHEET, MODEL: _MODEL, PROPERTIES: _PROPERTIES, VARIABLES: _VARIABLES}
# what the flat tables read, those of details left out, and the members that it consists of
_PLAIN = _SCHEMAS | {SHEET: _PLAIN_SHEET.format(""), MODEL: _PLAIN_MODEL}
_MEMBERS = {
    SCRIPT: ("qScript",), SHEET: ("qRoot",), MODEL: ("qfields", "qtables"), VARIABLES: ("qId", "qEntryList"),
    PROPERTIES: ("qTitle", "qLastReloadTime", "qSavedInProductVersion", "qUsage", "owner", "qThumbnail"),
}
# the members that tell a kind
_MARKS = {
    "qScript": "string", "qMetaData": "struct<qType: string>", "qreload_meta": "string", "qTitle": "string",
    "qLastReloadTime": "string", "qEntryList": "string", "qId": "string",
}

# --- fixed values: one row per app, as read from catalogue files.
CATALOGUE = (
    "file struct<name: string, path: string, size_bytes: bigint, extracted_at: string>,"
    " header map<string, string>,"
    " app_properties struct<title: string, last_reload: string, saved_in_version: string,"
    " usage: string, owner: string, thumbnail: map<string, string>>,"
    " load_script string,"
    " data_model struct<"
    "tables: array<struct<name: string, rows: bigint, fields: bigint, key_fields: bigint, byte_size: bigint>>,"
    " fields: array<struct<name: string, source_table: array<string>, cardinality: bigint,"
    " total_count: bigint, is_numeric: boolean, tags: array<string>, byte_size: bigint>>,"
    " meta: struct<reload_meta: string, static_byte_size: bigint, usage: string>>,"
    " sheets array<struct<id: string, title: string, description: string, rank: double, created: string,"
    " layout: struct<columns: bigint, rows: bigint>, cells: string,"
    " charts: array<struct<id: string, type: string, visualization: string, title: string, subtitle: string,"
    " footnote: string, showTitles: boolean, parent: string,"
    " dimensions: array<struct<field: string, label: string, sort: string>>,"
    " measures: array<struct<expression: string, label: string, format: string>>, settings: string>>>>,"
    " variables array<struct<list_id: string, name: string, definition: string, is_script_created: boolean>>,"
    " security_metadata array<string>"
)


#: The JSON readers give null for texts over 20 MB unless told otherwise; an object may be of any size.
ANY_SIZE = {"maxStringLen": "2147483647"}


def json_value(text: Column, key: str, schema: str = "string") -> Column:
    """One member of an object of any size."""
    return F.from_json(text, f"{key} {schema}", ANY_SIZE)[key]


def _kind_of(keys: Column, text: Column) -> Column:
    return _kind_by(lambda key: F.array_contains(keys, key), json_value(text, "qMetaData", _MARKS["qMetaData"]))


def _kind_by(has, meta: Column) -> Column:
    """The kind of a text by whether it ``has`` a key; the first match counts."""
    return (
        F.when(has("qScript"), SCRIPT)
        .when(has("qMetaData") & (meta["qType"] == "sheet"), SHEET)
        .when(has("qreload_meta"), MODEL)
        .when(has("qTitle") & has("qLastReloadTime"), PROPERTIES)
        .when(has("qEntryList") & has("qId"), VARIABLES)
    )


def object_kind(text: Column) -> Column:
    """What an object is, told by its keys; the first match counts, null if none or unreadable."""
    return let(F.json_object_keys(text), lambda keys: _kind_of(keys, text))


def _told(objects: DataFrame) -> DataFrame:
    """``kind`` of every text: ``other`` fits no kind, null is no JSON.

    Keys and kind are what generators yield, so that each text is searched once, however many conditions name them.
    """
    keyed = objects.select("app", "offset", "text", F.explode(F.array(F.json_object_keys("text"))).alias("keys"))
    # generators are interpreted, so that keys are sought in compiled code between the two
    marked = keyed.select(
        "app", "offset", "text", F.col("keys").isNotNull().alias("_read"), *[F.array_contains("keys", n).alias(f"_{n}") for n in _MARKS]
    )
    known = _kind_by(lambda key: F.col(f"_{key}"), json_value(F.col("text"), "qMetaData", _MARKS["qMetaData"]))
    kind = F.when(F.col("_read"), F.coalesce(known, F.lit("other"))).when(F.try_parse_json("text").isNotNull(), "other")
    return marked.select("app", "offset", F.explode(F.array(kind)).alias("kind"), "text")


def classify(objects: DataFrame, read: tuple[str, ...] = ()) -> DataFrame:
    """(app, offset, kind, text) of every readable object, whatever its size; ``other`` fits no kind.

    With kinds to ``read`` it is (app, offset, kind, and a column per kind) of the objects of these kinds, told and parsed
    at once. The flat tables of these kinds, but for those of details, take that for objects too. Where several are made
    of the same objects, it is stored in between (``session.stored``): no text is then built, searched or parsed more than
    once, and every flat table reads the column of its own kind alone.
    """
    if read:
        return _parsed(objects, read)
    return _told(objects).where("kind IS NOT NULL")


def unreadable(objects: DataFrame) -> DataFrame:
    """(app, offset, size, reason) of what ``classify`` leaves out, so that nothing goes missing unseen."""
    reason = F.when(F.col("text").isNull(), "no text").when(
        F.trim("text").startswith("{"), "broken or cut JSON object"
    ).otherwise("no JSON")
    return _told(objects).where("kind IS NULL").select(
        "app", "offset", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"), reason.alias("reason")
    )


_KEYS = {
    SCRIPT: "qScript", SHEET: "qMetaData", MODEL: "qreload_meta", PROPERTIES: "qLastReloadTime", VARIABLES: "qEntryList",
}


def _only(objects: DataFrame, kind: str) -> DataFrame:
    """The objects of one kind.

    Objects stored with their kind (``sources.catalogue.write_objects``) are picked by it, and a folder per kind means
    that no other is read. A cheap search for the key that tells the kind, plain or with escaped letters, spares all
    others the parsing: the optimiser takes it below the generators that tell the kind.
    """
    told = objects if "kind" in objects.columns else _told(objects)
    text = F.col("text")
    return told.where(text.contains(_KEYS[kind]) | text.contains("\\u")).where(F.col("kind") == kind)


def _once(text: str, schema: str) -> Column:
    """The object in a text column, parsed once: what a generator yields is not computed again
    for every field that is read from it."""
    return F.explode(F.array(F.from_json(text, schema, ANY_SIZE)))


def _is_parsed(objects: DataFrame, kind: str) -> bool:
    return kind in objects.columns and "text" not in objects.columns


def _of_kind(objects: DataFrame, kind: str) -> DataFrame:
    if _is_parsed(objects, kind):
        return objects.where(F.col("kind") == kind).select("app", "offset", F.col(kind).alias("o"))
    return _only(objects, kind).select("app", "offset", _once("text", _SCHEMAS[kind]).alias("o"))


def _parsed(objects: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(app, offset, kind, and a column per kind) of the objects of these kinds.

    One parse gives the members that tell a kind and those that are asked for. A member that is null may be there all the
    same, so where a text holds its name, and wherever a text is no plain object or not as expected, it is told and read
    as by the flat tables.
    """
    text, broken = F.col("text"), objects.sparkSession.conf.get("spark.sql.columnNameOfCorruptRecord")
    members = {m for k in kinds for m in _MEMBERS[k]}
    schema = ", ".join([_PLAIN[k] for k in kinds] + [f"{m} {t}" for m, t in _MARKS.items() if m not in members] + [f"`{broken}` string"])
    # the cheap search of ``_only``, for all kinds together
    escaped = text.contains("\\u")
    near = objects.where(any_of([text.contains(_KEYS[k]) for k in sorted(kinds, key=list(_KEYS).index)] + [escaped]))
    # what generators yield is not computed again for every condition that names it
    each = near.select("app", "offset", "text", F.explode(F.array(F.from_json(text, schema, ANY_SIZE))).alias("o"))
    o = F.col("o")
    plain = o.isNotNull() & o[broken].isNull() & text.startswith("{")

    def has(key: str) -> Column:
        return o[key].isNotNull() | ((text.contains(key) | escaped) & F.array_contains(F.json_object_keys(text), key))

    kind = F.when(plain, _kind_by(has, o["qMetaData"])).otherwise(object_kind(text))
    told = each.select("app", "offset", "text", "o", F.explode(F.array(kind)).alias("kind")).where(F.col("kind").isin(*kinds))

    def column(kind: str) -> Column:
        own = F.struct(*[o[m].alias(m) for m in _MEMBERS[kind]])
        whole = F.when(plain, own).otherwise(F.from_json(text, _PLAIN[kind], ANY_SIZE))
        return F.when(F.col("kind") == kind, let(whole, _with_nodes) if kind == SHEET else whole).alias(kind)

    return told.select("app", "offset", "kind", *[column(k) for k in kinds])


def catalog_scripts(objects: DataFrame) -> DataFrame:
    """(app, script) with Unix line ends; the last script of an app counts."""
    if _is_parsed(objects, SCRIPT):
        read = _of_kind(objects, SCRIPT).select("app", "offset", F.col("o.qScript").alias("script"))
    else:
        read = _only(objects, SCRIPT).select("app", "offset", json_value(F.col("text"), "qScript").alias("script"))
    last = read.groupBy("app").agg(F.max_by("script", "offset").alias("script"))
    return last.select("app", F.replace("script", F.lit("\r\n"), F.lit("\n")).alias("script"))


def catalog_sheets(objects: DataFrame) -> DataFrame:
    """(app, sheet, title, description, rank)."""
    p = "o.qRoot.qProperty"
    return _of_kind(objects, SHEET).select(
        "app",
        F.coalesce(f"{p}.qInfo.qId", F.lit("")).alias("sheet"),
        F.coalesce(f"{p}.qMetaDef.title", F.lit("Untitled Sheet")).alias("title"),
        F.coalesce(f"{p}.qMetaDef.description", F.lit("")).alias("description"),
        F.coalesce(f"{p}.rank", F.lit(0.0)).alias("rank"),
    )


def catalog_sheet_details(objects: DataFrame) -> DataFrame:
    """(app, sheet, created, columns, rows, cells): the grid of every sheet, its cells as JSON text."""
    p = "o.qRoot.qProperty"
    return _of_kind(objects, SHEET).select(
        "app", F.coalesce(f"{p}.qInfo.qId", F.lit("")).alias("sheet"),
        F.coalesce(f"{p}.creationDate", F.lit("")).alias("created"),
        F.coalesce(f"{p}.columns", F.lit(0)).cast("bigint").alias("columns"),
        F.coalesce(f"{p}.rows", F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(f"{p}.cells", F.lit("[]")).alias("cells"),
    )


def catalog_chart_details(objects: DataFrame) -> DataFrame:
    """(app, sheet, pos, nested, chart, subtitle, footnote, show_titles, settings), the settings as JSON text by key."""
    given = F.map_from_arrays(F.array(*[F.lit(k) for k in SETTINGS]), F.array(*[F.col(f"c.{k}") for k in SETTINGS]))
    return _chart_nodes(objects).select(
        "app", "sheet", "pos", "nested", _chart_id(),
        F.coalesce("c.subtitle", F.lit("")).alias("subtitle"), F.coalesce("c.footnote", F.lit("")).alias("footnote"),
        F.coalesce("c.showTitles", F.lit(False)).alias("show_titles"),
        F.map_filter(given, lambda _, v: v.isNotNull()).alias("settings"),
    )


def catalog_models(objects: DataFrame) -> DataFrame:
    """(app, reload_meta, static_byte_size, usage) of every data model, the reload data as JSON text."""
    return _of_kind(objects, MODEL).select(
        "app", F.coalesce("o.qreload_meta", F.lit("{}")).alias("reload_meta"),
        F.coalesce("o.qstatic_byte_size", F.lit(0)).cast("bigint").alias("static_byte_size"),
        F.coalesce("o.qusage", F.lit("")).alias("usage"),
    )


def _chart_nodes(objects: DataFrame) -> DataFrame:
    """Every chart, and the charts one level inside it, with its parsed definition."""
    found = _of_kind(objects, SHEET)
    sheet = F.coalesce("o.qRoot.qProperty.qInfo.qId", F.lit("")).alias("sheet")
    if _is_parsed(objects, SHEET):
        return found.select("app", sheet, F.inline("o.nodes")).select("app", "sheet", "pos", "nested", "parent", "c")
    sheets = found.select("app", sheet, F.posexplode("o.qRoot.qChildren").alias("pos", "child"))
    nodes = (
        sheets.where(_is_filled(F.col("child.qProperty")))
        .select("app", "sheet", "pos", "child", F.explode(_texts_of(F.col("child"))).alias("node"))
        .where(_is_filled(F.col("node.text")))
    )
    return nodes.select(
        "app", "sheet", "pos", F.col("node.nested").alias("nested"),
        F.when(F.col("node.nested") > 0, _outer_id(F.col("child"))).otherwise("").alias("parent"),
        _once("node.text", _CHART).alias("c"),
    )


def _texts_of(child: Column) -> Column:
    """(nested, text) of a chart and of the charts inside it."""
    inner = F.transform(
        F.coalesce(child["qChildren"], F.array().cast("array<struct<qProperty: string>>")),
        lambda c, i: F.struct((i + 1).alias("nested"), c["qProperty"].alias("text")),
    )
    return F.concat(F.array(F.struct(F.lit(0).alias("nested"), child["qProperty"].alias("text"))), inner)


def _outer_id(child: Column) -> Column:
    """The id of an outer chart, which is read for the charts inside it only."""
    return F.coalesce(json_value(child["qProperty"], "qInfo", "struct<qId: string>")["qId"], F.lit(""))


def _with_nodes(sheet: Column) -> Column:
    """A parsed sheet whose charts stand beside its own properties, as (pos, nested, parent, c) in an array."""

    def nodes(child: Column, pos: Column) -> Column:
        inside = F.when(F.size(child["qChildren"]) > 0, _outer_id(child))
        return let(inside, lambda outer: F.transform(
            F.filter(_texts_of(child), lambda n: _is_filled(n["text"])),
            lambda n: F.struct(
                pos.alias("pos"), n["nested"].alias("nested"), F.when(n["nested"] > 0, outer).otherwise("").alias("parent"),
                F.from_json(n["text"], _PLAIN_CHART, ANY_SIZE).alias("c"),
            ),
        ))

    children = sheet["qRoot"]["qChildren"]
    empty = F.array().cast(f"array<struct<pos: int, nested: int, parent: string, c: struct<{_PLAIN_CHART}>>>")
    each = F.transform(children, lambda c, i: F.when(_is_filled(c["qProperty"]), nodes(c, i)).otherwise(empty))
    return F.struct(F.struct(sheet["qRoot"]["qProperty"].alias("qProperty")).alias("qRoot"), F.flatten(each).alias("nodes"))


def _is_filled(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(r"^\s*\{\s*\}\s*$")


def _chart_id() -> Column:
    return F.coalesce("c.qInfo.qId", F.lit("")).alias("chart")


def catalog_charts(objects: DataFrame) -> DataFrame:
    """(app, sheet, pos, nested, chart, type, visualization, title, parent, n_dimensions, n_measures)."""
    kind = F.coalesce("c.qInfo.qType", F.lit(""))
    return _chart_nodes(objects).select(
        "app", "sheet", "pos", "nested", _chart_id(), kind.alias("type"),
        F.coalesce("c.visualization", kind).alias("visualization"),
        F.coalesce("c.title", F.lit("")).alias("title"),
        "parent",
        F.coalesce(F.array_size("c.qHyperCubeDef.qDimensions"), F.lit(0)).alias("n_dimensions"),
        F.coalesce(F.array_size("c.qHyperCubeDef.qMeasures"), F.lit(0)).alias("n_measures"),
    )


def catalog_dimensions(objects: DataFrame) -> DataFrame:
    """(app, sheet, chart, pos, field, label, sort): the first field and label of each dimension.

    The sort criteria stay as JSON text for whoever wants to order by them.
    """
    each = _chart_nodes(objects).select(
        "app", "sheet", _chart_id(), F.posexplode("c.qHyperCubeDef.qDimensions").alias("pos", "d")
    )
    return each.select(
        "app", "sheet", "chart", "pos",
        F.coalesce(F.get("d.qDef.qFieldDefs", F.lit(0)), F.lit("")).alias("field"),
        F.coalesce(F.get("d.qDef.qFieldLabels", F.lit(0)), F.lit("")).alias("label"),
        F.coalesce(F.array_join("d.qDef.qSortCriterias", ","), F.lit("")).alias("sort"),
    )


def catalog_measures(objects: DataFrame) -> DataFrame:
    """(app, sheet, chart, pos, expression, label, format), the number format as JSON text."""
    each = _chart_nodes(objects).select(
        "app", "sheet", _chart_id(), F.posexplode("c.qHyperCubeDef.qMeasures").alias("pos", "m")
    )
    return each.select(
        "app", "sheet", "chart", "pos",
        F.coalesce("m.qDef.qDef", F.lit("")).alias("expression"),
        F.coalesce("m.qDef.qLabel", F.lit("")).alias("label"),
        F.coalesce("m.qDef.qNumFormat", F.lit("{}")).alias("format"),
    )


def catalog_fields(objects: DataFrame) -> DataFrame:
    """(app, pos, field, source_tables, cardinality, total_count, is_numeric, tags, byte_size)."""
    each = _of_kind(objects, MODEL).select("app", F.posexplode("o.qfields").alias("pos", "f"))
    shown = each.where(~F.coalesce("f.qis_system", F.lit(False)) & ~F.coalesce("f.qis_hidden", F.lit(False)))
    none = F.array().cast("array<string>")
    return shown.select(
        "app", "pos",
        F.coalesce("f.qname", F.lit("")).alias("field"),
        F.coalesce("f.qsrc_tables", none).alias("source_tables"),
        F.coalesce("f.qcardinal", F.lit(0)).alias("cardinality"),
        F.coalesce("f.qtotal_count", F.lit(0)).alias("total_count"),
        F.coalesce("f.qis_numeric", F.lit(False)).alias("is_numeric"),
        F.coalesce("f.qtags", none).alias("tags"),
        F.coalesce("f.qbyte_size", F.lit(0)).alias("byte_size"),
    )


def catalog_tables(objects: DataFrame) -> DataFrame:
    """(app, pos, table, rows, fields, key_fields, byte_size), system tables left out."""
    each = _of_kind(objects, MODEL).select("app", F.posexplode("o.qtables").alias("pos", "t"))
    return each.where(~F.coalesce("t.qis_system", F.lit(False))).select(
        "app", "pos",
        F.coalesce("t.qname", F.lit("")).alias("table"),
        F.coalesce("t.qno_of_rows", F.lit(0)).alias("rows"),
        F.coalesce("t.qno_of_fields", F.lit(0)).alias("fields"),
        F.coalesce("t.qno_of_key_fields", F.lit(0)).alias("key_fields"),
        F.coalesce("t.qbyte_size", F.lit(0)).alias("byte_size"),
    )


def catalog_variables(objects: DataFrame) -> DataFrame:
    """(app, list_id, pos, name, definition, is_script_created)."""
    each = _of_kind(objects, VARIABLES).select(
        "app", F.coalesce("o.qId", F.lit("")).alias("list_id"), F.posexplode("o.qEntryList").alias("pos", "v")
    )
    return each.select(
        "app", "list_id", "pos",
        F.coalesce("v.qProperties.qName", F.lit("")).alias("name"),
        F.coalesce("v.qProperties.qDefinition", F.lit("")).alias("definition"),
        F.coalesce("v.qIsScriptCreated", F.lit(False)).alias("is_script_created"),
    )


def catalog_apps(objects: DataFrame) -> DataFrame:
    """(app, title, last_reload, saved_in_version, usage, owner, thumbnail)."""
    names = {
        "title": "qTitle", "last_reload": "qLastReloadTime", "saved_in_version": "qSavedInProductVersion",
        "usage": "qUsage", "owner": "owner", "thumbnail": "qThumbnail",
    }
    return _of_kind(objects, PROPERTIES).select(
        "app", *[F.coalesce(f"o.{key}", F.lit("")).alias(name) for name, key in names.items()]
    )


def summary(objects: DataFrame, script_lines: DataFrame) -> DataFrame:
    """(app, section, sheet, pos, nested, line): tables, fields, charts and the head of the script, as text lines.

    Lines of a section stand in the order of ``sheet``, ``pos`` and ``nested``, which are numbers.
    """
    none, zero = F.lit("").alias("sheet"), F.lit(0).alias("nested")
    tables = catalog_tables(objects).select(
        "app", F.lit("table").alias("section"), none, "pos", zero,
        F.format_string("%s (%d rows x %d fields)", "table", "rows", "fields").alias("line"),
    )
    fields = catalog_fields(objects).select(
        "app", F.lit("field").alias("section"), none, "pos", zero,
        F.format_string("%s cardinality=%d rows=%d", "field", "cardinality", "total_count").alias("line"),
    )
    charts = _chart_nodes(objects).select(
        "app", F.lit("chart").alias("section"), "sheet", "pos", "nested",
        F.format_string(
            '[%s] "%s" dims: %s measures: %s',
            F.coalesce("c.qInfo.qType", F.lit("")), F.coalesce("c.title", F.lit("")),
            _listed(F.transform("c.qHyperCubeDef.qDimensions", lambda d: F.get(d["qDef"]["qFieldDefs"], F.lit(0)))),
            _listed(F.transform("c.qHyperCubeDef.qMeasures", lambda m: m["qDef"]["qDef"])),
        ).alias("line"),
    )
    lines = script_lines.select("app", F.lit("script").alias("section"), none, "pos", zero, "line")
    return tables.unionByName(fields).unionByName(charts).unionByName(lines)


def _listed(words: Column) -> Column:
    """The words that hold something, comma separated."""
    return F.coalesce(F.array_join(F.filter(words, lambda w: F.coalesce(w, F.lit("")) != ""), ", "), F.lit(""))
