"""Catalogue objects, flat catalogue tables, assessment and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import catalog as cat, checks, expressions as ex, models, profile, scripts as sc
from tallyloom.plans.visuals import visual_type
from tallyloom.session import scratch_path, stored
from tallyloom.sources.catalogue import read_catalogue, read_table, write_catalogue
from workload.derive import order_objects, read
from workload.registry import query, sql_rows

APPS = """(SELECT *, 'o' || o_orderkey AS app, CASE WHEN o_orderpriority = '1-URGENT' THEN 'kpi' ELSE 'linechart' END AS shape,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS kpi,
    CASE WHEN o_orderstatus = 'F' THEN 'qvd' ELSE 'txt' END AS suffix FROM orders)"""


@query(
    "corpus_object_kinds",
    sql_rows(
        APPS, ["offset", "kind"],
        [(10, "app_properties"), (20, "data_model"), (30, "script"), (40, "sheet"), (50, "variables"), (60, "sheet"), (70, "other")],
    ).replace(" AS offset", ' AS "offset"'),
)
def _kinds(spark, sf_dir):
    return cat.classify(order_objects(spark, sf_dir)).drop("text")


@query(
    "corpus_unreadable",
    f"""SELECT app, CAST(k * 100 + 5 AS BIGINT) AS "offset", CAST(CASE k WHEN 1 THEN 0 WHEN 2 THEN length('{{"qScript":"' || o_orderpriority) ELSE length(o_orderpriority) END AS BIGINT) AS size,
        CASE k WHEN 1 THEN 'no text' WHEN 2 THEN 'broken or cut JSON object' ELSE 'no JSON' END AS reason
        FROM {APPS} AS apps, (VALUES (1), (2), (3)) AS ks(k)
        UNION ALL SELECT app, 25, length('not json ' || o_orderkey), 'no JSON' FROM {APPS} AS apps""",
)
def _unreadable(spark, sf_dir):
    """The objects of every order with three more that cannot be read."""
    orders = read(spark, sf_dir, "orders")
    cut = F.concat(F.lit('{"qScript":"'), "o_orderpriority")
    broken = orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("app"),
        F.posexplode(F.array(F.lit(None).cast("string"), cut, F.col("o_orderpriority"))).alias("k", "text"),
    ).select("app", ((F.col("k") + 1) * 100 + 5).cast("bigint").alias("offset"), "text")
    objects = order_objects(spark, sf_dir).select("app", F.col("offset").cast("bigint"), "text")
    return cat.unreadable(objects.unionByName(broken))


@query(
    "catalog_sheets",
    sql_rows(
        APPS, ["sheet", "title", "description", "rank"],
        [("s{o_orderkey}", "Orders {o_orderstatus}", "about {o_custkey}", "1.5"), ("e{o_orderkey}", "Untitled Sheet", "", "0.0")],
    ),
)
def _sheets(spark, sf_dir):
    return cat.catalog_sheets(order_objects(spark, sf_dir)).withColumn("rank", F.col("rank").cast("string"))


# sheet, place, nested place, chart, type, visualization, title, parent, dimensions, measures
CHARTS = [
    ("s{o_orderkey}", 0, 0, "k{o_orderkey}", "{shape}", "big", "Total {o_orderpriority}", "", 0, 1),
    ("s{o_orderkey}", 2, 0, "box", "container", "container", "Box", "", 0, 0),
    ("s{o_orderkey}", 2, 1, "b1", "barchart", "barchart", "By {o_orderstatus}", "box", 2, 2),
    ("s{o_orderkey}", 2, 3, "", "", "note", "", "box", 0, 0),
]
CHART_NAMES = ["sheet", "pos", "nested", "chart", "type", "visualization", "title", "parent", "n_dimensions", "n_measures"]


@query("catalog_charts", sql_rows(APPS, CHART_NAMES, CHARTS))
def _charts(spark, sf_dir):
    return cat.catalog_charts(order_objects(spark, sf_dir))


@query(
    "catalog_dimensions",
    sql_rows(
        APPS, ["sheet", "chart", "pos", "field", "label", "sort"],
        [
            ("s{o_orderkey}", "b1", 0, "{o_orderstatus}", "State", '{"qSortByNumeric":1},{"qSortByAscii":-1}'),
            ("s{o_orderkey}", "b1", 1, "", "", ""),
        ],
    ),
)
def _dimensions(spark, sf_dir):
    return cat.catalog_dimensions(order_objects(spark, sf_dir))


MEASURES = [
    ("s{o_orderkey}", "k{o_orderkey}", 0, "Sum([{o_orderpriority}])", "T", '{"qType":"M"}'),
    ("s{o_orderkey}", "b1", 0, "Count({<Status={'{o_orderstatus}'}>} OrderID)", "", "{}"),
    ("s{o_orderkey}", "b1", 1, "", "none", "{}"),
]


@query("catalog_measures", sql_rows(APPS, ["sheet", "chart", "pos", "expression", "label", "format"], MEASURES))
def _measures(spark, sf_dir):
    return cat.catalog_measures(order_objects(spark, sf_dir))


@query(
    "catalog_fields",
    f"""SELECT app, 0 AS pos, 'OrderID' AS field, o_orderpriority || ',Notes' AS source_tables, o_orderkey AS cardinality,
        o_custkey AS total_count, true AS is_numeric, '$key,$integer' AS tags, 12::BIGINT AS byte_size FROM {APPS}
        UNION ALL SELECT app, 1, o_orderstatus, '', 0, 0, false, '$text', 0 FROM {APPS}""",
)
def _fields(spark, sf_dir):
    out = cat.catalog_fields(order_objects(spark, sf_dir))
    return out.withColumns({"tags": F.array_join("tags", ","), "source_tables": F.array_join("source_tables", ",")})


@query(
    "catalog_tables",
    f"""SELECT app, 0 AS pos, o_orderpriority AS "table", o_orderkey AS "rows", 3::BIGINT AS fields, 1::BIGINT AS key_fields, 77::BIGINT AS byte_size FROM {APPS}
        UNION ALL SELECT app, 2, 'Notes', 0, 0, 0, 0 FROM {APPS}""",
)
def _tables(spark, sf_dir):
    return cat.catalog_tables(order_objects(spark, sf_dir))


@query(
    "catalog_variables",
    sql_rows(
        APPS, ["list_id", "pos", "name", "definition", "is_script_created"],
        [("list{o_custkey}", 0, "vStatus", "={o_orderstatus}", True), ("list{o_custkey}", 1, "v{o_orderkey}", "", False)],
    ),
)
def _variables(spark, sf_dir):
    return cat.catalog_variables(order_objects(spark, sf_dir))


@query(
    "catalog_apps",
    sql_rows(
        APPS, ["title", "last_reload", "saved_in_version", "usage", "owner", "thumbnail"],
        [("App {o_orderkey}", "{o_orderdate}", "1.{o_custkey}", "", "u{o_custkey}", '{"q":"t{o_custkey}"}')],
    ),
)
def _apps(spark, sf_dir):
    return cat.catalog_apps(order_objects(spark, sf_dir))


SCRIPT_LINES = [
    "[{o_orderpriority}]:",
    "LOAD [Order ID] AS OrderID Tagged ('$integer'), Amount, Amount * 2 AS Dbl FROM [lib://D/{o_orderstatus}.{suffix}] ({suffix});",
    "Notes: LOAD a, b INLINE [a,b",
    "1,{o_custkey}];",
]


@query(
    "catalog_summary",
    sql_rows(
        APPS, ["section", "sheet", "pos", "nested", "line"],
        [
            ("table", "", 0, 0, "{o_orderpriority} ({o_orderkey} rows x 3 fields)"),
            ("table", "", 2, 0, "Notes (0 rows x 0 fields)"),
            ("field", "", 0, 0, "OrderID cardinality={o_orderkey} rows={o_custkey}"),
            ("field", "", 1, 0, "{o_orderstatus} cardinality=0 rows=0"),
            ("chart", "s{o_orderkey}", 0, 0, '[{shape}] "Total {o_orderpriority}" dims:  measures: Sum([{o_orderpriority}])'),
            ("chart", "s{o_orderkey}", 2, 0, '[container] "Box" dims:  measures: '),
            ("chart", "s{o_orderkey}", 2, 1,
             "[barchart] \"By {o_orderstatus}\" dims: {o_orderstatus} measures: Count({<Status={'{o_orderstatus}'}>} OrderID)"),
            ("chart", "s{o_orderkey}", 2, 3, '[] "" dims:  measures: '),
            *[("script", "", i, 0, line) for i, line in enumerate(SCRIPT_LINES)],
        ],
    ),
)
def _summary(spark, sf_dir):
    objects = cat.classify(order_objects(spark, sf_dir))
    return cat.summary(objects, sc.script_head(cat.catalog_scripts(objects)))


@query(
    "visual_type_map",
    f"""SELECT app, chart, CASE type WHEN 'barchart' THEN 'clusteredColumnChart' WHEN 'linechart' THEN 'lineChart'
          WHEN 'kpi' THEN 'card' ELSE 'clusteredColumnChart' END AS visual
        FROM ({sql_rows(APPS, CHART_NAMES, CHARTS)})""",
)
def _visual_types(spark, sf_dir):
    charts = cat.catalog_charts(order_objects(spark, sf_dir))
    return charts.select("app", "chart", visual_type(F.col("type")).alias("visual"))


@query(
    "app_volumetrics",
    f"SELECT app, 2::BIGINT AS pages, 4::BIGINT AS visuals, kpi::BIGINT AS kpis FROM {APPS}",
)
def _volumetrics(spark, sf_dir):
    objects = cat.classify(order_objects(spark, sf_dir))
    return profile.app_volumetrics(cat.catalog_sheets(objects), cat.catalog_charts(objects))


@query(
    "audit_summary",
    "SELECT app, item, CAST(n AS BIGINT) AS n FROM ("
    + sql_rows(
        APPS, ["item", "n"],
        [
            ("tables", 2), ("sheets", 2), ("charts", 4), ("catalogue_fields", 2), ("unresolved", 0), ("dropped", 1),
            ("typed_columns", 1), ("no_type_evidence", 0),
            ("connected", 1), ("schema_only", 1), ("columns", 5),
            ("connected", 2), ("schema_only", 0), ("columns", 4),
        ],
        {**dict.fromkeys((8, 9, 10), "suffix = 'qvd'"), **dict.fromkeys((11, 12, 13), "suffix = 'txt'")},
    )
    + ")",
)
def _audit(spark, sf_dir):
    # five flat tables of the same objects, told and parsed once; their names and expressions hardly repeat
    told = cat.classify(order_objects(spark, sf_dir), (cat.SCRIPT, cat.MODEL, cat.SHEET))
    objects = stored(told, "objects", **{"parquet.enable.dictionary": "false"})
    tables = sc.audit_tables(sc.parse_tables(cat.catalog_scripts(objects)), cat.catalog_fields(objects))
    unresolved = ex.classify(cat.catalog_measures(objects)).where("class = 'unresolved'")
    return checks.audit_summary(
        tables, cat.catalog_fields(objects), cat.catalog_sheets(objects), cat.catalog_charts(objects), unresolved
    )


def _records(spark, sf_dir):
    """One catalogue record per order, as it would stand in a catalogue file."""
    orders = read(spark, sf_dir, "orders")
    fields = F.array(
        F.struct(F.col("o_orderpriority").alias("name"), F.array(F.lit("Orders")).alias("source_table"),
                 F.col("o_custkey").alias("cardinality"), F.col("o_orderkey").alias("total_count"),
                 F.lit(True).alias("is_numeric"), F.array(F.lit("$numeric")).alias("tags"))
    )
    charts = F.array(
        F.struct(F.lit("c1").alias("id"), F.lit("kpi").alias("type"), F.col("o_orderstatus").alias("title"),
                 F.array(F.struct(F.lit("Sum(x)").alias("expression"))).alias("measures"))
    )
    return orders.select(
        F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("size_bytes")).alias("file"),
        F.struct(F.col("o_orderpriority").alias("title")).alias("app_properties"),
        F.struct(fields.alias("fields"), F.struct(F.col("o_custkey").alias("static_byte_size")).alias("meta")).alias("data_model"),
        F.array(F.struct(F.lit("s1").alias("id"), charts.alias("charts"))).alias("sheets"),
    )


@query(
    "catalog_read",
    """SELECT 'o' || o_orderkey AS app, o_orderpriority AS title, o_orderpriority AS field, o_custkey AS cardinality, 'Orders' AS source_table,
       o_orderstatus AS chart_title, 'Sum(x)' AS expression, 0 AS n_variables, o_custkey AS static_byte_size FROM orders""",
)
def _read_catalogue(spark, sf_dir):
    path = scratch_path(spark, "catalogue-json")
    _records(spark, sf_dir).write.json(path)
    records = read_catalogue(spark, path, multiline=False)
    return records.select(
        F.col("file.name").alias("app"), F.col("app_properties.title").alias("title"),
        F.explode("data_model.fields").alias("f"), "sheets", F.col("data_model.meta.static_byte_size").alias("static_byte_size"),
        F.coalesce(F.array_size("variables"), F.lit(0)).alias("n_variables"),
    ).select(
        "app", "title", F.col("f.name").alias("field"), F.col("f.cardinality").alias("cardinality"),
        F.col("f.source_table")[0].alias("source_table"),
        F.col("sheets")[0]["charts"][0]["title"].alias("chart_title"),
        F.col("sheets")[0]["charts"][0]["measures"][0]["expression"].alias("expression"),
        "n_variables", "static_byte_size",
    )


@query(
    "catalog_roundtrip",
    f"""SELECT app, chart, expression, type FROM ({sql_rows(APPS, CHART_NAMES, CHARTS)}) c
        JOIN ({sql_rows(APPS, ["sheet", "chart", "pos", "expression", "label", "format"], MEASURES)}) m USING (app, sheet, chart)""",
)
def _roundtrip(spark, sf_dir):
    objects = order_objects(spark, sf_dir)
    path = scratch_path(spark, "catalogue")
    tables = {"charts": cat.catalog_charts(objects), "measures": cat.catalog_measures(objects)}
    write_catalogue(tables, path, partition_by=())
    charts, measures = (read_table(spark, path, name) for name in tables)
    met = charts.drop("pos").join(measures, ["app", "sheet", "chart"])
    return met.select("app", "chart", "expression", "type")


@query(
    "catalog_details",
    sql_rows(
        APPS, ["section", "name", "detail"],
        [
            ("sheet", "s{o_orderkey}", '{o_orderdate} 24x12 [{"name":"k{o_orderkey}"}]'),
            ("sheet", "e{o_orderkey}", " 0x0 []"),
            ("chart", "k{o_orderkey}", 'sub {o_orderstatus}|f{o_custkey}|true|color={"auto":false};donut={"n":{o_custkey}}'),
            *[("chart", name, "||false|") for name in ("box", "b1", "")],
            ("model", "", '{"cpu":{o_custkey}} {o_orderkey} '),
        ],
    ),
)
def _details(spark, sf_dir):
    """What sheets, charts and models hold beside the columns of the flat tables."""
    objects = cat.classify(order_objects(spark, sf_dir))
    sheets = cat.catalog_sheet_details(objects).select(
        "app", F.lit("sheet").alias("section"), F.col("sheet").alias("name"), F.format_string("%s %dx%d %s", "created", "columns", "rows", "cells").alias("detail")
    )
    settings = F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    charts = cat.catalog_chart_details(objects).select(
        "app", F.lit("chart").alias("section"), F.col("chart").alias("name"),
        F.concat_ws("|", "subtitle", "footnote", F.col("show_titles").cast("string"), settings).alias("detail"),
    )
    models = cat.catalog_models(objects).select(
        "app", F.lit("model").alias("section"), F.lit("").alias("name"), F.format_string("%s %d %s", "reload_meta", "static_byte_size", "usage").alias("detail")
    )
    return sheets.unionByName(charts).unionByName(models)


@query(
    "model_measures",
    sql_rows(
        APPS, ['"table"', "pos", "measure", "expression"],
        [
            ("Orders", 0, "Total Orders Rows", "Count(*)"),
            ("Orders", 1, "Total Amount", "Sum([Amount])"),
            ("Orders", 2, "Amount Average", "Avg(Amount)"),
            ("Other {o_orderstatus}", 0, "Total Other {o_orderstatus} Rows", "Count(*)"),
            ("Other {o_orderstatus}", 1, "Total Weight", "Sum([Weight])"),
            ("Other {o_orderstatus}", 2, "Amount per Weight", "Sum(Amount) / Sum(Weight)"),
            ("Orders", 3, "Amount per Weight", "Sum(Amount) / Sum(Weight)"),
        ],
    ),
)
def _model_measures(spark, sf_dir):
    """The measure table of every app's model."""
    orders = read(spark, sf_dir, "orders").withColumn("app", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    other = F.concat(F.lit("Other "), "o_orderstatus")

    def column(table, pos, name, kind):
        table = F.lit(table) if isinstance(table, str) else table
        return F.struct(table.alias("table"), F.lit(pos).alias("pos"), F.lit(name).alias("column"), F.lit(kind).alias("type"))

    columns = orders.select("app", F.inline(F.array(
        column("Orders", 0, "Order_ID", "int64"), column("Orders", 1, "Amount", "double"), column("Orders", 2, "Status", "string"),
        column(other, 0, "Weight", "double"),
    )))
    texts = ("Avg(Amount)", "Sum(Amount) / Sum(Weight)", "Avg(Amount)", "Max(Elsewhere)")
    expressions = orders.select("app", F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("pos", "expression"))
    return models.model_measures(columns, expressions)


@query(
    "fallback_tables",
    sql_rows(
        APPS, ['"table"', "pos", "field"],
        [("{o_orderpriority}", 0, "OrderID"), ("{o_orderpriority}", 1, "{o_orderstatus}")],
        {0: "suffix = 'qvd'", 1: "suffix = 'qvd'"},
    ),
)
def _fallback(spark, sf_dir):
    """Apps of which no load can be read fall back on the fields of their data model."""
    objects = cat.classify(order_objects(spark, sf_dir))
    loads = sc.parse_tables(cat.catalog_scripts(objects)).join(
        read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("app")), "app"
    )
    return models.fallback_tables(loads, cat.catalog_fields(objects), cat.catalog_tables(objects)).select("app", "table", "pos", "field")
