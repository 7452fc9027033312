"""Load scripts: comments, statements, variables, loads, sources, fields, status, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import checks, expressions as ex, scripts as sc
from tallyloom.sources.load import REASONS
from workload.derive import filled, part_expressions, part_scripts, read, spread
from workload.registry import query, sql_rows, sql_text

# What every script must read as, row by row, in the columns of its part.
PARTS = """(SELECT *, 'app' || p_partkey AS app,
    CASE p_type WHEN 'ECONOMY' THEN 'csv' WHEN 'SMALL' THEN 'qvd' WHEN 'STANDARD' THEN 'parquet' ELSE 'dat' END AS ext,
    CASE p_type WHEN 'ECONOMY' THEN 'txt' WHEN 'SMALL' THEN 'qvd' WHEN 'STANDARD' THEN 'parquet' ELSE 'fix' END AS fmt,
    CASE p_type WHEN 'ECONOMY' THEN 'delimited' WHEN 'SMALL' THEN 'qvd' WHEN 'STANDARD' THEN 'parquet' ELSE 'fixed' END AS kind
    FROM part)"""
READABLE = "p_type IN ('ECONOMY', 'STANDARD')"
UNREADABLE = "p_type NOT IN ('ECONOMY', 'STANDARD')"

FIRST = """[{p_name}]:
LOAD DISTINCT
    [Order ID] AS OrderID Tagged ('$key', '$integer'), 
    Amount Tagged ('$numeric'),
    Num(Round(Amount * (1 + 0.2), 2), '#,##0') AS [Net, {p_brand}],
    'a, b' AS Note,
    Year(OrderDate)
FROM [$(vDir)/sales_{p_partkey}.{ext}]
({fmt}, codepage is 1252, embedded labels, delimiter is ';')
WHERE Amount > {p_size}"""
STATEMENTS = [
    "SET vRoot = 'lib://{p_brand}'",
    "LET vSize = {p_size}",
    "LET vNow = Num(Today())",
    "set vDir = $(vRoot)/$(vMissing)/$(vSize)",
    'SET vSize = "{p_size}0"',
    FIRST,
    "Stores:\nLOAD StoreID, City RESIDENT [{p_name}] WHERE City <> 'x;y'",
    "MapCity:\nMAPPING LOAD code, label INLINE [\ncode,label\n{p_size},'{p_brand}'\n]",
    "__Helper:\nLOAD * INLINE [k|v\n{p_type}|{p_size}\n] (delimiter is '|')",
    "LOAD Region, \"Sales {p_size}\" FROM 'lib://Shared/geo/regions_{p_size}.xlsx' (ooxml, embedded labels, table is Sheet1$)",
    "CONCATENATE ([{p_name}]) LOAD [Order ID] AS orderid, Discount FROM [extra_{p_partkey}.csv] (txt, delimiter is '\\t')",
    "JOIN (Stores) LOAD StoreID, Zone FROM zones.csv",
    "Live: LOAD id, total SQL SELECT id, total FROM dbo.orders WHERE total > {p_size}",
    "LOAD Region, Manager FROM [lib://Other/regions_{p_size}.csv]",
    "Forecast: LOAD Mid(Code, 1, 2) AS Area, Left(Code, 2)",
    "TRACE LOAD done",
    "DROP TABLE [{p_name}]",
]
CLEAN = (
    "\n" + ";\n".join(STATEMENTS[:5]) + ";\n\n\n" + FIRST + ";\n" + ";\n".join(STATEMENTS[6:])
)


@query("script_clean", f"SELECT app, {sql_text(CLEAN)} AS script FROM {PARTS}")
def _clean(spark, sf_dir):
    return sc.clean_scripts(part_scripts(spark, sf_dir))


@query("script_statements", sql_rows(PARTS, ["pos", "statement"], list(enumerate(STATEMENTS))))
def _statements(spark, sf_dir):
    return sc.script_statements(part_scripts(spark, sf_dir))


@query(
    "script_variables",
    sql_rows(
        PARTS, ["name", "value", "expanded"],
        [
            ("vroot", "lib://{p_brand}", "lib://{p_brand}"),
            ("vdir", "$(vRoot)/$(vMissing)/$(vSize)", "lib://{p_brand}/$(vMissing)/{p_size}0"),
            ("vsize", "{p_size}0", "{p_size}0"),
        ],
    ),
)
def _variables(spark, sf_dir):
    return sc.script_variables(part_scripts(spark, sf_dir))


def _loads(spark, sf_dir):
    return sc.parse_loads(part_scripts(spark, sf_dir))


def _tables(spark, sf_dir):
    return sc.parse_tables(part_scripts(spark, sf_dir))


# pos, table, kind, mapping, hidden, distinct, filter, number of fields
LOADS = [
    (5, "{p_name}", "{kind}", False, False, True, "WHERE Amount > {p_size}", 5),
    (6, "Stores", "resident", False, False, False, "WHERE City <> 'x;y'", 2),
    (7, "MapCity", "inline", True, False, False, "", 2),
    (8, "__Helper", "inline", False, True, False, "", 2),
    (9, "regions_{p_size}", "excel", False, False, False, "", 2),
    (10, "{p_name}", "delimited", False, False, False, "", 2),
    (12, "Live", "sql", False, False, False, "", 2),
    (13, "regions_{p_size}", "delimited", False, False, False, "", 2),
    (14, "Forecast", "unknown", False, False, False, "", 2),
]


@query(
    "script_loads",
    sql_rows(PARTS, ["pos", '"table"', "kind", "is_mapping", "is_hidden", "is_distinct", '"filter"', "n_fields"], LOADS),
)
def _script_loads(spark, sf_dir):
    return sc.script_loads(_loads(spark, sf_dir))


_PATH = "$(vMissing)/{p_size}0/sales_{p_partkey}.{ext}"
_OPTIONS = "{fmt}=true; codepage=1252; embedded_labels=true; delimiter=;"


@query(
    "script_sources",
    sql_rows(
        PARTS, ["pos", '"table"', "kind", "path", "connection", "relative_path", "resident", "options"],
        [
            (5, "{p_name}", "{kind}", "lib://{p_brand}/" + _PATH, "{p_brand}", _PATH, "", _OPTIONS),
            (6, "Stores", "resident", "", "", "", "{p_name}", ""),
            (7, "MapCity", "inline", "", "", "", "", ""),
            (8, "__Helper", "inline", "", "", "", "", "delimiter=|"),
            (9, "regions_{p_size}", "excel", "lib://Shared/geo/regions_{p_size}.xlsx", "Shared", "geo/regions_{p_size}.xlsx", "",
             "ooxml=true; embedded_labels=true; table=Sheet1$"),
            (10, "{p_name}", "delimited", "extra_{p_partkey}.csv", "", "extra_{p_partkey}.csv", "", "txt=true; delimiter=\\t"),
            (12, "Live", "sql", "", "", "", "", ""),
            (13, "regions_{p_size}", "delimited", "lib://Other/regions_{p_size}.csv", "Other", "regions_{p_size}.csv", "", ""),
            (14, "Forecast", "unknown", "", "", "", "", ""),
        ],
    ),
)
def _sources(spark, sf_dir):
    return sc.script_sources(_loads(spark, sf_dir))


# load position, table, place, field, expression, derived, tags
FIELDS = [
    (5, "{p_name}", 0, "OrderID", "[Order ID]", False, "$key,$integer"),
    (5, "{p_name}", 1, "Amount", "Amount", False, "$numeric"),
    (5, "{p_name}", 2, "Net, {p_brand}", "Num(Round(Amount * (1 + 0.2), 2), '#,##0')", True, ""),
    (5, "{p_name}", 3, "Note", "'a, b'", True, ""),
    (5, "{p_name}", 4, "Year(OrderDate)", "Year(OrderDate)", True, ""),
    (6, "Stores", 0, "StoreID", "StoreID", False, ""),
    (6, "Stores", 1, "City", "City", False, ""),
    (7, "MapCity", 0, "code", "code", False, ""),
    (7, "MapCity", 1, "label", "label", False, ""),
    (8, "__Helper", 0, "k", "k", False, ""),
    (8, "__Helper", 1, "v", "v", False, ""),
    (9, "regions_{p_size}", 0, "Region", "Region", False, ""),
    (9, "regions_{p_size}", 1, "Sales {p_size}", '"Sales {p_size}"', False, ""),
    (10, "{p_name}", 0, "orderid", "[Order ID]", False, ""),
    (10, "{p_name}", 1, "Discount", "Discount", False, ""),
    (12, "Live", 0, "id", "id", False, ""),
    (12, "Live", 1, "total", "total", False, ""),
    (13, "regions_{p_size}", 0, "Region", "Region", False, ""),
    (13, "regions_{p_size}", 1, "Manager", "Manager", False, ""),
    (14, "Forecast", 0, "Area", "Mid(Code, 1, 2)", True, ""),
    (14, "Forecast", 1, "Left(Code, 2)", "Left(Code, 2)", True, ""),
]
FIELD_NAMES = ["load_pos", '"table"', "pos", "field", "expression", "is_derived", "tags"]
# repeated loads merged: an earlier field of the same name wins
MERGED = [f for f in FIELDS if (f[0], f[2]) not in {(10, 0), (13, 0)} and f[0] not in (7, 8)]


@query("script_fields", sql_rows(PARTS, FIELD_NAMES, FIELDS))
def _fields(spark, sf_dir):
    out = sc.script_fields(_loads(spark, sf_dir)).drop("kind", "is_mapping", "is_hidden")
    return out.withColumn("tags", F.array_join("tags", ","))


@query("script_table_fields", sql_rows(PARTS, FIELD_NAMES, MERGED))
def _table_fields(spark, sf_dir):
    out = sc.table_fields(_tables(spark, sf_dir)).drop("kind")
    return out.withColumn("tags", F.array_join("tags", ","))


@query(
    "visible_tables",
    sql_rows(
        PARTS, ['"table"', "first_pos", "n_loads"],
        [("{p_name}", 5, 2), ("Stores", 6, 1), ("regions_{p_size}", 9, 2), ("Live", 12, 1), ("Forecast", 14, 1)],
    ),
)
def _visible(spark, sf_dir):
    return sc.visible_tables(_tables(spark, sf_dir))


@query("default_roots", sql_rows(PARTS, ["root"], [("/data/{p_brand}",), ("/data/Shared",)], {0: "kind <> 'fixed'", 1: "kind = 'fixed'"}))
def _roots(spark, sf_dir):
    return sc.default_roots(_loads(spark, sf_dir), "/data/")


_STATUS = [
    (5, "{p_name}", "{kind}", "lib://{p_brand}/" + _PATH, "connected", "", 2, 2, 3, "WHERE Amount > {p_size}"),
    (5, "{p_name}", "qvd", "lib://{p_brand}/" + _PATH, "schema-only", REASONS["qvd"], 5, 2, 3, "WHERE Amount > {p_size}"),
    (5, "{p_name}", "fixed", "lib://{p_brand}/" + _PATH, "schema-only", REASONS["fixed"], 5, 2, 0, "WHERE Amount > {p_size}"),
    (6, "Stores", "resident", "{p_name}", "connected", "", 2, 0, 0, "WHERE City <> 'x;y'"),
    (7, "MapCity", "inline", "", "connected", "", 2, 0, 0, ""),
    (8, "__Helper", "inline", "", "connected", "", 2, 0, 0, ""),
    (9, "regions_{p_size}", "excel", "lib://Shared/geo/regions_{p_size}.xlsx", "connected", "", 2, 0, 0, ""),
    (10, "{p_name}", "delimited", "extra_{p_partkey}.csv", "connected", "", 2, 0, 0, ""),
    (12, "Live", "sql", "", "schema-only", REASONS["sql"], 2, 0, 0, ""),
    (13, "regions_{p_size}", "delimited", "lib://Other/regions_{p_size}.csv", "connected", "", 2, 0, 0, ""),
    (14, "Forecast", "unknown", "", "schema-only", REASONS["unknown"], 2, 0, 0, ""),
]
_BY_KIND = {0: READABLE, 1: "kind = 'qvd'", 2: "kind = 'fixed'"}


@query(
    "load_status",
    sql_rows(PARTS, ["pos", '"table"', "kind", "path", "status", "reason", "n_columns", "n_typed", "n_dropped", "unapplied_filter"], _STATUS, _BY_KIND),
)
def _status(spark, sf_dir):
    return sc.load_status(_loads(spark, sf_dir))


_TABLES = [
    ("{p_name}", "{kind}", "lib://{p_brand}/" + _PATH, "connected", 3, 2, 3),
    ("{p_name}", "qvd", "lib://{p_brand}/" + _PATH, "schema-only", 6, 2, 3),
    ("{p_name}", "fixed", "lib://{p_brand}/" + _PATH, "schema-only", 6, 2, 0),
    ("Stores", "resident", "{p_name}", "connected", 2, 0, 0),
    ("regions_{p_size}", "excel", "lib://Shared/geo/regions_{p_size}.xlsx", "connected", 3, 0, 0),
    ("Live", "sql", "", "schema-only", 2, 0, 0),
    ("Forecast", "unknown", "", "schema-only", 2, 0, 0),
]


@query(
    "audit_tables",
    sql_rows(PARTS, ['"table"', "kind", "path", "status", "n_columns", "n_typed", "n_dropped"], _TABLES, _BY_KIND),
)
def _audit_tables(spark, sf_dir):
    return sc.audit_tables(_tables(spark, sf_dir))


_DROPPED = [
    ("{p_name}", "Net, {p_brand}", "Num(Round(Amount * (1 + 0.2), 2), '#,##0')"),
    ("{p_name}", "Note", "'a, b'"),
    ("{p_name}", "Year(OrderDate)", "Year(OrderDate)"),
]
_FILES = "kind <> 'fixed'"


@query("dropped_fields", sql_rows(PARTS, ['"table"', "field", "expression"], _DROPPED, dict.fromkeys(range(3), _FILES)))
def _dropped(spark, sf_dir):
    return sc.dropped_fields(_loads(spark, sf_dir))


_FIRST_FIELDS = [(i, f[3], {"OrderID": "int64", "Amount": "double"}.get(f[3], "string")) for i, f in enumerate(FIELDS[:5])]


@query(
    "scan_schema_only",
    sql_rows(
        PARTS, ['"table"', "pos", "field", "type", "reason"],
        [("{p_name}", i, f, t, REASONS["qvd"]) for i, f, t in _FIRST_FIELDS]
        + [("{p_name}", i, f, t, REASONS["fixed"]) for i, f, t in _FIRST_FIELDS]
        + [("Live", 0, "id", "string", REASONS["sql"]), ("Live", 1, "total", "string", REASONS["sql"]),
           ("Forecast", 0, "Area", "string", REASONS["unknown"]), ("Forecast", 1, "Left(Code, 2)", "string", REASONS["unknown"])],
        {**dict.fromkeys(range(5), "kind = 'qvd'"), **dict.fromkeys(range(5, 10), "kind = 'fixed'")},
    ),
)
def _schema_only(spark, sf_dir):
    return sc.schema_only_columns(_loads(spark, sf_dir))


_PLAIN = [
    "OrderID", "Amount", "Net, {p_brand}", "Note", "StoreID", "City", "code", "label", "k", "v", "Region", "Sales {p_size}", "Discount", "id",
    "total", "Manager", "Area",
]


@query("script_field_names", sql_rows(PARTS, ["pos", "field"], list(enumerate(_PLAIN))))
def _field_names(spark, sf_dir):
    return sc.script_field_names(part_scripts(spark, sf_dir))


@query(
    "check_schema_diff",
    sql_rows(
        PARTS, ['"table"', '"column"', "problem"],
        [
            ("{p_name}", "Net, {p_brand}", "declared but not emitted"),
            ("{p_name}", "Note", "declared but not emitted"),
            ("{p_name}", "Year(OrderDate)", "declared but not emitted"),
            ("{p_name}", "Extra {p_size}", "emitted but not declared"),
            ("Forecast", "Area", "declared but not emitted"),
            ("Forecast", "Left(Code, 2)", "declared but not emitted"),
        ],
    ),
)
def _schema_diff(spark, sf_dir):
    declared = sc.table_fields(_tables(spark, sf_dir)).withColumnRenamed("field", "column")
    held = [(t, f, "connected") for _, t, _, f, _, derived, _ in MERGED if not derived]
    held += [("{p_name}", "Extra {p_size}", "connected"), ("Live", "late", "schema-only")]
    rows = F.array(
        *[F.struct(filled(t).alias("table"), filled(c).alias("column"), F.lit(status).alias("status")) for t, c, status in held]
    )
    emitted = spread(read(spark, sf_dir, "part")).select(filled("app{p_partkey}").alias("app"), F.inline(rows))
    return checks.schema_diff(declared, emitted)


# --- expressions ------------------------------------------------------------------

# expression, class, function, field, function2, field2, filter field, values, measure name
CLASSES = [
    ("Sum([{p_name}])", "simple", "sum", "{p_name}", "", "", "", "", "{titled} Sum"),
    ("count(distinct {p_type})", "count_distinct", "count", "{p_type}", "", "", "", "", "Unique {p_type}"),
    (" Count ( [{p_brand}] ) ", "count", "count", "{p_brand}", "", "", "", "", "{p_brand} Count"),
    ("MEDIAN(order_qty)", "simple", "median", "order_qty", "", "", "", "", "Order_Qty Median"),
    ("Stdev(x)", "simple", "stdev", "x", "", "", "", "", "X Std Dev"),
    ("Only([{p_type}])", "simple", "only", "{p_type}", "", "", "", "", "{p_type} Value"),
    ("Sum(Profit)/Sum([{p_name}])", "ratio", "sum", "Profit", "sum", "{p_name}", "", "", "Profit per {titled}"),
    ("avg(a) / COUNT(B)", "ratio", "avg", "a", "count", "B", "", "", "A per B"),
    ("Count({<Status={'{p_type}'}>} CaseID)", "filtered_eq", "count", "CaseID", "", "", "Status", "{p_type}", "CaseID Count ({p_type})"),
    ("Sum({< [{p_name}] = {'a', \"{p_brand}\"} >} [Net Sales])", "filtered_in", "sum", "Net Sales", "", "", "{p_name}", "a|{p_brand}",
     "Net Sales Sum (Filtered)"),
    ("Sum({<Year={}>} Sales)", "filtered_in", "sum", "Sales", "", "", "Year", "", "Sales Sum (Filtered)"),
    ("Sum(a)+Count(b)", "unresolved", "", "", "", "", "", "", "[Needs Review] Sum a Count b"),
    ("Sum(a*{p_size})", "unresolved", "", "", "", "", "", "", "[Needs Review] Sum a {p_size}"),
    ("", "rows", "", "", "", "", "", "", "Total Count"),
    ("***", "unresolved", "", "", "", "", "", "", "[Needs Review] Expression"),
]
TITLED = """(SELECT *, 'app' || p_partkey AS app,
    upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS titled FROM part)"""


@query(
    "expr_classes",
    sql_rows(
        TITLED,
        ["pos", "class", "function", "field", "function2", "field2", "filter_field", '"values"', "measure"],
        [(i, *c[1:]) for i, c in enumerate(CLASSES)],
    ),
)
def _classes(spark, sf_dir):
    out = ex.classify(part_expressions(spark, sf_dir, [c[0] for c in CLASSES]))
    return out.drop("expression").withColumn("values", F.array_join("values", "|"))


_ROUTED = [
    ("Sum([{p_name}])", ["{p_brand} T"]),
    ("Sum(Amount)/Count(CITY)", ["Orders", "Stores"]),
    ("Max(nothing)", []),
    ("Sum({<City={'x'}>} [{p_name}])", ["{p_brand} T", "Stores"]),
]


@query(
    "measure_targets",
    sql_rows(
        "(SELECT *, 'app' || p_partkey AS app FROM part)", ["expression", '"table"'],
        [(e, t) for e, tables in _ROUTED for t in tables],
    ),
)
def _targets(spark, sf_dir):
    owned = F.array(
        *[
            F.struct(filled(t).alias("table"), filled(f).alias("field"))
            for t, f in (("Orders", "Amount"), ("Stores", "City"), ("{p_brand} T", "{p_name}"), ("{p_brand} T", "other"))
        ]
    )
    fields = read(spark, sf_dir, "part").select(filled("app{p_partkey}").alias("app"), F.inline(owned))
    return ex.measure_targets(part_expressions(spark, sf_dir, [e for e, _ in _ROUTED]), fields)


_LONG = "Sum(a | b)\nAggr(Concat(DISTINCT [{p_name}], ' '), [Region], [Category], [Quarter], [Month], [Week], [Day])"


@query(
    "audit_details",
    sql_rows(PARTS, ['"table"', "field", "detail", "section"], [(*d, "dropped field") for d in _DROPPED], dict.fromkeys(range(3), _FILES))
    + f"""\nUNION ALL SELECT app, p_name, '', substr(replace(replace({sql_text(_LONG)}, chr(10), ' '), '|', '\\|'), 1, 90), 'unresolved expression'
        FROM {PARTS}""",
)
def _details(spark, sf_dir):
    texts = read(spark, sf_dir, "part").select(
        filled("app{p_partkey}").alias("app"), F.col("p_name").alias("table"), filled(_LONG).alias("expression")
    )
    unresolved = ex.classify(texts).where("class = 'unresolved'")
    return checks.audit_details(sc.dropped_fields(_loads(spark, sf_dir)), unresolved)


# --- references --------------------------------------------------------------------


def _columns(spark, sf_dir):
    rows = F.array(
        *[
            F.struct(filled(t).alias("table"), filled(c).alias("column"))
            for t, c in (("{p_name}", "Amount"), ("{p_name}", "Order {p_size}"), ("Stores", "City"))
        ]
    )
    return read(spark, sf_dir, "part").select(filled("app{p_partkey}").alias("app"), F.inline(rows))


def _model_tables(spark, sf_dir):
    names = F.array(filled("{p_name}"), F.lit("Stores"), filled("Empty {p_type}"))
    return read(spark, sf_dir, "part").select(filled("app{p_partkey}").alias("app"), F.explode(names).alias("table"))


def _model_measures(spark, sf_dir):
    texts = {
        "good": "SUM('{p_name}'[Amount])",
        "mixed": "DIVIDE(SUM('{p_name}'[Order {p_size}]), COUNTA('Stores'[Zone]), 0)",
        "lost {p_size}": "SUM('{p_type}'[Amount]) + SUM('{p_type}'[Amount]) + SUM('Empty {p_type}'[x])",
    }
    rows = F.array(
        *[F.struct(filled("{p_name}").alias("table"), filled(m).alias("measure"), filled(e).alias("expression")) for m, e in texts.items()]
    )
    return read(spark, sf_dir, "part").select(filled("app{p_partkey}").alias("app"), F.inline(rows))


APPS = "(SELECT *, 'app' || p_partkey AS app FROM part)"


@query(
    "check_measure_refs",
    sql_rows(
        APPS, ['"table"', "measure", "ref_table", "ref_column", "problem"],
        [
            ("{p_name}", "mixed", "Stores", "Zone", "unknown column"),
            ("{p_name}", "lost {p_size}", "{p_type}", "Amount", "unknown table"),
            ("{p_name}", "lost {p_size}", "Empty {p_type}", "x", "unknown column"),
        ],
    ),
)
def _measure_refs(spark, sf_dir):
    return checks.check_measure_refs(_model_measures(spark, sf_dir), _columns(spark, sf_dir), _model_tables(spark, sf_dir))


_PROJECTIONS = [
    ("v1", "Column", "{p_name}", "Amount", ""),
    ("v1", "Measure", "{p_name}", "good", ""),
    ("v2", "Measure", "{p_name}", "Amount", "no such measure"),
    ("v2", "Column", "Stores", "Zone {p_size}", "no such column"),
    ("v3", "Column", "{p_type}", "City", "unknown table"),
    ("v3", "Measure", "{p_name}", "lost {p_size}", ""),
]


@query(
    "check_visual_refs",
    sql_rows(APPS, ["visual", "kind", "entity", "property", "problem"], [p for p in _PROJECTIONS if p[4]]),
)
def _visual_refs(spark, sf_dir):
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("visual"), F.lit(k).alias("kind"), filled(e).alias("entity"), filled(p).alias("property"))
            for v, k, e, p, _ in _PROJECTIONS
        ]
    )
    visuals = read(spark, sf_dir, "part").select(filled("app{p_partkey}").alias("app"), F.inline(rows))
    return checks.check_visual_refs(
        visuals, _columns(spark, sf_dir), _model_measures(spark, sf_dir), _model_tables(spark, sf_dir)
    )


@query("check_empty_tables", sql_rows(APPS, ['"table"'], [("Empty {p_type}",)]))
def _empty_tables(spark, sf_dir):
    return checks.check_empty_tables(_model_tables(spark, sf_dir), _columns(spark, sf_dir))


@query(
    "audit_type_evidence",
    """SELECT 'app' || p_partkey AS app, 'T' AS "table", CAST(2 AS INTEGER) AS n_columns, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_typed,
        'WHERE B > 1' AS unapplied_filter FROM part""",
)
def _type_evidence(spark, sf_dir):
    """Types of a field by tags in the script, in the data model, in both, or in neither."""
    part = spread(read(spark, sf_dir, "part")).withColumn("app", F.concat(F.lit("app"), F.col("p_partkey").cast("string")))
    in_script = F.when(F.col("p_size") % 4 >= 2, " Tagged ('$integer')").otherwise("")
    scripts = part.select(
        "app", F.concat(F.lit("T: LOAD a"), in_script, F.lit(", B FROM [t.csv] (txt, embedded labels) WHERE B > 1;")).alias("script")
    )
    in_model = F.when(F.col("p_size") % 2 == 1, F.array(F.lit("$integer"), F.lit("$numeric"))).otherwise(F.array().cast("array<string>"))
    metadata = part.select("app", F.lit("A").alias("field"), in_model.alias("tags"), F.lit(False).alias("is_numeric"))
    return sc.load_status(sc.parse_loads(scripts), metadata).select("app", "table", "n_columns", "n_typed", "unapplied_filter")
