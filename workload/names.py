"""Names and types: cleaning, unique names, roles, types by evidence, owners of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import fixed, names
from tallyloom.functions.types import resolve_type
from tallyloom.operators import checks, fields as field_ops, preview, profile
from tallyloom.operators.tokens import file_candidates
from workload.derive import filled, read, spread
from workload.registry import query, sql_rows, sql_text

PART_APP = "(SELECT *, 'app' || p_partkey AS app FROM part)"


def _part(spark, sf_dir):
    return spread(read(spark, sf_dir, "part")).withColumn("app", filled("app{p_partkey}"))


def _sql_match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


@query(
    "safe_names",
    r"""SELECT page_id AS id, name,
          CASE WHEN clean = '' THEN '{default}' WHEN regexp_matches(clean, '^[0-9]') THEN 'T_' || clean ELSE clean END AS safe
        FROM (SELECT page_id, name, trim(regexp_replace(regexp_replace(name, '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9_]', '_', 'g'), '_') AS clean
              FROM (SELECT page_id, unnest([url, ' ' || page_id || '/' || url, '__' || url || '?!', '#' || repeat('?', CAST(page_id % 3 AS INTEGER))]) AS name FROM pages))""".replace(
        "{default}", fixed.DEFAULT_TABLE_NAME
    ),
)
def _safe(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    variants = F.array(
        F.col("url"), filled(" {page_id}/{url}"), filled("__{url}?!"),
        F.concat(F.lit("#"), F.repeat(F.lit("?"), (F.col("page_id") % 3).cast("int"))),
    )
    named = pages.select(F.col("page_id").alias("id"), F.explode(variants).alias("name"))
    return named.withColumn("safe", names.safe_table_name(F.col("name")))


_COLUMNS = ["{p_name}", "{p_name}_2", " {p_brand} ", "Data", "{p_name}", "data", "{p_type}", "lower {p_type}", "", "Query", "{p_type}"]
_SANITIZED = [
    "{p_name}", "{p_name}_2", "{p_brand}", "Entity_Data", "{p_name}_3", "Entity_data_2", "{p_type}", "lower {p_type}",
    "Column", "Entity_Query", "{p_type}_2",
]


@query(
    "sanitize_columns",
    sql_rows(PART_APP, ["pos", "name"], [(i, name) for i, name in enumerate(_SANITIZED)]),
)
def _sanitize(spark, sf_dir):
    schema = F.array(*[filled(t) for t in _COLUMNS])
    return _part(spark, sf_dir).select("app", F.posexplode(names.sanitize_columns(schema)).alias("pos", "name"))


@query(
    "dedupe_columns",
    sql_rows(
        "(SELECT *, 'app' || p_partkey AS app, upper(p_name) AS shouted, lower(p_type) AS small FROM part)",
        ["pos", "name"],
        list(enumerate(["{p_name}", "{shouted}_2", "{p_name}_2_2", "{p_brand}", "{p_name}_3", "{p_type}", "{small}_2", "{p_name}_4"])),
    ),
)
def _dedupe(spark, sf_dir):
    part = _part(spark, sf_dir).withColumns({"shouted": F.upper("p_name"), "small": F.lower("p_type")})
    schema = ["{p_name}", "{shouted}", "{p_name}_2", "{p_brand}", "{p_name}", "{p_type}", "{small}", "{p_name}"]
    unique = names.unique_columns(F.array(*[filled(t) for t in schema]))
    return part.select("app", F.posexplode(unique).alias("pos", "name"))


@query(
    "dedupe_measures",
    sql_rows(
        "(SELECT *, 'app' || p_partkey AS app, replace(p_name, ' ', '_') AS joined, replace(p_brand, '#', '') AS bare FROM part)",
        ["pos", "measure"],
        list(enumerate(["Total_Sum_{joined}", "Total_Sum_{joined}_2", "Total_Sum{bare}", "Total_Measure_4", "Total_{p_type}_2", "Total_sum_{joined}_3"])),
    ),
)
def _measures(spark, sf_dir):
    expressions = F.array(
        *[filled(t) for t in ("Sum [{p_name}]", "Sum {p_name}", "Sum({p_brand})", " !!! ", "{p_type}", "sum ({p_name})")]
    )
    columns = F.array(filled("total_{p_type}"), filled("{p_name}"))
    named = names.measure_names(expressions, columns)
    return _part(spark, sf_dir).select("app", F.posexplode(named).alias("pos", "measure"))


_NAME_FORMS = [
    "{p_name}", "Sales {p_brand}", "{p_type} rate", "qty_{p_size}", "{p_brand}Type", "Customer {p_size}", "e-mail {p_name}",
    "Email{p_size}", "{p_size}_id", "%{p_name}", "my key {p_size}", "Region", "Price of {p_name}",
]


def _name_sql(select: str) -> str:
    rows = ", ".join(sql_text(t) for t in _NAME_FORMS)
    return f"SELECT app, pos, name, {select} FROM (SELECT app, unnest([{rows}]) AS name, unnest(range({len(_NAME_FORMS)}))::INTEGER AS pos FROM {PART_APP})"


def _named(spark, sf_dir):
    forms = F.array(*[filled(t) for t in _NAME_FORMS])
    return _part(spark, sf_dir).select("app", F.posexplode(forms).alias("pos", "name"))


@query("name_types", _name_sql(f"CASE WHEN {_sql_match('name', fixed.NUMERIC_NAME)} THEN 'double' ELSE 'string' END AS type"))
def _name_types(spark, sf_dir):
    return _named(spark, sf_dir).withColumn("type", names.name_type(F.col("name")))


@query(
    "pii_fields",
    f"SELECT app, 't' AS \"table\", name AS field FROM ({_name_sql('1')}) WHERE " + _sql_match("name", "|".join(fixed.PII_WORDS)),
)
def _pii(spark, sf_dir):
    listed = _named(spark, sf_dir).select("app", F.lit("t").alias("table"), F.col("name").alias("field"))
    return profile.pii_fields(listed)


@query(
    "field_roles",
    sql_rows(
        """(SELECT *, 'app' || p_partkey AS app,
             CASE p_type WHEN 'ECONOMY' THEN 'Unit Price' WHEN 'SMALL' THEN 'Genre' WHEN 'STANDARD' THEN 'ShipState' WHEN 'LARGE' THEN 'Code' ELSE 'Plain' END AS kind FROM part)""",
        ["numeric_role", "category_role", "identifier_role", "default_dim"],
        [
            ("Unit Price", "x{p_size}", "x{p_size}", "x{p_size}"),
            ("last {p_brand}", "Genre", "x{p_size}", "Genre"),
            ("last {p_brand}", "ShipState", "x{p_size}", "x{p_size}"),
            ("last {p_brand}", "x{p_size}", "Code", "x{p_size}"),
            ("last {p_brand}", "x{p_size}", "x{p_size}", "x{p_size}"),
        ],
        {0: "kind = 'Unit Price'", 1: "kind = 'Genre'", 2: "kind = 'ShipState'", 3: "kind = 'Code'", 4: "kind = 'Plain'"},
    ),
)
def _roles(spark, sf_dir):
    kind = F.expr(
        "CASE p_type WHEN 'ECONOMY' THEN 'Unit Price' WHEN 'SMALL' THEN 'Genre' WHEN 'STANDARD' THEN 'ShipState'"
        " WHEN 'LARGE' THEN 'Code' ELSE 'Plain' END"
    )
    listed = F.array(filled("x{p_size}"), F.col("kind"), filled("last {p_brand}"))
    return _part(spark, sf_dir).withColumn("kind", kind).select(
        "app",
        names.numeric_role(listed).alias("numeric_role"),
        names.category_role(listed).alias("category_role"),
        names.identifier_role(listed).alias("identifier_role"),
        names.default_dimension(listed).alias("default_dim"),
    )


_TAGGED = [
    ("Booked {p_size}", ["$DATE", "$numeric"], False, "dateTime"),
    ("Stamp", ["$timestamp", "$text"], True, "dateTime"),
    ("Note", ["$ascii", "$text"], True, "string"),
    ("Size {p_size}", ["$numeric", "$integer", "$text"], True, "int64"),
    ("{p_name}", ["$numeric"], False, "double"),
    ("Flag", [], True, "double"),
    ("{p_brand}_id", ["$integer"], True, "int64"),
    ("%Key", ["$integer"], True, "int64"),
    ("Bare", [], False, "string"),
]
_SCRIPT_TAGS = [("BARE", ["$numeric"]), ("Only {p_type}", ["$date"]), ("note", ["$key"]), ("FLAG", ["$integer"])]
_RESOLVED = [(n, "int64" if n == "Flag" else "double" if n == "Bare" else t) for n, _, _, t in _TAGGED] + [
    ("Only {p_type}", "dateTime")
]


def _is_measure(name: str, kind: str) -> bool:
    return kind in ("int64", "double") and not name.startswith("%") and not name.endswith("_id")


def _metadata(spark, sf_dir):
    rows = F.array(
        *[
            F.struct(
                filled(n).alias("field"),
                F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
                F.lit(numeric).alias("is_numeric"),
            )
            for n, tags, numeric, _ in _TAGGED
        ]
    )
    return _part(spark, sf_dir).select("app", F.inline(rows))


@query(
    "resolve_types",
    sql_rows(PART_APP, ["field", "type"], [(n, t) for n, _, _, t in _TAGGED]),
)
def _resolve(spark, sf_dir):
    return _metadata(spark, sf_dir).select("app", "field", resolve_type(F.col("tags"), F.col("is_numeric")).alias("type"))


@query(
    "measurable_columns",
    sql_rows(PART_APP, ["field", "type", "is_measurable"], [(n, t, _is_measure(n, t)) for n, t in _RESOLVED]),
)
def _measurable(spark, sf_dir):
    rows = F.array(
        *[F.struct(filled(n).alias("field"), F.array(*[F.lit(t) for t in tags]).alias("tags")) for n, tags in _SCRIPT_TAGS]
    )
    script = _part(spark, sf_dir).select("app", F.inline(rows))
    return field_ops.resolve_types(_metadata(spark, sf_dir), script)


_FILE_NAMES = "src {p_type} of-{p_name}_{p_brand} data"


@query(
    "filename_candidates",
    """WITH words AS (SELECT 'app' || p_partkey AS app, w, i FROM (
           SELECT p_partkey, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
             SELECT p_partkey, list_filter(regexp_split_to_array('src ' || p_type || ' of-' || p_name || '_' || p_brand || ' data', '[^a-zA-Z0-9]'), lambda x: length(x) >= 3 AND lower(x) <> 'data') AS ws FROM part))),
       titled AS (SELECT app, i, upper(w[1]) || lower(w[2:]) AS w FROM words),
       firsts AS (SELECT app, w, min(i) AS i FROM titled GROUP BY app, w),
       spread AS (SELECT app, i, unnest([w, w || '_ID', w || '_Category', w || '_Rating']) AS name, unnest(range(4)) AS k FROM firsts)
       SELECT app, CAST(row_number() OVER (PARTITION BY app ORDER BY i, k) - 1 AS INTEGER) AS pos, name FROM spread""",
)
def _file_candidates(spark, sf_dir):
    return _part(spark, sf_dir).select(
        "app", F.posexplode(file_candidates(filled(_FILE_NAMES))).alias("pos", "name")
    )


# (load position, table, place, field) of the tables of one app
_OWNED = [
    (0, "Orders {p_brand}", 0, "OrderID"), (0, "Orders {p_brand}", 1, "{p_name}"), (0, "Orders {p_brand}", 2, "Amount"),
    (1, "Stores", 0, "orderid"), (1, "Stores", 1, "City"), (1, "Stores", 2, "AMOUNT"),
    (2, "Parts", 0, "city"), (2, "Parts", 1, "{p_type}"),
]
_OWNED_SQL = sql_rows(PART_APP, ["load_pos", '"table"', "pos", "field"], _OWNED)


def _owned(spark, sf_dir):
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("load_pos"), filled(t).alias("table"), F.lit(p).alias("pos"), filled(f).alias("field"))
            for a, t, p, f in _OWNED
        ]
    )
    return _part(spark, sf_dir).select("app", F.inline(rows))


@query(
    "field_owner",
    f"""SELECT app, lower(field) AS field, first("table" ORDER BY load_pos, pos) AS "table" FROM ({_OWNED_SQL}) GROUP BY 1, 2""",
)
def _owner(spark, sf_dir):
    return field_ops.field_owner(_owned(spark, sf_dir))


@query(
    "primary_table",
    f"""SELECT app, "table", n_fields FROM (
          SELECT app, "table", count(*) AS n_fields, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, min(load_pos)) AS r
          FROM ({_OWNED_SQL}) GROUP BY 1, 2) WHERE r = 1""",
)
def _primary(spark, sf_dir):
    return field_ops.primary_table(_owned(spark, sf_dir))


_PREVIEWED = ["rating_{s_nationkey}", "{s_name}", "Category {s_suppkey}", "City{s_nationkey}", "status", "Company {s_suppkey}", "row_code", "Note{s_suppkey}", "Sales {s_suppkey}"]


def _cycle(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][i % {len(words)} + 1]"


_PREVIEW_SQL = f"""
    SELECT s_suppkey, "column", CAST(i AS INTEGER) AS "row",
      CASE WHEN {_sql_match('"column"', fixed.NUMERIC_NAME)} THEN
             CASE WHEN {_sql_match('"column"', 'rating|score')} THEN CAST(CAST((30 + i % 20) / 10.0 AS DECIMAL(3, 1)) AS VARCHAR)
                  ELSE CAST((i * 125 + 450) % 8500 + 150 AS VARCHAR) END
           WHEN {_sql_match('"column"', 'category|type|genre')} THEN {_cycle(fixed.PREVIEW_CATEGORIES)}
           WHEN {_sql_match('"column"', 'city|location|state|region|country')} THEN {_cycle(fixed.PREVIEW_CITIES)}
           WHEN {_sql_match('"column"', 'status')} THEN {_cycle(fixed.PREVIEW_STATUSES)}
           WHEN {_sql_match('"column"', 'merchant|company|customer|name')} THEN {_cycle(fixed.PREVIEW_MERCHANTS)} || ' ' || i
           WHEN {_sql_match('"column"', 'id|code|key')} THEN "column" || '_' || (1000 + i)
           ELSE "column" || '_' || i END AS "value", true AS synthetic
    FROM (SELECT s_suppkey, unnest([{", ".join(sql_text(t) for t in _PREVIEWED)}]) AS "column" FROM supplier), range(1, 101) r(i)"""


def _synthetic(spark, sf_dir):
    supplier = spread(read(spark, sf_dir, "supplier"))
    columns = supplier.select("s_suppkey", F.explode(F.array(*[filled(t) for t in _PREVIEWED])).alias("column"))
    return preview.synthetic_preview(columns)


query("synthetic_preview", _PREVIEW_SQL)(_synthetic)


@query(
    "check_fabricated_preview",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{w}' AS token, count(*) FILTER (WHERE contains(\"{c}\", '{w}')) AS n FROM ({_PREVIEW_SQL})"
        for c in ("column", "value")
        for w in fixed.FABRICATED_TOKENS
    ),
)
def _fabricated(spark, sf_dir):
    return checks.fabricated(_synthetic(spark, sf_dir))


@query(
    "check_fabricated_rows",
    f"SELECT s_suppkey, count(*) AS n FROM ({_PREVIEW_SQL}) WHERE regexp_matches(\"value\", '{'|'.join(fixed.FABRICATED_TOKENS)}') GROUP BY 1",
)
def _fabricated_rows(spark, sf_dir):
    made_up = _synthetic(spark, sf_dir)
    return made_up.where(checks.has_fabricated(made_up)).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))
