"""Loads from every kind of source, projections, unions, profiles, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.functions.types import TypeBook, is_measurable, resolve_type, typed
from tallyloom.operators import checks, preview, profile
from tallyloom.session import scratch_path
from tallyloom.sources.load import concatenate, inline_body, load_all, load_table, select_or_null
from tallyloom.sources.spec import Field, LoadSpec, Source
from tallyloom.sources.rejects import load_checked
from workload.derive import filled, read
from workload.derive_files import as_text, party_workbooks, written, written_files, written_lines
from workload.registry import query

ORDER_TYPES = TypeBook(
    [
        {"name": "OrderKey", "tags": ["$numeric", "$integer"]},
        {"name": "Price", "tags": ["$numeric"], "is_numeric": True},
        {"name": "OrderDate", "tags": ["$timestamp"]},
        {"name": "Status", "tags": ["$text", "$ascii"]},
    ]
)
ORDER_FIELDS = (
    Field("OrderKey", "o_orderkey"),
    Field("Price", "o_totalprice"),
    Field("OrderDate", "o_orderdate"),
    Field("Status", "o_orderstatus"),
    Field("Missing"),
)
ORDER_SQL = """SELECT o_orderkey AS OrderKey, o_totalprice AS Price, o_orderdate AS OrderDate,
    o_orderstatus AS Status, CAST(NULL AS VARCHAR) AS Missing FROM orders"""


@query("scan_delimited", ORDER_SQL)
def _delimited(spark, sf_dir):
    orders = as_text(read(spark, sf_dir, "orders"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = written(orders, scratch_path(spark, "orders-csv"), "csv", sep=";", header=True, encoding="windows-1252")
    options = {"txt": True, "codepage": "1252", "embedded_labels": True, "delimiter": ";"}
    spec = LoadSpec("Orders", Source("delimited", path, options), ORDER_FIELDS)
    return load_table(spark, spec, ORDER_TYPES)[0]


@query("scan_delimited_by_position", "SELECT c_custkey AS k, c_name AS n, c_acctbal AS b FROM customer")
def _by_position(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = written(as_text(customer), scratch_path(spark, "customer-tab"), "csv", sep="\t", header=False)
    types = TypeBook([{"name": "k", "tags": ["$integer", "$numeric"]}, {"name": "b", "is_numeric": True}])
    source = Source("", f"{path}/*.csv", {"delimiter": "\\t"})
    return load_table(spark, LoadSpec("Customer", source, (Field("k"), Field("n"), Field("b"))), types)[0]


@query("scan_delimited_quoted", "SELECT doc_id, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def _quoted(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = written(as_text(texts), scratch_path(spark, "documents-csv"), "csv", header=True, escape='"', quoteAll=True)
    options = {"embedded_labels": True, "codepage": "65001", "multiline": True}
    types = TypeBook([{"name": "doc_id", "tags": ["$integer", "$numeric"]}])
    fields = (Field("doc_id"), Field("lang"), Field("text"))
    df = load_table(spark, LoadSpec("Texts", Source("delimited", path, options), fields), types)[0]
    return df.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))


@query(
    "scan_delimited_mixed_headers",
    """SELECT o_orderkey AS OrderKey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS Price,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS OrderDate, o_orderstatus AS Status FROM orders""",
)
def _mixed_headers(spark, sf_dir):
    orders = as_text(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"))
    layouts = {
        "F": {"OrderKey": "o_orderkey", "Price": "o_totalprice", "Status": "o_orderstatus"},
        "O": {"Status": "o_orderstatus", "unasked": "o_orderkey", "OrderDate": "o_orderdate", "Price": "o_totalprice", "OrderKey": "o_orderkey"},
        "P": {"STATUS": "o_orderstatus", "orderkey": "o_orderkey"},
    }
    folder = scratch_path(spark, "orders-mixed")
    for status, names in layouts.items():
        part = orders.where(F.col("o_orderstatus") == status).select(*[F.col(c).alias(n) for n, c in names.items()])
        written(part, f"{folder}/{status}", "csv", sep="|", header=True)
    source = Source("delimited", f"{folder}/*", {"embedded_labels": True, "delimiter": "|"})
    fields = (Field("OrderKey"), Field("Price"), Field("OrderDate"), Field("Status"))
    return load_table(spark, LoadSpec("Orders", source, fields), ORDER_TYPES)[0]


def _faulty_orders(spark, sf_dir):
    """Orders of which some lines are too long or too short and some prices are no numbers."""
    orders = read(spark, sf_dir, "orders")
    line = (
        F.when(F.col("o_orderstatus") == "P", filled("{o_orderkey};{o_totalprice};\"{o_orderstatus};{o_custkey}\";{o_orderpriority}"))
        .when(F.col("o_orderpriority") == "1-URGENT", filled("{o_orderkey};{o_totalprice}"))
        .when(F.col("o_orderpriority") == "5-LOW", filled("{o_orderkey};about {o_totalprice};{o_orderstatus}"))
        .otherwise(filled("{o_orderkey};{o_totalprice};{o_orderstatus}"))
    )
    path = written_lines(orders.select(line), "OrderKey;Price;Status", scratch_path(spark, "orders-faulty"))
    source = Source("delimited", path, {"embedded_labels": True, "delimiter": ";"})
    return load_checked(spark, LoadSpec("Orders", source, (Field("OrderKey"), Field("Price"), Field("Status"))), ORDER_TYPES)


@query(
    "load_rejects",
    """SELECT 'Orders' AS load, 'cell count' AS reason, CAST(NULL AS VARCHAR) AS field,
         o_orderkey || ';' || o_totalprice || ';"' || o_orderstatus || ';' || o_custkey || '";' || o_orderpriority AS record
       FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT 'Orders', 'cell count', NULL, o_orderkey || ';' || o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'
       UNION ALL SELECT 'Orders', 'cell type', 'Price', 'about ' || o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW'""",
)
def _rejects(spark, sf_dir):
    return _faulty_orders(spark, sf_dir).rejects.drop("file")


@query(
    "load_status_checked",
    """SELECT 'Orders' AS load, 'connected' AS status, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT') AS rejected_rows,
         count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW') AS misfits FROM orders""",
)
def _status_checked(spark, sf_dir):
    checked = _faulty_orders(spark, sf_dir)
    n_rows = checked.rows.count()
    found = checked.finished()
    row = (found.table, found.status, n_rows, found.rejected_rows, dict(found.misfits).get("Price", 0))
    return spark.createDataFrame([row], "load string, status string, n_rows long, rejected_rows long, misfits long")


@query("scan_workbooks", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS absent FROM customer")
def _workbooks(spark, sf_dir):
    books = party_workbooks(spark, sf_dir)
    broken = books.select("path", F.substring("content", 1, 700).alias("content")).where("length(content) > 600")
    path = written_files(books.unionByName(broken), scratch_path(spark, "party-books"))
    fields = (Field("key", "Customer Key"), Field("name"), Field("balance", "Balance"), Field("absent"))
    types = TypeBook([{"name": "key", "tags": ["$integer", "$numeric"]}, {"name": "balance", "is_numeric": True}])
    source = Source("excel", path, {"embedded_labels": True, "table": "Data$"})
    return load_table(spark, LoadSpec("Party", source, fields), types)[0]


@query(
    "scan_inline",
    """SELECT o_orderkey, CAST(0 AS INTEGER) AS row, o_orderstatus AS code, o_orderpriority AS label, '' AS extra FROM orders
       UNION ALL SELECT o_orderkey, 1, 'x', CAST(o_custkey AS VARCHAR), 'y' FROM orders""",
)
def _inline(spark, sf_dir):
    block = filled("\ncode|label|extra\n\n {o_orderstatus} | '{o_orderpriority}'\n   \nx|\"{o_custkey}\"|y|cut\n")
    lines = read(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(inline_body(block, "|")).alias("row", "cells"))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return lines.select("o_orderkey", "row", cell(0).alias("code"), cell(1).alias("label"), cell(2).alias("extra"))


@query("scan_resident", "SELECT conv_id AS ConvID, role, CAST(NULL AS VARCHAR) AS score FROM conversations")
def _resident(spark, sf_dir):
    read(spark, sf_dir, "conversations").createOrReplaceTempView("talks")
    fields = (
        Field("ConvID", "conv_id"), Field("role"), Field("score"),
        Field("size", expression="Len(text)", is_derived=True),
    )
    return load_table(spark, LoadSpec("Talk", Source("resident", view="talks"), fields))[0]


@query("scan_parquet", "SELECT l_orderkey AS \"Order Key\", l_shipdate AS shipped, l_quantity FROM lineitem")
def _parquet(spark, sf_dir):
    fields = (Field("Order Key", "L_ORDERKEY"), Field("shipped", "l_shipdate"), Field("l_quantity"))
    spec = LoadSpec("Lines", Source(path="lib://Data\\lineitem.parquet"), fields)
    return load_table(spark, spec, root=sf_dir)[0]


@query("scan_json", ORDER_SQL)
def _json(spark, sf_dir):
    path = written(as_text(read(spark, sf_dir, "orders")), scratch_path(spark, "orders-json"), "json")
    return load_table(spark, LoadSpec("Orders", Source("json", path), ORDER_FIELDS), ORDER_TYPES)[0]


@query("scan_xml", ORDER_SQL)
def _xml(spark, sf_dir):
    orders = as_text(read(spark, sf_dir, "orders"))
    path = written(orders, scratch_path(spark, "orders-xml"), "xml", rowTag="order", rootTag="orders")
    source = Source("xml", path, {"row_tag": "order"})
    return load_table(spark, LoadSpec("Orders", source, ORDER_FIELDS), ORDER_TYPES)[0]


@query(
    "scan_sql",
    "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def _sql(spark, sf_dir):
    for name in ("customer", "nation"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"db_{name}")
    text = """SELECT n_name AS nation, count(*) AS n FROM db_customer
              JOIN db_nation ON c_nationkey = n_nationkey GROUP BY n_name"""
    return load_table(spark, LoadSpec("Live", Source("sql", text=text)))[0]


# --- projections ---------------------------------------------------------------


@query("select_missing_null", "SELECT c_name, CAST(NULL AS VARCHAR) AS email, c_custkey AS C_CustKey FROM customer")
def _missing(spark, sf_dir):
    return select_or_null(read(spark, sf_dir, "customer"), ["c_name", "email", "C_CustKey"])


@query(
    "type_columns",
    """SELECT l_orderkey, CAST(round_even(l_linenumber + 0.5, 0) AS BIGINT) AS halves,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS number,
       CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS day,
       l_partkey AS spaced, CASE WHEN l_linestatus = 'F' THEN true END AS flag,
       round(l_extendedprice / 1000000000, 14) AS tiny FROM lineitem""",
)
def _types(spark, sf_dir):
    texts = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        filled("{l_linenumber}.5").alias("halves"),
        F.when(F.col("l_returnflag") == "A", "n/a").otherwise(F.col("l_quantity").cast("string")).alias("number"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("string")).otherwise("").alias("day"),
        filled(" {l_partkey} ").alias("spaced"),
        F.when(F.col("l_linestatus") == "F", "yes").otherwise("maybe").alias("flag"),
        (F.col("l_extendedprice") / 1e9).cast("string").alias("tiny"),
    )
    kinds = {"l_orderkey": "int64", "halves": "int64", "number": "double", "day": "dateTime", "spaced": "int64",
             "flag": "boolean", "tiny": "double"}
    out = texts.select(*[typed(F.col(c), kind).alias(c) for c, kind in kinds.items()])
    return out.withColumn("tiny", F.round("tiny", 14))


@query("physical_columns", "SELECT event_id, user_id AS who FROM events")
def _physical(spark, sf_dir):
    fields = (
        Field("event_id"), Field("who", "user_id"),
        Field("hour", expression="Hour(ts)", is_derived=True), Field("double", expression="value*2", is_derived=True),
    )
    spec = LoadSpec("Events", Source("parquet", "events.parquet"), fields)
    return load_table(spark, spec, root=sf_dir)[0]


@query("project_alias", "SELECT p_name AS \"Part Name\", p_size AS Size, p_brand FROM part")
def _alias(spark, sf_dir):
    fields = (Field("Part Name", "p_name"), Field("Size", "P_SIZE"), Field("p_brand"))
    return load_table(spark, LoadSpec("Part", Source("parquet", "part.parquet"), fields), root=sf_dir)[0]


@query("load_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _distinct(spark, sf_dir):
    fields = (Field("user_id"), Field("event_type"))
    spec = LoadSpec("Users", Source("parquet", "events.parquet"), fields, distinct=True)
    return load_table(spark, spec, root=sf_dir)[0]


@query("load_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
def _where(spark, sf_dir):
    fields = (Field("o_orderkey"), Field("o_totalprice"))
    where = "o_orderstatus = 'F' and o_orderdate >= timestamp_ntz'1997-01-01'"
    spec = LoadSpec("Orders", Source("parquet", "orders.parquet"), fields, where=where)
    return load_table(spark, spec, root=sf_dir)[0]


@query("load_group_by", "SELECT o_custkey AS customer, round(sum(o_totalprice), 2) AS spent, count(o_orderkey) AS n FROM orders GROUP BY 1")
def _group_by(spark, sf_dir):
    fields = (
        Field("customer", "o_custkey"), Field("spent", measure=M.total("o_totalprice")),
        Field("n", measure=M.count("o_orderkey")),
    )
    spec = LoadSpec("Spending", Source("parquet", "orders.parquet"), fields, group_by=("o_custkey",), order_by=("spent",))
    return load_table(spark, spec, root=sf_dir)[0].withColumn("spent", F.round("spent", 2))


def _parties(spark, sf_dir):
    suppliers = LoadSpec(
        "Party", Source("parquet", "supplier.parquet"),
        (Field("Key", "s_suppkey"), Field("Name", "s_name"), Field("Balance", "s_acctbal")),
    )
    customers = LoadSpec(
        "PARTY", Source("parquet", "customer.parquet"),
        (Field("key", "c_custkey"), Field("name", "c_name"), Field("Segment", "c_mktsegment")),
    )
    return suppliers, customers


@query(
    "auto_concatenate",
    """SELECT s_suppkey AS "Key", s_name AS "Name", s_acctbal AS "Balance", NULL AS "Segment" FROM supplier
       UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""",
)
def _auto_concatenate(spark, sf_dir):
    loads = [(spec.name, load_table(spark, spec, root=sf_dir)[0]) for spec in _parties(spark, sf_dir)]
    return concatenate(loads)["Party"]


@query(
    "explicit_concatenate",
    """SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation
       UNION ALL SELECT r_regionkey, r_name, NULL FROM region""",
)
def _explicit(spark, sf_dir):
    specs = [
        LoadSpec("Places", Source("parquet", "nation.parquet"),
                 (Field("id", "n_nationkey"), Field("name", "n_name"), Field("region", "n_regionkey"))),
        LoadSpec("Helper", Source("parquet", "customer.parquet"), (Field("c_name"),), is_mapping=True),
        LoadSpec("More", Source("parquet", "region.parquet"),
                 (Field("ID", "r_regionkey"), Field("name", "r_name")), concatenate_to="places"),
    ]
    tables, _ = load_all(spark, specs, root=sf_dir)
    return tables["Places"]


# --- profiles, previews, content checks ------------------------------------------------


def _profile_sql(table: str, columns: list[tuple[str, str, str, str]]) -> str:
    """SQL profile of ``columns``: name, SQL of the byte size, tags, numeric flag."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS field, count(DISTINCT {c}) AS cardinality, count({c}) AS total_count,"
        f" {numeric} AS is_numeric, {tags} AS tags, CAST({size} AS BIGINT) AS byte_size FROM {table}"
        for c, size, tags, numeric in columns
    )


def _width(column: str, width: int) -> str:
    return f"count({column}) * {width}"


def _bytes(column: str) -> str:
    return f"coalesce(sum(octet_length(encode({column}))), 0)"


def _whole(column: str) -> str:
    return f"CASE WHEN bool_and({column} = floor({column})) THEN '$numeric,$integer' ELSE '$numeric' END"


def _text_tags(column: str) -> str:
    return f"CASE WHEN bool_and(octet_length(encode({column})) = length({column})) THEN '$text,$ascii' ELSE '$text' END"


@query(
    "profile_fields",
    _profile_sql(
        "lineitem",
        [(c, _width(c, 8), "'$numeric,$integer'", "true") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
        + [("l_linenumber", _width("l_linenumber", 4), "'$numeric,$integer'", "true")]
        + [(c, _width(c, 8), _whole(c), "true") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [(c, _bytes(c), _text_tags(c), "false") for c in ("l_returnflag", "l_linestatus")]
        + [("l_shipdate", _width("l_shipdate", 8), "'$timestamp'", "false")],
    )
    + " UNION ALL "
    + _profile_sql(
        "documents",
        [("doc_id", _width("doc_id", 8), "'$numeric,$integer'", "true")]
        + [(c, _bytes(c), _text_tags(c), "false") for c in ("text", "lang", "source")]
        + [("n_chars", _width("n_chars", 8), "'$numeric,$integer'", "true")],
    ),
)
def _profile_fields(spark, sf_dir):
    both = [profile.profile_fields(read(spark, sf_dir, t), t) for t in ("lineitem", "documents")]
    return both[0].unionByName(both[1]).withColumn("tags", F.array_join("tags", ","))


@query(
    "measurable_not_unique",
    """SELECT 'o_custkey' AS field WHERE (SELECT count(DISTINCT o_custkey) < count(*) FROM orders)
       UNION ALL SELECT 'o_totalprice' WHERE (SELECT count(DISTINCT o_totalprice) < count(*) FROM orders)
       UNION ALL SELECT 'o_orderkey' WHERE (SELECT count(DISTINCT o_orderkey) < count(*) FROM orders)""",
)
def _not_unique(spark, sf_dir):
    fields = profile.profile_fields(read(spark, sf_dir, "orders"), "orders")
    kind = resolve_type(F.col("tags"), F.col("is_numeric"))
    return profile.measurable_without_keys(fields, is_measurable(kind, F.col("field"))).select("field")


_WIDE = {
    "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber+ l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate",
    "customer": "c_custkey c_name* c_nationkey+ c_acctbal c_mktsegment*",
}
_SHARED = {"orders": 2, "lineitem": 1, "customer": 1}


def _tables_sql() -> str:
    """Whole tables; ``*`` marks a text, ``+`` a number of four bytes, all other columns have eight."""
    parts = []
    for table, columns in _WIDE.items():
        sizes = [
            f"coalesce(sum(octet_length(encode({c[:-1]}))), 0)" if c.endswith("*") else f"count({c.rstrip('+')}) * {4 if c.endswith('+') else 8}"
            for c in columns.split()
        ]
        parts.append(
            f"""SELECT '{table}' AS "table", count(*) AS "rows", {len(sizes)} AS fields, {_SHARED[table]} AS key_fields,"""
            f" CAST({' + '.join(sizes)} AS BIGINT) AS byte_size FROM {table}"
        )
    return " UNION ALL ".join(parts)


@query("profile_tables", _tables_sql())
def _profile_tables(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in _WIDE}
    # without their prefixes orders shares its keys with the other two
    named = {t: df.select(*[F.col(c).alias(c.partition("_")[2].title()) for c in df.columns]) for t, df in tables.items()}
    return profile.profile_tables(named)


@query("preview_100", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def _preview(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return preview.preview(df, "o_totalprice", "o_orderkey")


def _fabricated_sql() -> str:
    from tallyloom.functions.fixed import FABRICATED_TOKENS

    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{w}' AS token, count(*) FILTER (WHERE contains({c}, '{w}')) AS n FROM {t}"
        for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html"))
        for w in FABRICATED_TOKENS
    )


@query("check_fabricated", _fabricated_sql())
def _fabricated(spark, sf_dir):
    found = [checks.fabricated(read(spark, sf_dir, t)) for t in ("documents", "pages")]
    return found[0].unionByName(found[1])




def _star_spec(spark, sf_dir, kind: str, *fields: Field) -> LoadSpec:
    """A load of everything, and of more fields, from nations written in one format."""
    nation = as_text(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    options = {"delimited": {"embedded_labels": True}, "xml": {"table": "[nations/nation]"}}.get(kind, {})
    if kind == "resident":
        nation.createOrReplaceTempView("star_nations")
        return LoadSpec("Nations", Source("resident", view="star_nations"), fields, star=True)
    settings = {"delimited": {"header": True}, "xml": {"rowTag": "nation", "rootTag": "nations"}}.get(kind, {})
    path = written(nation, scratch_path(spark, f"star-{kind}"), "csv" if kind == "delimited" else kind, **settings)
    return LoadSpec("Nations", Source(kind, path, options), fields, star=True)


_KINDS = ("delimited", "json", "xml", "resident")


def _star_rows(spark, sf_dir, *fields: Field):
    book = TypeBook([{"name": "n_nationkey", "tags": ["$numeric", "$integer"]}])
    out = None
    for kind in _KINDS:
        rows = load_table(spark, _star_spec(spark, sf_dir, kind, *fields), book)[0].withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


_KIND_ROWS = "(VALUES ('delimited'), ('json'), ('xml'), ('resident')) AS kinds(kind)"


@query("load_star", f"SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, kind FROM nation, {_KIND_ROWS}")
def _star(spark, sf_dir):
    return _star_rows(spark, sf_dir, Field("Up", "", "Upper(n_name)", is_derived=True))


@query(
    "load_star_alias",
    f"SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, n_name AS Nation, kind FROM nation, {_KIND_ROWS}",
)
def _star_alias(spark, sf_dir):
    return _star_rows(spark, sf_dir, Field("Nation", "n_name"))
