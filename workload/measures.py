"""Measures, visuals and sheets over the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.functions.types import measurable_names
from tallyloom.plans import sheets, visuals
from tallyloom.plans.aggregate import aggregate, exact_median
from workload.derive import read
from workload.registry import query


def _by(dim: str, table: str, measure, digits: int | None = None, prepare=None):
    """A query: the measure per value of ``dim``."""

    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        df = prepare(df) if prepare else df
        out = aggregate(df, [dim], [measure.named("value")])
        return out.withColumn("value", F.round("value", digits)) if digits is not None else out

    return run


def _some_nulls(df):
    return df.withColumn("note", F.when(F.col("l_discount") > 0.05, F.col("l_suppkey")))


query("m_row_count", "SELECT o_orderpriority, count(*) AS value FROM orders GROUP BY 1")(
    _by("o_orderpriority", "orders", M.row_count())
)
query(
    "m_count",
    "SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN l_suppkey END) AS value FROM lineitem GROUP BY 1",
)(_by("l_returnflag", "lineitem", M.count("note"), prepare=_some_nulls))
query(
    "m_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS value FROM lineitem GROUP BY 1",
)(_by("l_returnflag", "lineitem", M.count_distinct("l_partkey")))
query(
    "m_count_distinct_blank",
    """SELECT l_returnflag, count(DISTINCT note) + max(CASE WHEN note IS NULL THEN 1 ELSE 0 END) AS value
       FROM (SELECT l_returnflag, CASE WHEN l_discount > 0.05 THEN l_suppkey END AS note FROM lineitem) GROUP BY 1""",
)(_by("l_returnflag", "lineitem", M.count_distinct("note", count_blank=True), prepare=_some_nulls))
query("m_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")(
    _by("l_returnflag", "lineitem", M.total("l_extendedprice"), 2)
)
query("m_avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1")(
    _by("l_returnflag", "lineitem", M.average("l_quantity"), 6)
)
query("m_min", "SELECT o_orderstatus, min(o_totalprice) AS value FROM orders GROUP BY 1")(
    _by("o_orderstatus", "orders", M.minimum("o_totalprice"))
)
query("m_max", "SELECT o_orderstatus, max(o_orderdate) AS value FROM orders GROUP BY 1")(
    _by("o_orderstatus", "orders", M.maximum("o_orderdate"))
)
query("m_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")(
    _by("l_returnflag", "lineitem", M.median("l_extendedprice"), 4)
)


@query(
    "m_median_distributed",
    """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice - 50000), 4) AS value
       FROM lineitem GROUP BY 1, 2""",
)
def _median(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") - 50000)
    out = exact_median(df, ["l_returnflag", "l_linestatus"], "x", "value")
    return out.withColumn("value", F.round("value", 4))


query("m_stdev", "SELECT p_type, round(stddev_pop(p_retailprice), 6) AS value FROM part GROUP BY 1")(
    _by("p_type", "part", M.stdev("p_retailprice"), 6)
)
query("m_only", "SELECT p_brand, min(p_type) AS value FROM part GROUP BY 1")(_by("p_brand", "part", M.only("p_type")))
query(
    "m_only_strict",
    "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS value FROM orders GROUP BY 1",
)(_by("o_custkey", "orders", M.only("o_orderstatus", strict=True)))
query(
    "m_ratio",
    """SELECT l_linenumber, round(CASE WHEN coalesce(sum(l_discount), 0) = 0 THEN 0 ELSE sum(l_tax) / sum(l_discount) END, 8) AS value
       FROM lineitem GROUP BY 1""",
)(_by("l_linenumber", "lineitem", M.ratio(M.total("l_tax"), M.total("l_discount")), 8))
query(
    "m_ratio_zero",
    """SELECT l_orderkey, round(CASE WHEN coalesce(sum(l_discount), 0) = 0 THEN 0 ELSE sum(l_tax) / sum(l_discount) END, 6) AS value
       FROM lineitem GROUP BY 1""",
)(_by("l_orderkey", "lineitem", M.ratio(M.total("l_tax"), M.total("l_discount")), 6))
query(
    "m_filtered_eq",
    "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2) AS value FROM lineitem GROUP BY 1",
)(_by("l_returnflag", "lineitem", M.filtered(M.total("l_extendedprice"), "l_linestatus", "F"), 2))
query(
    "m_filtered_in",
    "SELECT user_id, count(CASE WHEN event_type IN ('click', 'view') THEN event_id END) AS value FROM events GROUP BY 1",
)(_by("user_id", "events", M.filtered(M.count("event_id"), "event_type", "click", "view")))


@query(
    "m_filtered_override",
    """SELECT d.l_returnflag, t.value FROM (SELECT DISTINCT l_returnflag FROM lineitem) d,
       (SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag IN ('A', 'R')) t""",
)
def _override(spark, sf_dir):
    measure = M.filtered(M.total("l_extendedprice"), "l_returnflag", "A", "R").named("value")
    out = visuals.category(read(spark, sf_dir, "lineitem"), "l_returnflag", measure)
    return out.withColumn("value", F.round("value", 2))


@query(
    "m_filtered_override_by",
    """SELECT d.l_returnflag, d.l_linenumber, t.value
       FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem) d
       LEFT JOIN (SELECT l_linenumber, round(sum(l_quantity), 2) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) t
       ON d.l_linenumber = t.l_linenumber""",
)
def _override_by(spark, sf_dir):
    measure = M.filtered(M.total("l_quantity"), "l_returnflag", "A").named("value")
    out = visuals.filter_override(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], measure)
    return out.withColumn("value", F.round("value", 2))


@query(
    "m_filtered_card",
    "SELECT round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS value FROM orders",
)
def _card(spark, sf_dir):
    measure = M.filtered(M.total("o_totalprice"), "o_orderstatus", "O").named("value")
    return visuals.card(read(spark, sf_dir, "orders"), measure).withColumn("value", F.round("value", 2))


@query(
    "auto_measures",
    """SELECT l_linestatus, count(*) AS "Total lineitem Rows", CAST(sum(l_orderkey) AS BIGINT) AS "Total l_orderkey",
       CAST(sum(l_partkey) AS BIGINT) AS "Total l_partkey", CAST(sum(l_suppkey) AS BIGINT) AS "Total l_suppkey",
       CAST(sum(l_linenumber) AS BIGINT) AS "Total l_linenumber", round(sum(l_quantity), 2) AS "Total l_quantity",
       round(sum(l_extendedprice), 2) AS "Total l_extendedprice", round(sum(l_discount), 2) AS "Total l_discount",
       round(sum(l_tax), 2) AS "Total l_tax" FROM lineitem GROUP BY 1""",
)
def _auto(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    out = aggregate(df, ["l_linestatus"], M.automatic(df.schema, "lineitem", measurable_names(df.schema)))
    floats = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: F.round(c, 2) for c in floats})


@query("m_unresolved", "SELECT p_type, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM part GROUP BY 1")
def _unresolved(spark, sf_dir):
    measures = [M.row_count().named("n"), M.unresolved("Aggr(Sum(x), y)").named("value")]
    return aggregate(read(spark, sf_dir, "part"), ["p_type"], measures)


# --- visuals ---------------------------------------------------------------------


@query("visual_slicer", "SELECT DISTINCT c_mktsegment FROM customer")
def _slicer(spark, sf_dir):
    return visuals.slicer(read(spark, sf_dir, "customer"), "c_mktsegment")


@query("visual_card", "SELECT round(avg(value), 6) AS \"Value Average\" FROM events")
def _visual_card(spark, sf_dir):
    out = visuals.card(read(spark, sf_dir, "events"), M.average("value"))
    return out.select(F.round("Value Average", 6).alias("Value Average"))


@query("visual_table", "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def _table(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    dim = visuals.resolve_field(df.columns, "[P_Brand]")
    out = visuals.table(df, dim, M.total("p_retailprice").named("total"))
    return out.withColumn("total", F.round("total", 2))


@query("visual_table_default", "SELECT DISTINCT r_regionkey FROM region UNION ALL SELECT DISTINCT n_nationkey FROM nation")
def _table_default(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    return visuals.table(region).unionAll(visuals.table(nation))


@query(
    "visual_category",
    "SELECT l_shipdate, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1",
)
def _category(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    out = visuals.category(df, "l_shipdate", M.total("l_extendedprice").named("total"))
    return out.withColumn("total", F.round("total", 2))


@query(
    "visual_category_hide_blank",
    """SELECT l_suppkey, round(sum(CASE WHEN l_discount > 0.09 AND l_quantity > 49 THEN l_tax END), 2) AS total
       FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_discount > 0.09 AND l_quantity > 49 THEN l_tax END) IS NOT NULL""",
)
def _hide_blank(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    rare = df.withColumn("x", F.when((F.col("l_discount") > 0.09) & (F.col("l_quantity") > 49), F.col("l_tax")))
    out = visuals.category(rare, "l_suppkey", M.total("x").named("total"), hide_blank=True)
    return out.withColumn("total", F.round("total", 2))


@query(
    "visual_category_ignore_case",
    "SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1",
)
def _ignore_case(spark, sf_dir):
    mixed = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    df = read(spark, sf_dir, "part").select(mixed.alias("name"))
    out = visuals.category(df, "name", M.row_count().named("n"), ignore_case=True)
    return out.select(F.lower(F.collate("name", "UTF8_BINARY")).alias("name"), "n")


@query(
    "visual_unrelated",
    "SELECT r_name, (SELECT round(sum(o_totalprice), 2) FROM orders) AS total FROM (SELECT DISTINCT r_name FROM region)",
)
def _unrelated(spark, sf_dir):
    total = M.total("o_totalprice").named("total")
    out = visuals.unrelated(read(spark, sf_dir, "region"), "r_name", read(spark, sf_dir, "orders"), total)
    return out.withColumn("total", F.round("total", 2))


_LINE = [
    M.total("l_extendedprice"),
    M.average("l_quantity"),
    M.ratio(M.total("l_tax"), M.total("l_discount")),
]
_DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_SUMS = {
    "m1": "sum(l_extendedprice)",
    "m2": "avg(l_quantity)",
    "m3": "CASE WHEN coalesce(sum(l_discount), 0) = 0 THEN 0 ELSE sum(l_tax) / sum(l_discount) END",
}


def _sheet_sql(visuals_: list[tuple[str, str | None, str]]) -> str:
    parts = []
    for name, dim, measure in visuals_:
        label = f"CAST({dim} AS VARCHAR)" if dim else "CAST(NULL AS VARCHAR)"
        group = f" GROUP BY {dim}" if dim else ""
        parts.append(
            f"SELECT '{name}' AS visual, {label} AS category, round(CAST({_SUMS.get(measure, measure)} AS DOUBLE), 4) AS value,"
            f" CAST(NULL AS VARCHAR) AS text FROM lineitem{group}"
        )
    return " UNION ALL ".join(parts)


def _page(build):
    def run(spark, sf_dir):
        out = sheets.sheet(read(spark, sf_dir, "lineitem"), build(_DIMS, _LINE))
        return out.withColumn("value", F.round("value", 4))

    return run


query(
    "dashboard_kpi_page",
    _sheet_sql(
        [("Card_1", None, "m1"), ("Card_2", None, "m2"), ("Card_3", None, "m3"),
         ("ColChart_1", "l_returnflag", "m1"), ("LineChart_1", "l_linestatus", "m2")]
    ),
)(_page(sheets.kpi_page))
query(
    "dashboard_category_page",
    _sheet_sql([("Donut_1", "l_returnflag", "m1"), ("Bar_1", "l_linestatus", "m3"), ("Area_1", "l_linenumber", "m2")]),
)(_page(sheets.category_page))
query(
    "dashboard_extra_page",
    _sheet_sql([("Card_A1", None, "m1"), ("Col_A1", "l_linestatus", "m1"), ("Line_A1", "l_linenumber", "m3")]),
)(_page(sheets.extra_page))


@query(
    "dashboard_sheet",
    _sheet_sql(
        [
            ("rows", None, "count(*)"),
            ("sales", None, "m1"),
            ("flags", "l_returnflag", "m1"),
            ("flags again", "l_returnflag", "m2"),
            ("status", "l_linestatus", "m3"),
            ("lines", "l_linenumber", "count(*)"),
            ("parts", "l_returnflag", "count(DISTINCT l_partkey)"),
            ("middle", "l_linestatus", "median(l_extendedprice)"),
            ("filtered", "l_returnflag", "sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END)"),
        ]
    )
    + """ UNION ALL SELECT 'first ship', l_returnflag, NULL, CAST(min(l_shipdate) AS VARCHAR) FROM lineitem GROUP BY l_returnflag
        UNION ALL SELECT 'last status', NULL, NULL, max(l_linestatus) FROM lineitem
        UNION ALL SELECT 'no column', NULL, NULL, NULL
        UNION ALL SELECT 'any case', l_returnflag, round(CAST(sum(l_quantity) AS DOUBLE), 4), NULL FROM lineitem GROUP BY l_returnflag
        UNION ALL SELECT 'own filter', d.l_linestatus, t.value, NULL FROM (SELECT DISTINCT l_linestatus FROM lineitem) d,
        (SELECT round(sum(l_quantity), 4) AS value FROM lineitem WHERE l_linestatus = 'F') t""",
)
def _sheet(spark, sf_dir):
    quantity = M.total("l_quantity")
    out = sheets.sheet(
        read(spark, sf_dir, "lineitem"),
        [
            sheets.Visual("rows"),
            sheets.Visual("sales", None, _LINE[0]),
            sheets.Visual("flags", "l_returnflag", _LINE[0]),
            sheets.Visual("flags again", "l_returnflag", _LINE[1]),
            sheets.Visual("status", "l_linestatus", _LINE[2]),
            sheets.Visual("lines", "l_linenumber"),
            sheets.Visual("parts", "l_returnflag", M.count_distinct("l_partkey")),
            sheets.Visual("middle", "l_linestatus", M.median("l_extendedprice")),
            sheets.Visual("filtered", "l_returnflag", M.filtered(quantity, "l_linestatus", "O")),
            sheets.Visual("first ship", "l_returnflag", M.minimum("l_shipdate")),
            sheets.Visual("last status", None, M.maximum("l_linestatus")),
            sheets.Visual("no column", None, M.total("nowhere")),
            sheets.Visual("any case", "L_ReturnFlag", M.total("L_QUANTITY")),
            sheets.Visual("own filter", "l_linestatus", M.filtered(quantity, "l_linestatus", "F")),
        ],
    )
    return out.withColumn("value", F.round("value", 4))


@query(
    "dashboard_two_tables",
    """SELECT 'priced' AS visual, o_orderpriority AS category, round(CAST(sum(o_totalprice) AS DOUBLE), 4) AS value, CAST(NULL AS VARCHAR) AS text
          FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'quantity', o_orderpriority, (SELECT round(CAST(sum(l_quantity) AS DOUBLE), 4) FROM lineitem), NULL
          FROM (SELECT DISTINCT o_orderpriority FROM orders)
        UNION ALL SELECT 'flags', l_returnflag, count(*), NULL FROM lineitem GROUP BY l_returnflag
        UNION ALL SELECT 'lines', NULL, round(CAST(sum(l_tax) AS DOUBLE), 4), NULL FROM lineitem
        UNION ALL SELECT 'nobody', NULL, NULL, NULL""",
)
def _two_tables(spark, sf_dir):
    """Dimensions and measures in the first table that has them; an unrelated measure shows its total."""
    tables = {name: read(spark, sf_dir, name) for name in ("orders", "lineitem")}
    out = sheets.sheet_of_tables(
        tables,
        [
            sheets.Visual("priced", "o_orderpriority", M.total("o_totalprice")),
            sheets.Visual("quantity", "o_orderpriority", M.total("l_quantity")),
            sheets.Visual("flags", "l_returnflag"),
            sheets.Visual("lines", None, M.total("l_tax")),
            sheets.Visual("nobody", None, M.total("not_there")),
        ],
    )
    return out.withColumn("value", F.round("value", 4))
