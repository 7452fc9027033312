"""Catalogue data derived from the given tables by Spark.

The given tables hold sales, events and texts but no apps. Each function turns every row of a
table into what an app would hold about it: a load script, chart expressions, catalogue
objects, an app file. The work of a query on them grows with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filled(template: str) -> Column:
    """The template with every ``{column}`` replaced by that column's text."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


SCRIPT = """// app {p_partkey} reads lib://{p_type}/list.csv; not code
SET vRoot = 'lib://{p_brand}';
LET vSize = {p_size};
LET vNow = Num(Today());
set vDir = $(vRoot)/$(vMissing)/$(vSize);
SET vSize = "{p_size}0";
REM LOAD old FROM old.csv;
/* block; LOAD x FROM y.csv; */
[{p_name}]:
LOAD DISTINCT
    [Order ID] AS OrderID Tagged ('$key', '$integer'), // the key
    Amount Tagged ('$numeric'),
    Num(Round(Amount * (1 + 0.2), 2), '#,##0') AS [Net, {p_brand}],
    'a, b' AS Note,
    Year(OrderDate)
FROM [$(vDir)/sales_{p_partkey}.{ext}]
({fmt}codepage is 1252, embedded labels, delimiter is ';')
WHERE Amount > {p_size};
Stores:
LOAD StoreID, City RESIDENT [{p_name}] WHERE City <> 'x;y';
MapCity:
MAPPING LOAD code, label INLINE [
code,label
{p_size},'{p_brand}'
];
__Helper:
LOAD * INLINE [k|v
{p_type}|{p_size}
] (delimiter is '|');
LOAD Region, "Sales {p_size}" FROM 'lib://Shared/geo/regions_{p_size}.xlsx' (ooxml, embedded labels, table is Sheet1$);
CONCATENATE ([{p_name}]) LOAD [Order ID] AS orderid, Discount FROM [extra_{p_partkey}.csv] (txt, delimiter is '\\t');
JOIN (Stores) LOAD StoreID, Zone FROM zones.csv;
Live: LOAD id, total SQL SELECT id, total FROM dbo.orders WHERE total > {p_size};
LOAD Region, Manager FROM [lib://Other/regions_{p_size}.csv];
Forecast: LOAD Mid(Code, 1, 2) AS Area, Left(Code, 2);
TRACE LOAD done;
DROP TABLE [{p_name}]"""


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly before costly work on every one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def part_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app, script): one load script for every part."""
    part = spread(read(spark, sf_dir, "part"))
    ext = F.when(F.col("p_type") == "ECONOMY", "csv").when(F.col("p_type") == "SMALL", "qvd")
    ext = ext.when(F.col("p_type") == "STANDARD", "parquet").otherwise("dat")
    fmt = F.when(F.col("p_type") == "ECONOMY", "txt, ").when(F.col("p_type") == "SMALL", "qvd, ")
    fmt = fmt.when(F.col("p_type") == "STANDARD", "parquet, ").otherwise("fix, ")
    named = part.withColumns({"ext": ext, "fmt": fmt})
    return named.select(F.concat(F.lit("app"), F.col("p_partkey").cast("string")).alias("app"), filled(SCRIPT).alias("script"))


def part_expressions(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    """(app, pos, expression): chart expressions that name the values of every part."""
    each = F.posexplode(F.array(*[filled(t) for t in templates])).alias("pos", "expression")
    return spread(read(spark, sf_dir, "part")).select(filled("app{p_partkey}").alias("app"), each)


_KPI = """{"qProperty":{"qInfo":{"qId":"k{o_orderkey}","qType":"{shape}"},"title":"Total {o_orderpriority}","visualization":"big",
 "subtitle":"sub {o_orderstatus}","footnote":"f{o_custkey}","showTitles":true,"color":{"auto":false},"donut":{"n":{o_custkey}},
 "qHyperCubeDef":{"qDimensions":[],"qMeasures":[{"qDef":{"qDef":"Sum([{o_orderpriority}])","qLabel":"T","qNumFormat":{"qType":"M"}}}]}}}"""
_INNER = """{"qProperty":{"qInfo":{"qId":"b1","qType":"barchart"},"title":"By {o_orderstatus}",
 "qHyperCubeDef":{"qDimensions":[
   {"qDef":{"qFieldDefs":["{o_orderstatus}","x"],"qFieldLabels":["State"],"qSortCriterias":[{"qSortByNumeric":1},{"qSortByAscii":-1}]}},
   {"qDef":{"qFieldDefs":[]}}],
  "qMeasures":[{"qDef":{"qDef":"Count({<Status={'{o_orderstatus}'}>} OrderID)"}},{"qDef":{"qLabel":"none"}}]}},
 "qChildren":[{"qProperty":{"qInfo":{"qId":"too deep","qType":"kpi"}}}]}"""
_BOX = (
    """{"qProperty":{"qInfo":{"qId":"box","qType":"container"},"title":"Box"},"qChildren":["""
    + _INNER
    + """,{"qProperty":{}},{"qProperty":{"visualization":"note"}}]}"""
)
_SHEET = (
    """{"qMetaData":{"qType":"sheet"},"qRoot":{"qProperty":{"qInfo":{"qId":"s{o_orderkey}"},"rank":1.5,"creationDate":"{o_orderdate}","columns":24,"rows":12,"cells":[{"name":"k{o_orderkey}"}],
 "qMetaDef":{"title":"Orders {o_orderstatus}","description":"about {o_custkey}"}},"qChildren":["""
    + _KPI
    + """,{"qProperty":{}},"""
    + _BOX
    + """]}}"""
)
_BARE_SHEET = """{"qMetaData":{"qType":"sheet"},"qRoot":{"qProperty":{"qInfo":{"qId":"e{o_orderkey}"}}}}"""
_MODEL = """{"qreload_meta":{"cpu":{o_custkey}},"qstatic_byte_size":{o_orderkey},"qfields":[
 {"qname":"OrderID","qsrc_tables":["{o_orderpriority}","Notes"],"qcardinal":{o_orderkey},"qtotal_count":{o_custkey},"qis_numeric":true,"qtags":["$key","$integer"],"qbyte_size":12},
 {"qname":"{o_orderstatus}","qtags":["$text"]},
 {"qname":"hidden","qis_hidden":true},{"qname":"$Field","qis_system":true}],
 "qtables":[{"qname":"{o_orderpriority}","qno_of_rows":{o_orderkey},"qno_of_fields":3,"qno_of_key_fields":1,"qbyte_size":77},
 {"qname":"$Table","qis_system":true},{"qname":"Notes"}]}"""
_PROPERTIES = """{"qTitle":"App {o_orderkey}","qLastReloadTime":"{o_orderdate}","qSavedInProductVersion":"1.{o_custkey}","owner":"u{o_custkey}","qThumbnail":{"q":"t{o_custkey}"}}"""
_VARIABLES = """{"qId":"list{o_custkey}","qEntryList":[
 {"qProperties":{"qName":"vStatus","qDefinition":"={o_orderstatus}"},"qIsScriptCreated":true},{"qProperties":{"qName":"v{o_orderkey}"}}]}"""
_SCRIPT_OBJECT = (
    r"""{"qScript":"[{o_orderpriority}]:\r\nLOAD [Order ID] AS OrderID Tagged ('$integer'), Amount, Amount * 2 AS Dbl"""
    r""" FROM [lib://D/{o_orderstatus}.{suffix}] ({suffix});\r\nNotes: LOAD a, b INLINE [a,b\r\n1,{o_custkey}];"}"""
)
OBJECTS = [
    (10, _PROPERTIES), (20, _MODEL), (25, "not json {o_orderkey}"), (30, _SCRIPT_OBJECT), (40, _SHEET),
    (50, _VARIABLES), (60, _BARE_SHEET), (70, '{"qMetaData":{"qType":"story"},"n":{o_orderkey}}'),
]


def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app, offset, text): the catalogue objects of an app for every order."""
    orders = spread(read(spark, sf_dir, "orders")).withColumns(
        {
            "shape": F.when(F.col("o_orderpriority") == "1-URGENT", "kpi").otherwise("linechart"),
            "suffix": F.when(F.col("o_orderstatus") == "F", "qvd").otherwise("txt"),
        }
    )
    # each value becomes text once and not at every place that names it
    named = sorted(set(re.findall(r"\{(\w+)\}", "".join(t for _, t in OBJECTS))))
    orders = orders.select(*[F.col(c).cast("string").alias(c) for c in named])
    rows = F.array(*[F.struct(F.lit(o).alias("offset"), filled(t).alias("text")) for o, t in OBJECTS])
    return orders.select(filled("o{o_orderkey}").alias("app"), F.inline(rows))
