"""One app from its stored objects to answers: catalogue, loads, measures, sheet, audit."""

import json

from tallyloom.operators import catalog as cat
from tallyloom.operators import checks, expressions, scripts
from tallyloom.plans import sheets
from tallyloom.sources.load import load_all
from tallyloom.sources.spec import spec_of

SCRIPT = """SET vDir = 'sub';
Sales:
LOAD [Order ID] AS OrderID Tagged ('$integer'), Region, Amount Tagged ('$numeric'), Amount * 2 AS Twice
FROM [lib://Files/$(vDir)/sales.csv] (txt, embedded labels, delimiter is ';') WHERE Amount > 0;
Regions: LOAD * INLINE [Region,Manager
north,Ann
];
Sales: LOAD OrderID, Region FROM [lib://Files/sub/more.csv] (txt, embedded labels);
Old: LOAD a FROM old.qvd (qvd);
"""


def chart(name, kind, dims=(), measures=()):
    return {
        "qProperty": {
            "qInfo": {"qId": name, "qType": kind},
            "qHyperCubeDef": {
                "qDimensions": [{"qDef": {"qFieldDefs": [d]}} for d in dims],
                "qMeasures": [{"qDef": {"qDef": m}} for m in measures],
            },
        }
    }


SHEET = {
    "qMetaData": {"qType": "sheet"},
    "qRoot": {
        "qProperty": {"qInfo": {"qId": "s"}},
        "qChildren": [
            chart("total", "kpi", (), ("Sum(Amount)",)),
            chart("by region", "barchart", ("[region]",), ("Sum(Amount)/Count(OrderID)",)),
            chart("north", "linechart", ("Region",), ("Sum({<Region={'north'}>} Amount)",)),
            chart("regions", "listbox", ("Region",)),
            chart("odd", "piechart", ("Region",), ("Aggr(Sum(Amount), Region)",)),
            chart("rows", "gauge"),
        ],
    },
}


def test_from_objects_to_answers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "sales.csv").write_text("Order ID;Region;Amount\n1;north;2.5\n2;south;4\n3;north;bad\n")
    (tmp_path / "sub" / "more.csv").write_text("OrderID,Region\n4,south\n")
    objects = spark.createDataFrame(
        [("app", 1, json.dumps({"qScript": SCRIPT})), ("app", 2, json.dumps(SHEET))], "app string, offset bigint, text string"
    )
    script = cat.catalog_scripts(objects)
    specs = [spec_of(row) for row in scripts.parse_loads(script).orderBy("pos").collect()]
    tables, statuses = load_all(spark, specs, root=str(tmp_path))
    assert [s.status for s in statuses] == ["connected"] * 3 + ["schema-only"]
    assert statuses[0].dropped == (("Twice", "Amount * 2"),)
    sales = tables["Sales"]
    assert sorted(map(tuple, sales.collect())) == [(1, "north", 2.5), (2, "south", 4.0), (3, "north", None), (4, "south", None)]

    charts = cat.catalog_charts(objects).orderBy("pos").collect()
    dims = cat.catalog_dimensions(objects).collect()
    classes = expressions.classify(cat.catalog_measures(objects)).collect()
    page = sheets.of_charts(charts, dims, classes, sales.columns)
    answers = {(r["visual"], r["category"]): r["value"] for r in sheets.sheet(sales, page).collect()}
    assert answers == {
        ("total", None): 6.5, ("by region", "north"): 1.25, ("by region", "south"): 2.0,
        ("north", "north"): 2.5, ("north", "south"): 2.5, ("regions", "north"): 2.0, ("regions", "south"): 2.0,
        ("odd", "north"): None, ("odd", "south"): None, ("rows", None): 4.0,
    }

    unresolved = expressions.classify(cat.catalog_measures(objects)).where("class = 'unresolved'")
    audit = checks.audit_summary(
        scripts.audit_tables(scripts.parse_tables(script)), cat.catalog_fields(objects), cat.catalog_sheets(objects),
        cat.catalog_charts(objects), unresolved,
    )
    counted = {r["item"]: r["n"] for r in audit.collect()}
    assert counted == {
        "tables": 3, "connected": 2, "schema_only": 1, "columns": 6, "typed_columns": 2, "catalogue_fields": 0, "sheets": 1,
        "charts": 6, "unresolved": 1, "dropped": 1, "no_type_evidence": 0,
    }
