"""Audits of very many apps: every object is built, told and parsed once, and nothing that no count needs is read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import script_text as S
from tallyloom.operators import catalog as cat, expressions as ex, scripts as sc
from workload import load_queries
from workload.registry import QUERIES

load_queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_audit_parses_no_object_twice(spark, sf_dir):
    plan = plan_of(QUERIES["audit_summary"](spark, sf_dir))
    assert "from_json" not in plan and "jsonObjectKeys" not in plan and "Repartition" not in plan


CHART = '{"qInfo":{"qId":"c","qType":"kpi"},"title":"t","qHyperCubeDef":{"qDimensions":[{"qDef":{"qFieldDefs":["d"]}}],"qMeasures":[{"qDef":{"qDef":"Sum(x)"}}]}}'
SHEET = '{"qMetaData":{"qType":"sheet"},"qRoot":{"qProperty":{"qInfo":{"qId":"s"}%s},"qChildren":[%s]}}'
CHILD = '{"qProperty":%s,"qChildren":[{"qProperty":%s},{"qProperty":{ }},null,{"qProperty":"x"},{"a":1}]}'
TEXTS = [
    '{"qScript":"LOAD x;\\r\\nLOAD y;"}', r'{"qScript":"LOAD z;"}', "{'qScript':'single'}", '{"qScript":null}', '{"qScript":5}', '{"qScript":""}',
    '{"qScript":"a","qScript":null}', '{"qScript":null,"qMetaData":{"qType":"sheet"},"qRoot":{}}', '{"qScript":"cut', '{"qScript":"x","qMetaData":{"qType":"sheet"',
    '[{"qScript":"in a list"}]', ' {"qScript":"behind a blank"}', '{"qScript":"x"} and more', '{"qScript":"raw \t tab"}', '"qScript"', "", None, "qScript", "{}",
    SHEET % ("", CHILD % (CHART, CHART)), SHEET % (',"rank":"high","qMetaDef":{"title":null}', CHILD % (CHART, "{}") + ',{"qProperty":{}},null,{"qChildren":[]},7'),
    SHEET % (',"rank":2', '{"qProperty":[1]},{"qProperty":"text"},{"qProperty":null}'), '{"qMetaData":{"qType":"sheet"}}', '{"qMetaData":"sheet","qreload_meta":{}}',
    '{"qMetaData":{"qType":"story"},"qreload_meta":{"a":1},"qfields":[{"qname":"f","qtags":["$text"]},{"qname":"h","qis_hidden":true},{},null]}',
    '{"qreload_meta":null,"qfields":[{"qname":"n"}],"qtables":[{"qname":"t","qno_of_rows":"many"}]}', '{"qMetaData":{"qType":"sheet"},"qreload_meta":1,"qfields":[{"qname":"no"}]}',
    '{"qreload_meta":{},"qfields":"none","qtables":[{"qname":"u"},{"qname":"$s","qis_system":true}]}', '{"qfields":[{"qname":"without its mark"}]}', '{"a":{"qreload_meta":1}}',
    '{"qTitle":"t","qLastReloadTime":"now","owner":"o","qEntryList":[]}', '{"qTitle":null,"qLastReloadTime":null}', '{"qTitle":"t"}',
    '{"qId":"v","qEntryList":[{"qProperties":{"qName":"n"}},{}]}', '{"qId":null,"qEntryList":null}',
]
TABLES = ("scripts", "sheets", "charts", "dimensions", "measures", "fields", "tables", "variables", "apps")


@pytest.mark.parametrize("kinds", [tuple(cat._SCHEMAS), (cat.SCRIPT, cat.MODEL, cat.SHEET)])
def test_flat_tables_of_objects_parsed_at_once(spark, tmp_path, kinds):
    objects = spark.createDataFrame([(f"a{i}", 7, t) for i, t in enumerate(TEXTS)], "app string, offset int, text string")
    cat.classify(objects, kinds).write.parquet(f"{tmp_path}/parsed")
    parsed = spark.read.parquet(f"{tmp_path}/parsed")
    told = cat.classify(objects).where(F.col("kind").isin(*kinds))
    assert sorted(parsed.select("app", "offset", "kind").collect()) == sorted(told.select("app", "offset", "kind").collect())
    for name in TABLES if len(kinds) == 5 else TABLES[:7]:
        make = getattr(cat, f"catalog_{name}")
        rows = sorted(map(str, make(parsed).collect()))
        assert rows == sorted(map(str, make(objects).collect())), name
        assert rows and make(parsed).columns == make(objects).columns


def test_classes_come_before_the_parts(spark):
    texts = ["Sum(x)", "Count({<S={'a'}>} y)", "Sum({<S={'a','b'}>} y)", "Aggr(Sum(x), y)", " ", None, "Sum(a)/Count(b)", "Count(DISTINCT [c d])"]
    frame = spark.createDataFrame([("a", t) for t in texts], "app string, expression string")
    classes = ex.classify(frame)
    assert {r["expression"]: r["class"] for r in classes.collect()} == dict(
        zip(texts, ["simple", "filtered_eq", "filtered_in", "unresolved", "rows", "rows", "ratio", "count_distinct"])
    )
    assert classes.columns == ["app", "expression", "class", "function", "field", "function2", "field2", "filter_field", "values", "measure"]
    lines = plan_of(classes.where("class = 'unresolved'")).split("\n")
    generators = [i for i, x in enumerate(lines) if "Generate inline" in x]
    assert len(generators) == 2 and any("Filter" in x for x in lines[generators[0]:generators[1]])


def test_evidence_of_an_app_is_gathered_once(spark):
    scripts = spark.createDataFrame([("a", "T: LOAD x, Y, z, w, v FROM t.csv;"), ("b", "T: LOAD x FROM t.csv;")], "app string, script string")
    rows = [
        ("a", "X", ["$text"], None), ("a", "x", ["$numeric"], None), ("a", "y", None, True), ("a", "Y", [], False), ("a", "Z", ["$date"], False),
        ("a", "w", [], None), (None, "x", ["$integer"], True), ("c", "x", ["$integer"], True),
    ]
    model = spark.createDataFrame(rows, "app string, field string, tags array<string>, is_numeric boolean")
    audit = sc.audit_tables(sc.parse_tables(scripts), model)
    assert {r["app"]: (r["n_columns"], r["n_typed"], r["n_dropped"]) for r in audit.collect()} == {"a": (5, 3, 0), "b": (1, 0, 0)}
    assert plan_of(audit).count("Aggregate [") == 1


SCRIPTS = [
    "LOAD a, b AS c FROM [lib://D/x y.csv] (txt, delimiter is ';') WHERE a > 1;", "T: LOAD a, f(b) FROM 'p/q.qvd' (qvd);", "LOAD * INLINE [k|l\n1|2] (delimiter is '|');",
    "U: LOAD a RESIDENT [V w] WHERE a = 1;", "LOAD a RESIDENT V;", "SET d = 'sub'; LOAD a FROM $(d)/e.xlsx (ooxml, table is S);", "LOAD id SQL SELECT id FROM t;", "LOAD Mid(a, 1, 2) AS b;",
    "CONCATENATE (W) LOAD a Tagged ('$integer') FROM x.dat (fix);", "LOAD a FROM x.unknown;", "LOAD a FROM lib://only;", "__H: LOAD a FROM x.csv;", "MAPPING LOAD a, b FROM x.csv;",
]


def test_tables_take_from_loads_what_they_show(spark):
    scripts = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(SCRIPTS)], "app string, script string")
    shown = {r["app"]: r for r in sc.parse_loads(scripts).where("NOT is_mapping AND NOT is_hidden").collect()}
    tables = sc.parse_tables(scripts)
    assert tables.columns == ["app", "pos", "table", "n_loads", "kind", "path", "fields"]
    found = {r["app"]: r for r in tables.collect()}
    assert sorted(found) == sorted(shown) and len(found) == len(SCRIPTS) - 2
    for app, r in found.items():
        load = shown[app]
        assert (r["pos"], r["table"], r["kind"], r["path"]) == (load["pos"], load["table"], load["kind"], load["path"] or load["resident"])
        assert [(f["field"], f["expression"], f["is_derived"], f["tags"]) for f in r["fields"]] == [tuple(f) for f in load["fields"]]
    # options are read of inline blocks alone
    option = sc._OPTION.replace("(?is)", "")
    assert 0 < plan_of(tables).count(option) < plan_of(sc.parse_loads(scripts)).count(option)


def test_comments_between_plain_text(spark):
    texts = {
        "REM a; x": " x", "aREM b;": "aREM b;", "x;REM c;y": "x;y", "r/R // t\nRe": "r/R \nRe", "a/b*/c": "a/b*/c", "/* r */R": "R", "/* open": "", "'// r' // s": "'// r' ",
        "[R // x] rem y": "[R // x] rem y", "\nrem y; z": "\n z", "[open // x": "[open ", '"R\n//"/': '"R\n//"/', "": "", "REMOVE x;": "REMOVE x;", "'open REM": "'open REM",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.strip_comments(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == texts
