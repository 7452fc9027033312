"""Findings of the third round: work and memory that grew faster than the input."""

from tallyloom.operators import catalog as cat, checks, expressions as ex, models


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


OBJECTS = [
    ("a", 1, '{"qScript":"LOAD x;"}'),
    ("a", 2, r'{"q\u0053cript":"LOAD escaped;"}'),
    ("a", 3, '{"qMetaData":{"qType":"sheet"},"qRoot":{"qProperty":{"qInfo":{"qId":"s"}}}}'),
    ("a", 4, '{"qMetaData":{"qType":"story"}}'),
    ("a", 5, '[1, "qScript"]'),
    ("a", 6, "qScript is no JSON"),
    ("a", 7, None),
    (None, 8, "{'qScript':'single'}"),
]


def _objects(spark):
    return spark.createDataFrame(OBJECTS, "app string, offset bigint, text string")


def test_every_text_is_searched_for_its_keys_once(spark):
    told = cat.classify(_objects(spark))
    for df in (told, cat.catalog_sheets(told), cat.catalog_scripts(told), cat.catalog_sheets(_objects(spark))):
        assert _plan(df).count("jsonObjectKeys") == 1


def test_kinds_of_plain_and_escaped_keys(spark):
    kinds = {r.offset: r.kind for r in cat.classify(_objects(spark)).collect()}
    assert kinds == {1: "script", 2: "script", 3: "sheet", 4: "other", 5: "other", 8: "script"}
    for objects in (_objects(spark), cat.classify(_objects(spark))):
        scripts = {r.app: r.script for r in cat.catalog_scripts(objects).collect()}
        assert scripts == {"a": "LOAD escaped;", None: "single"}
        assert [r.sheet for r in cat.catalog_sheets(objects).collect()] == ["s"]


COLUMNS = [("a", "T", "x"), ("a", "T", "x"), (None, "T", "x")]
TABLES = [("a", "T"), ("a", "T"), (None, "T")]


def test_references_meet_by_sorting(spark):
    columns = spark.createDataFrame(COLUMNS, "app string, table string, column string")
    tables = spark.createDataFrame(TABLES, "app string, table string")
    measures = spark.createDataFrame(
        [("a", "T", "m", "'T'[x] + 'T'[y] + 'U'[x]"), ("a", "T", "m", "'T'[x] + 'T'[y]"), (None, "T", "n", "'T'[x]")],
        "app string, table string, measure string, expression string",
    )
    visuals = spark.createDataFrame(
        [("a", "v", "Column", "T", "y"), ("a", "v", "Measure", "T", "m"), ("a", "v", "Column", "U", "x"),
         ("a", "v", "Column", None, "x"), (None, "v", "Column", "T", "x"), ("a", "v", "Column", "T", "x")],
        "app string, visual string, kind string, entity string, property string",
    )
    found = checks.check_measure_refs(measures, columns, tables)
    assert sorted((r.app or "", r.ref_table, r.ref_column, r.problem) for r in found.collect()) == [
        ("", "T", "x", "unknown table"), ("a", "T", "y", "unknown column"), ("a", "T", "y", "unknown column"),
        ("a", "U", "x", "unknown table"),
    ]
    lost = checks.check_visual_refs(visuals, columns, measures, tables)
    assert sorted((r.app or "", r.entity or "", r.property, r.problem) for r in lost.collect()) == [
        ("", "T", "x", "unknown table"), ("a", "", "x", "unknown table"), ("a", "T", "y", "no such column"),
        ("a", "U", "x", "unknown table"),
    ]
    for df in (found, lost):
        assert "BroadcastHashJoin" not in _joins(df) and "SortMergeJoin" in _joins(df)


def test_targets_keep_columns_and_meet_by_sorting(spark):
    expressions = spark.createDataFrame([("a", "Sum(X)", 1), ("a", "Sum(x)/Sum(y)", 2)], "app string, expression string, at int")
    fields = spark.createDataFrame([("a", "T", "x"), ("a", "U", "Y"), ("a", "U", "y")], "app string, table string, field string")
    met = ex.measure_targets(expressions, fields, keep=("at",))
    assert sorted(map(tuple, met.collect())) == [("a", "Sum(X)", "T", 1), ("a", "Sum(x)/Sum(y)", "T", 2), ("a", "Sum(x)/Sum(y)", "U", 2)]
    assert "BroadcastHashJoin" not in _joins(met) and "SortMergeJoin" in _joins(met)


def test_model_measures_join_once(spark):
    columns = spark.createDataFrame([("a", "T", 0, "Amount", "double")], "app string, table string, pos int, column string, type string")
    expressions = spark.createDataFrame([("a", 0, "Avg(Amount)"), ("a", 1, "Avg(Amount)")], "app string, pos int, expression string")
    measures = models.model_measures(columns, expressions)
    assert _plan(measures).count("Join ") == 1
    assert [(r.pos, r.measure) for r in measures.orderBy("pos").collect()] == [
        (0, "Total T Rows"), (1, "Total Amount"), (2, "Amount Average"),
    ]
