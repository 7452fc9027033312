"""Load scripts of very many apps: nothing is computed twice, before its rows are dealt, or for nothing."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.functions import script_text as S
from tallyloom.functions.columns import let
from tallyloom.operators import scripts as sc
from tallyloom.plans import sheets
from tallyloom.sources import app_files
from workload import load_queries
from workload.derive import part_scripts
from workload.registry import QUERIES

load_queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variables_are_read_once_and_after_dealing(spark, sf_dir):
    plan = plan_of(sc.script_variables(part_scripts(spark, sf_dir)))
    assert "Filter" not in plan


def test_variables_expand_and_last_one_counts(spark):
    scripts = spark.createDataFrame([("a", "SET b = 1;\nSET c = $(b)/$(B)/$(d);\nLET e = f(1);\nSET b = '2';"), ("n", None), ("e", "LOAD x;")], "app string, script string")
    assert sorted(map(tuple, sc.script_variables(scripts).collect())) == [("a", "b", "2", "2"), ("a", "c", "$(b)/$(B)/$(d)", "2/2/$(d)")]


BODIES = [
    "a, b AS c FROM x.csv", "", ",", "f(a, g(b, (c))) AS d, 'x, (y' , [e, f] RESIDENT t", "a, (((((deep, er))))), b FROM t", "a, (b, c FROM t",
    "a), b FROM t", "a) (b, c) , d", "FROM t", "x FROMage, from_y, 1from FROM t", "a SQL b, c sql\tselect d, e", "'a'FROM t", '"a, b', "[a, b", "a,,b , \n FROM",
    "* INLINE [a,b\n1,2] (delimiter is '|')", "((((", "))))", "a(((((b, c)))))) , d FROM e", "é(ü, 'ö'), ÉFROM x",
]


def test_load_bodies_are_cut_as_by_counting_depth(spark):
    bodies = spark.createDataFrame([(b,) for b in BODIES], "body string")
    rows = bodies.select("body", S.split_load(F.col("body")).alias("cut"), S._fold_load(F.col("body")).alias("fold")).collect()
    assert [r["body"] for r in rows if r["cut"] != r["fold"]] == []
    cut = {r["body"]: (r["cut"]["fields"], r["cut"]["tail"]) for r in rows}
    assert cut[BODIES[3]] == (["f(a, g(b, (c))) AS d", "'x, (y'", "[e, f]"], "RESIDENT t")
    assert cut[BODIES[4]] == (["a", "(((((deep, er)))))", "b"], "FROM t")
    assert cut[BODIES[5]] == (["a", "(b, c FROM t"], "")


def test_field_names_read_no_paths_and_no_variables(spark):
    scripts = spark.createDataFrame([("a", "T: LOAD a, [b c] AS d, f(x) FROM [$(v)/x.csv] (txt);\nLOAD *, e INLINE [k|l\n1|2] (delimiter is '|');")], "app string, script string")
    names = sc.script_field_names(scripts)
    assert [(r["pos"], r["field"]) for r in names.collect()] == [(0, "a"), (1, "d"), (2, "e"), (3, "k"), (4, "l")]
    plan = plan_of(names)
    assert "lib://" not in plan and "SET|LET" not in plan


def test_a_bound_value_is_not_copied(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string").select(let(F.upper("x"), lambda u: F.concat(u, F.lit("-"), u)).alias("y"))
    assert "transform(" not in plan_of(df)
    assert [r["y"] for r in df.collect()] == ["A-A", None]
    struct = spark.createDataFrame([("a",), (None,)], "x string").select(let(F.col("x"), lambda u: F.coalesce(u, F.lit("none"))).alias("y"))
    assert [r["y"] for r in struct.collect()] == ["a", "none"]

def test_evidence_of_many_apps_is_met_by_sorting(spark):
    scripts = spark.createDataFrame([("a", "T: LOAD x FROM y.csv;")], "app string, script string")
    model = spark.createDataFrame([("a", "X", ["$integer"], True)], "app string, field string, tags array<string>, is_numeric boolean")
    status = sc.load_status(sc.parse_loads(scripts), model)
    assert "strategy=merge" in plan_of(status)
    assert [r["n_typed"] for r in status.collect()] == [1]


def test_evidence_query_deals_its_rows_before_parsing(spark, sf_dir):
    plan = plan_of(QUERIES["audit_type_evidence"](spark, sf_dir))
    assert plan.count("Repartition") == 2


def test_texts_of_a_sheet_do_not_sort_its_rows(spark):
    rows = [("x", "b", 1, "k"), ("x", "a", 2, "l"), ("x", "a", 3, None), ("y", None, 4, "k"), (None, "c", 5, "l"), (None, "c", None, "k")]
    df = spark.createDataFrame(rows, "d string, t string, n int, f string")
    visuals = [
        sheets.Visual("n", "d", M.total("n")), sheets.Visual("rows"), sheets.Visual("low", "d", M.minimum("T")), sheets.Visual("high", None, M.maximum("t")),
        sheets.Visual("one", "d", M.only("t", strict=True)), sheets.Visual("some", "d", M.filtered(M.maximum("t"), "f", "k")),
        sheets.Visual("own", "d", M.maximum("d")), sheets.Visual("kinds", None, M.count_distinct("t")),
    ]
    out = sheets.sheet(df, visuals)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "SortAggregate" in x and "spark_grouping_id" in x]
    shown = {(r["visual"], r["category"]): r["value"] if r["text"] is None else r["text"] for r in out.collect()}
    assert shown == {
        ("n", "x"): 6, ("n", "y"): 4, ("n", None): 5, ("rows", None): 6, ("low", "x"): "a", ("low", "y"): None, ("low", None): "c", ("high", None): "c",
        ("one", "x"): None, ("one", "y"): None, ("one", None): "c", ("some", "x"): "b", ("some", "y"): None, ("some", None): "c",
        ("own", "x"): "x", ("own", "y"): "y", ("own", None): None, ("kinds", None): 3,
    }
    empty = {(r["visual"], r["category"]): (r["value"], r["text"]) for r in sheets.sheet(df.where("n > 9"), visuals).collect()}
    assert empty == {("rows", None): (0, None), ("high", None): (None, None), ("kinds", None): (0, None)}


def test_app_files_are_taken_in_handfuls(monkeypatch):
    monkeypatch.setattr(app_files, "TAKEN", 100)
    monkeypatch.setattr(app_files, "GIVEN", 50)
    values = [b"x" * n for n in (10, 60, 0, 250, 40, 40, 40)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(values, pa.binary())], ["app", "content"])
    few = list(app_files.handfuls(batch, "content"))
    assert [v for f in few for v in f.column("content").to_pylist()] == values
    assert [f.num_rows for f in few] == [3, 1, 2, 2]
    files = pa.RecordBatch.from_arrays([pa.array([7, None, 9]), pa.array([zlib.compress(b"a" * 30), b"none", zlib.compress(b"\xff" * 30)])], ["app", "content"])
    out = list(app_files._streams(files, None))
    assert [b.num_rows for b in out] == [2]
    assert out[0].to_pylist() == [
        {"app": 7, "offset": 0, "n_bytes": 30, "text": "a" * 30}, {"app": 9, "offset": 0, "n_bytes": 30, "text": None},
    ]


def test_app_files_of_documents_with_nulls(spark, tmp_path):
    docs = [(1, "é 'x'", "en", "web"), (None, "no id", "de", None), (3, None, None, "web"), (4, "", "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["corpus_blobs"](spark, str(tmp_path)).collect()), key=str) == [(1, "é 'x'"), (3, None), (4, ""), (None, "no id")]
    assert sorted(r["version"] for r in QUERIES["corpus_headers"](spark, str(tmp_path)).collect()) == ["1.1", "1.3", "1.4", "1.None"]
