import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.operators import checks, preview, profile, tokens


def test_tokens_of_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in tokens.token_scan(docs, "doc_id", "text").orderBy("app", "pos").collect():
        got.setdefault(r["app"], []).append(r["token"])
    for row in docs.collect():
        runs = re.findall(r"[A-Za-z0-9_]+", row["text"])
        wanted = dict.fromkeys(w for w in runs if 4 <= len(w) <= 30 and w[0].isalpha())
        assert got.get(row["doc_id"], []) == list(wanted)


@pytest.mark.parametrize(
    "name, text, found",
    [
        ("my data-set", "Alpha beta ALPHA x1 9lives table _abc " + "y" * 31, ["Set", "Set_ID", "Set_Category", "Set_Rating", "Alpha", "beta"]),
        ("a b", "", list(fixed.DEFAULT_CANDIDATES)),
        ("SET set", "SET_id Word", ["Set", "Set_ID", "Set_Category", "Set_Rating", "Word"]),
        ("one two three four five", "Word", None),
        ("x", " ".join(f"word{i}" for i in range(40)), [f"word{i}" for i in range(16)]),
    ],
)
def test_candidates(spark, name, text, found):
    got = spark.range(1).select(tokens.candidates(F.lit(name), F.lit(text))).first()[0]
    if found is None:
        assert len(got) == 20 and "Word" not in got
    else:
        assert got == found


def test_candidates_of_the_file_name_alone(spark):
    got = spark.range(1).select(tokens.candidates(F.lit("true false"))).first()[0]
    assert got == list(fixed.DEFAULT_CANDIDATES)


def test_fabricated_content_is_counted_per_column(spark):
    df = spark.createDataFrame([("Acme Corp and Acme Corp", None, 1), ("x", "Office Supplies", 2)], "a string, b string, n int")
    found = {(r["column"], r["token"]): r["n"] for r in checks.fabricated(df).collect()}
    assert len(found) == 2 * len(fixed.FABRICATED_TOKENS)
    assert {k for k, n in found.items() if n} == {("a", "Acme Corp"), ("b", "Office Supplies")}
    assert df.where(checks.has_fabricated(df)).count() == 2


def test_synthetic_rows_are_marked_and_found(spark):
    rows = preview.synthetic_preview(spark.createDataFrame([("Company",)], "column string"))
    assert rows.count() == 100 and rows.where("synthetic").count() == 100
    assert rows.where(checks.has_fabricated(rows)).count() > 0


def test_preview_takes_ordered_rows(spark, lineitem):
    out = preview.preview(lineitem, "l_extendedprice", "l_orderkey")
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100


def test_profile_of_mixed_columns(spark):
    df = spark.createDataFrame(
        [("1", "é", 1.5, True, None), ("2", "", 2.0, True, None), ("2", "x", None, False, None)],
        "n string, t string, d double, b boolean, none string",
    )
    got = {r["field"]: r for r in profile.profile_fields(df, "T").collect()}
    assert got["n"]["tags"] == ["$numeric", "$integer"] and got["n"]["is_numeric"]
    assert (got["n"]["cardinality"], got["n"]["total_count"], got["n"]["byte_size"]) == (2, 3, 3)
    assert got["t"]["tags"] == ["$text"] and got["t"]["byte_size"] == 3 and got["t"]["cardinality"] == 3
    assert got["d"]["tags"] == ["$numeric"] and got["d"]["byte_size"] == 16
    assert got["b"]["cardinality"] == 2 and not got["b"]["is_numeric"]
    assert (got["none"]["cardinality"], got["none"]["total_count"]) == (0, 0)
    keyless = profile.measurable_without_keys(profile.profile_fields(df, "T"), F.col("is_numeric"))
    assert [r["field"] for r in keyless.collect()] == ["n"]


def test_profile_scans_once(spark, lineitem):
    plan = profile.profile_fields(lineitem, "lineitem")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_volumetrics_count_what_is_there(spark):
    sheets = spark.createDataFrame([("a", "s1"), ("a", "s2")], "app string, sheet string")
    charts = spark.createDataFrame([("a", "KPI"), ("a", "bar"), ("b", "text")], "app string, type string")
    got = {r["app"]: tuple(r)[1:] for r in profile.app_volumetrics(sheets, charts).collect()}
    assert got == {"a": (2, 2, 1), "b": (1, 1, 1)}


def test_detail_text(spark):
    text = "a|b\nc" + "x" * 200
    got = spark.range(1).select(checks.detail_text(F.lit(text))).first()[0]
    assert got == ("a\\|b c" + "x" * 200)[:90]


def test_dangling_filter_field_is_found(spark):
    measures = spark.createDataFrame(
        [("h", "Cases", "open", "CALCULATE(COUNTA('Cases'[CaseID]), 'Cases'[Status] = \"Open\")")],
        "app string, table string, measure string, expression string",
    )
    columns = spark.createDataFrame([("h", "Cases", "CaseID"), ("h", "Cases", "CaseStatus")], "app string, table string, column string")
    found = checks.check_measure_refs(measures, columns, columns.select("app", "table")).collect()
    assert [(r["ref_column"], r["problem"]) for r in found] == [("Status", "unknown column")]


def test_schema_diff_spares_extra_columns_of_schema_only_tables(spark):
    declared = spark.createDataFrame([("a", "T", "x"), ("a", "U", "y")], "app string, table string, column string")
    emitted = spark.createDataFrame(
        [("a", "T", "z", "connected"), ("a", "U", "w", "schema-only")], "app string, table string, column string, status string"
    )
    got = sorted((r["table"], r["column"], r["problem"]) for r in checks.schema_diff(declared, emitted).collect())
    assert got == [("T", "x", "declared but not emitted"), ("T", "z", "emitted but not declared"), ("U", "y", "declared but not emitted")]
