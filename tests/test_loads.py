import datetime

import pytest

from tallyloom.functions.types import TypeBook
from tallyloom.sources.load import concatenate, join_root, load_all, load_table, select_or_null
from tallyloom.sources.spec import Field, LoadSpec, Source
from tallyloom.sources.workbook import workbook_cells
from workload.derive_files import workbook


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_renamed_column_is_read_under_its_own_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Order ID,Sales\n1,2.5\n2,bad\n")
    types = TypeBook([{"name": "OrderID", "tags": ["$integer"]}, {"name": "Sales", "is_numeric": True}])
    spec = LoadSpec("T", Source(path=path, options={"embedded_labels": True}),
                    (Field("OrderID", "Order ID"), Field("Sales"), Field("Gone")))
    df, status = load_table(spark, spec, types)
    assert rows(df) == [(1, 2.5, None), (2, None, None)]
    assert (status.status, status.kind, status.typed_columns) == ("connected", "delimited", 2)


def test_without_header_columns_bind_by_position(spark, tmp_path):
    path = write(tmp_path / "a.txt", "1;x\n2;y\n")
    spec = LoadSpec("T", Source(path=path, options={"delimiter": ";"}), (Field("k"), Field("v"), Field("more")))
    assert rows(load_table(spark, spec)[0]) == [("1", "x", None), ("2", "y", None)]


@pytest.mark.parametrize("codepage, encoding", [("1252", "cp1252"), ("65001", "utf-8"), ("28591", "latin-1"), ("28592", "iso8859-2"),
                                                ("1200", "utf-16-le"), ("1201", "utf-16-be"), ("437", "cp437"), ("850", "cp850")])
def test_codepages(spark, tmp_path, codepage, encoding):
    path = write(tmp_path / f"{codepage}.csv", "n,v\né,\"a \"\"q\"\", b\"\n", encoding)
    source = Source(path=path, options={"embedded_labels": True, "codepage": codepage})
    assert rows(load_table(spark, LoadSpec("T", source, (Field("n"), Field("v"))))[0]) == [("é", 'a "q", b')]


def test_unknown_codepage_is_ignored(spark, tmp_path):
    path = write(tmp_path / "a.csv", "n\né\n")
    source = Source(path=path, options={"embedded_labels": True, "codepage": "932"})
    assert rows(load_table(spark, LoadSpec("T", source, (Field("n"),)))[0]) == [("é",)]


def test_workbook(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    path.write_bytes(workbook([["Key", "When", "Name"], [1, 45292.25, "a & b"], [2.5, None, None], ["x", 1, "c"]]))
    types = TypeBook([{"name": "Key", "tags": ["$integer"]}, {"name": "When", "tags": ["$timestamp"]}])
    source = Source(path=str(path), options={"embedded_labels": True, "table": "Data$"})
    df, status = load_table(spark, LoadSpec("T", source, (Field("When"), Field("Key"), Field("name"), Field("Gone"))), types)
    when = datetime.datetime(2024, 1, 1, 6)
    assert rows(df)[:2] == [(when, 1, "a & b", None), (None, 2, None, None)]
    assert rows(df)[2][1:] == (None, "c", None)
    assert status.kind == "excel"
    first_sheet = load_table(spark, LoadSpec("T", Source(path=str(path)), (Field("a"),)))[0]
    assert rows(first_sheet) == []
    cells = workbook_cells(spark.read.format("binaryFile").load(str(path)), "Data").orderBy("row").collect()
    assert [len(r["cells"]) for r in cells] == [3, 3, 1, 3]


def test_inline_pads_and_cuts(spark):
    text = "\nk|v|w\n\n 1 | 'x' \n2|y|z|cut\n"
    types = TypeBook([{"name": "k", "tags": ["$integer"]}])
    df, status = load_table(spark, LoadSpec("T", Source("inline", text=text, options={"delimiter": "|"})), types)
    assert rows(df) == [(1, "x", ""), (2, "y", "z")]
    assert status.columns == ("k", "v", "w")


def test_unreadable_source_gives_its_schema_and_no_rows(spark):
    spec = LoadSpec("T", Source(path="lib://D/a.qvd"), (Field("d", tags=("$date",)), Field("x", "x", "x*2", True)))
    df, status = load_table(spark, spec)
    assert df.dtypes == [("d", "timestamp_ntz"), ("x", "string")] and df.count() == 0
    assert status.status == "schema-only" and status.reason
    assert load_table(spark, LoadSpec("T", Source("sql"), (Field("a"),)))[1].status == "schema-only"


def test_derived_fields_are_dropped_and_reported(spark):
    text = "a,b\n1,2"
    fields = (Field("a"), Field("c", expression="a+b", is_derived=True))
    df, status = load_table(spark, LoadSpec("T", Source("inline", text=text), fields))
    assert df.columns == ["a"] and status.dropped == (("c", "a+b"),)
    only_derived = LoadSpec("T", Source("inline", text=text), (Field("c", expression="a+b", is_derived=True),))
    assert load_table(spark, only_derived)[0].columns == ["c"]


def test_where_sees_columns_that_are_not_kept(spark):
    spec = LoadSpec("T", Source("inline", text="a,b\n1,2\n3,4"), (Field("A2", "a"),), where="b > 3")
    assert rows(load_table(spark, spec, TypeBook([{"name": "b", "is_numeric": True}]))[0]) == [("3",)]


def test_loads_of_one_name_keep_all_rows(spark):
    first = spark.createDataFrame([(1, "x")], "Id int, Name string")
    more = spark.createDataFrame([("y", 2.0)], "name string, price double")
    out = concatenate([("T", first), ("t", more)])
    assert list(out) == ["T"] and out["T"].columns == ["Id", "Name", "price"]
    assert sorted(rows(out["T"]), key=str) == [(1, "x", None), (None, "y", 2.0)]


def test_later_loads_read_earlier_tables(spark):
    specs = [
        LoadSpec("__Raw", Source("inline", text="k,v\n1,a\n2,b")),
        LoadSpec("Map", Source("inline", text="k\n1"), is_mapping=True),
        LoadSpec("Kept", Source("resident", view="__Raw"), (Field("v"),), where="k = 2"),
        LoadSpec("Other", Source("inline", text="v,w\nc,1"), concatenate_to="KEPT"),
    ]
    tables, statuses = load_all(spark, specs)
    assert list(tables) == ["Kept"]
    assert sorted(rows(tables["Kept"])) == [("b", None), ("c", "1")]
    assert len(statuses) == 4


def test_tags_of_one_load_type_the_fields_of_another(spark):
    specs = [
        LoadSpec("A", Source("inline", text="k\n1"), (Field("k"),)),
        LoadSpec("B", Source("inline", text="K\n2"), (Field("K", tags=("$integer",)),)),
    ]
    types = TypeBook()
    tables, _ = load_all(spark, specs, types)
    assert [t.dtypes[0][1] for t in tables.values()] == ["bigint", "bigint"]
    assert types.type_of("k") == "string"


def test_paths_below_the_root():
    assert join_root("/data/", "lib://Files\\2024\\a.csv") == "/data/2024/a.csv"
    assert join_root("/data", "/x/a.csv") == "/data/x/a.csv"
    assert join_root("", "/x/a.csv") == "/x/a.csv"


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    spec = LoadSpec("L", Source("parquet", "lineitem.parquet"), (Field("q", "l_quantity"),), where="l_quantity > 45")
    plan = load_table(spark, spec, root=sf_dir)[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_missing_columns_are_null(spark):
    df = spark.createDataFrame([(1,)], "A int")
    out = select_or_null(df, ["a", "b"])
    assert out.columns == ["a", "b"] and rows(out) == [(1, None)]


def test_distinct_and_order(spark):
    text = "k,v\n2,x\n1,y\n2,x"
    spec = LoadSpec("T", Source("inline", text=text), (Field("k"), Field("v")), distinct=True, order_by=("k",))
    assert rows(load_table(spark, spec)[0]) == [("1", "y"), ("2", "x")]
