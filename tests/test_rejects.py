"""Headers by file, rejects of loads, and workbooks that cannot be read."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.types import TypeBook
from tallyloom.sources import delimited, workbook
from tallyloom.sources.load import load_table
from tallyloom.sources.rejects import load_checked
from tallyloom.sources.spec import Field, LoadSpec, Source
from workload.derive_files import workbook as book_of

LABELS = {"embedded_labels": True}


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def spec(path, *names, kind="delimited", **options):
    return LoadSpec("T", Source(kind, str(path), {**LABELS, **options}), tuple(Field(n) for n in names))


def test_each_file_binds_by_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\n1,2\n3,4\n")
    write(tmp_path / "b.csv", "y,z,X\n5,6,7\n")
    write(tmp_path / "c.csv", "\n  \nz\n8\n")
    write(tmp_path / "d.csv", "")
    write(tmp_path / "e.csv", "x,y\n")
    df, status = load_table(spark, spec(tmp_path, "x", "y", "gone"))
    assert rows(df) == sorted([("1", "2", None), ("3", "4", None), ("7", "5", None), (None, None, None)], key=str)
    assert status.columns == ("x", "y", "gone")
    everything = load_table(spark, spec(tmp_path))[0]
    assert everything.columns == ["x", "y", "z"] and rows(everything) == sorted(
        [("1", "2", None), ("3", "4", None), ("7", "5", "6"), (None, None, "8")], key=str
    )
    filtered = LoadSpec("T", Source("delimited", str(tmp_path), LABELS), (Field("x"),), where="z = '6'")
    assert rows(load_table(spark, filtered)[0]) == [("7",)]


def test_empty_folder_and_odd_labels(spark, tmp_path):
    write(tmp_path / "a.csv", "")
    assert load_table(spark, spec(tmp_path, "x"))[0].collect() == []
    write(tmp_path / "b.csv", "a,,A,\"q, \"\"r\"\"\",é\n1,2,3,4,5\n")
    df = load_table(spark, spec(tmp_path))[0]
    assert df.columns == ["a0", "_c1", "A2", 'q, "r"', "é"] and rows(df) == [("1", "2", "3", "4", "5")]


@pytest.mark.parametrize("codepage, encoding", [("1252", "cp1252"), ("1200", "utf-16-le"), ("437", "cp437"), ("65001", "utf-8-sig")])
def test_headers_in_other_codepages(spark, tmp_path, codepage, encoding):
    write(tmp_path / "a.csv", "é;v\n1;2\n", encoding)
    write(tmp_path / "b.csv", "v;é;w\n3;ü;5\n", encoding)
    df = load_table(spark, spec(tmp_path, "é", "v", codepage=codepage, delimiter=";"))[0]
    assert rows(df) == sorted([("1", "2"), ("ü", "3")], key=str)


def test_quoted_line_ends_in_a_header(spark, tmp_path):
    write(tmp_path / "a.csv", '"two\nlines",v\n1,"x\ny"\n')
    write(tmp_path / "b.csv", 'v\n"p\nq"\n')
    df = load_table(spark, spec(tmp_path, "v", "two\nlines", multiline=True))[0]
    assert rows(df) == sorted([("x\ny", "1"), ("p\nq", None)], key=str)


def test_headers_of_files_in_many_blocks(spark, tmp_path):
    """Only blocks that begin a file hold a header; files larger than a block are read from their first block."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, labels in (("a", "k,v"), ("b", "v,k")):
        write(tmp_path / f"{name}.csv", labels + "\n" + "".join(f"{name}{i},{name}{i}\n" for i in range(30_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = delimited.headers(spark, str(tmp_path), LABELS)
        assert sorted(r["names"] for r in found.collect()) == [["k", "v"], ["v", "k"]]
        assert load_table(spark, spec(tmp_path, "k", "v"))[0].distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_wanted_places_are_read(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b,c,d\n1,2,3,4\n")
    write(tmp_path / "b.csv", "d,c,b\n4,3,2\n")
    plan = load_table(spark, spec(tmp_path, "c"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "_c0" not in plan and "_c3" not in plan and "BroadcastHashJoin" in plan


def test_odd_lines_are_listed_and_stay(spark, tmp_path):
    write(tmp_path / "a.csv", 'k,n\n1,2\n3\n4,5,6\n"a,b",7\n8,"x\n9,bad\n,\n')
    write(tmp_path / "b.csv", "n\n10\n11,12\nbad\n")
    types = TypeBook([{"name": "n", "tags": ["$integer"]}])
    checked = load_checked(spark, spec(tmp_path, "k", "n"), types)
    assert {r[1] for r in rows(checked.rows)} >= {2, 5, 7, 10, 11, None}
    found = [(r["file"][-5:], r["reason"], r["field"], r["record"]) for r in checked.rejects.collect()]
    assert ("a.csv", "cell count", None, "3") in found and ("a.csv", "cell count", None, "4,5,6") in found
    assert ("b.csv", "cell count", None, "11,12") in found
    assert {("a.csv", "cell type", "n", "bad"), ("b.csv", "cell type", "n", "bad")} <= set(found)
    status = checked.finished()
    assert status.rejected_rows == sum(1 for f in found if f[1] == "cell count") and dict(status.misfits)["n"] == sum(f[1] == "cell type" for f in found)
    assert status.faulty_files == () and status.n_faulty == 0
    assert rows(checked.rows) == rows(load_table(spark, spec(tmp_path, "k", "n"), types)[0])


def test_rejects_by_position(spark, tmp_path):
    write(tmp_path / "a.csv", "1,2\n3\n")
    checked = load_checked(spark, LoadSpec("T", Source("delimited", str(tmp_path)), (Field("k"), Field("v"))))
    assert rows(checked.rows) == [("1", "2"), ("3", None)] and [r["record"] for r in checked.rejects.collect()] == ["3"]
    assert checked.finished().rejected_rows == 1


def test_broken_json_and_xml(spark, tmp_path):
    write(tmp_path / "a.json", '{"k":"1","v":{"x":1}}\n{"k":\nnot json\n{"k":"2","v":null}\n')
    for names in (("k", "v"), ()):
        checked = load_checked(spark, spec(tmp_path / "a.json", *names, kind="json"))
        assert [r[0] for r in rows(checked.rows)] == ["1", "2"]
        assert sorted(r["record"] for r in checked.rejects.collect()) == ["not json", '{"k":']
        assert checked.finished().rejected_rows == 2
        assert rows(load_table(spark, spec(tmp_path / "a.json", *names, kind="json"))[0]) == rows(checked.rows)
    write(tmp_path / "b.xml", "<r><o><k>1</k></o><o><k>2</o></r>")
    checked = load_checked(spark, spec(tmp_path / "b.xml", "k", kind="xml", row_tag="o"))
    assert rows(checked.rows) == [("1",)] and checked.rejects.count() == 1


def test_sources_without_records(spark):
    checked = load_checked(spark, LoadSpec("T", Source("inline", text="a,b\n1,2")))
    assert rows(checked.rows) == [("1", "2")] and checked.rejects.collect() == [] and checked.finished().rejected_rows == 0
    assert load_checked(spark, LoadSpec("T", Source(path="a.qvd"), (Field("x"),))).status.status == "schema-only"


def books(tmp_path):
    good = book_of([["Key", "Name"], *([i, f"n{i}"] for i in range(25))])
    (tmp_path / "a.xlsx").write_bytes(good)
    (tmp_path / "cut.xlsx").write_bytes(good[: len(good) // 2])
    flipped = bytearray(good)
    at = good.index(b"sheet2.xml") + 40
    flipped[at : at + 20] = bytes(b ^ 0xFF for b in flipped[at : at + 20])
    (tmp_path / "flipped.xlsx").write_bytes(bytes(flipped))
    (tmp_path / "text.xlsx").write_bytes(b"no workbook")
    (tmp_path / "tail.xlsx").write_bytes(good + b"\n")


@pytest.mark.parametrize("batch", [7, 10_000])
def test_faulty_workbooks_are_named(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(workbook, "BATCH_ROWS", batch)
    books(tmp_path)
    types = TypeBook([{"name": "Key", "tags": ["$integer"]}])
    wanted = spec(tmp_path, "Key", "Name", kind="excel", table="Data$")
    checked = load_checked(spark, wanted, types)
    assert rows(checked.rows) == sorted([(i, f"n{i}") for i in range(25)] * 2, key=str)
    status = checked.finished()
    assert [f.rsplit("/", 1)[1] for f in status.faulty_files] == ["cut.xlsx", "flipped.xlsx", "text.xlsx"] and status.n_faulty == 3
    assert {r["record"].split(":")[0] for r in checked.rejects.where("file LIKE '%text%'").collect()} == {"BadZipFile"}
    assert rows(load_table(spark, wanted, types)[0]) == rows(checked.rows)
    star = load_table(spark, LoadSpec("T", Source("excel", str(tmp_path), {**LABELS, "table": "Data"})))[0]
    assert star.columns == ["Key", "Name"] and star.count() == 50


def test_a_sheet_that_is_not_there_is_a_fault(spark, tmp_path):
    books(tmp_path)
    checked = load_checked(spark, spec(tmp_path / "a.xlsx", "Key", kind="excel", table="Other"))
    assert checked.rows.collect() == []
    assert checked.finished().n_faulty == 1 and "NoSheet" in checked.rejects.first()["record"]


def test_shared_strings(spark, tmp_path):
    """Texts that stand in the common table, with runs of several pieces."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "s.xlsx"
    path.write_bytes(book_of([]))
    out = io.BytesIO()
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(out, "w") as book:
        for name in old.namelist():
            if name != "xl/worksheets/sheet1.xml":
                book.writestr(name, old.read(name))
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Label</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        cells = '<row><c t="s"><v>0</v></c></row><row><c t="s"><v>1</v></c></row><row><c r="B3" t="b"><v>1</v></c></row>'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    path.write_bytes(out.getvalue())
    df = load_table(spark, spec(path, "Label", kind="excel"))[0]
    assert df.where(F.col("Label").isNotNull()).collect() == [("ab",)] and df.count() == 2
