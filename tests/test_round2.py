"""Large objects, stars, odd numbers and names, sheets that stand whatever they are asked."""

import datetime
import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.functions.names import unique_columns
from tallyloom.functions.types import typed
from tallyloom.operators import catalog as cat
from tallyloom.operators import scripts as sc
from tallyloom.plans import sheets
from tallyloom.plans.aggregate import aggregate
from tallyloom.session import scratch_path
from tallyloom.sources import workbook
from tallyloom.sources.load import load_table
from tallyloom.sources.spec import Field, LoadSpec, Source, spec_of


@pytest.mark.parametrize("mib", [1, 25, 60])
def test_objects_of_any_size(spark, mib):
    text = F.concat(F.lit('{"qScript":"'), F.repeat(F.concat(F.lit("LOAD a;"), F.col("id")), F.lit(mib << 17)), F.lit('"}'))
    path = scratch_path(spark, "objects")
    spark.range(1).select(F.lit("a").alias("app"), F.lit(1).alias("offset"), text.alias("text")).write.parquet(path)
    objects = spark.read.parquet(path)
    assert cat.classify(objects).select("kind", F.length("text")).collect() == [("script", (mib << 20) + 14)]
    assert cat.catalog_scripts(objects).select(F.length("script")).first()[0] == mib << 20
    assert cat.unreadable(objects).collect() == []


def test_unreadable_objects(spark):
    texts = [None, "", "no json", '{"qScript": "cut', "[1, 2]", '{"a": 1}']
    objects = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "app string, offset long, text string")
    assert {(r["offset"], r["reason"]) for r in cat.unreadable(objects).collect()} == {
        (0, "no text"), (1, "no JSON"), (2, "no JSON"), (3, "broken or cut JSON object"),
    }
    assert {r["offset"] for r in cat.classify(objects).collect()} == {4, 5}


@pytest.mark.parametrize(
    "text, whole, number",
    [
        ("10d", None, None), ("7f", None, None), ("0x1F", None, None), ("12", 12, 12.0), (" 5 ", 5, 5.0), ("1e3", 1000, 1000.0),
        ("0000000000000000000009007199254740993", 9007199254740993, 9007199254740992.0), ("9007199254740993.0", 9007199254740993, 9007199254740992.0),
        ("2.5", 2, 2.5), ("3.5", 4, 3.5), ("-.5", 0, -0.5), ("5.", 5, 5.0), ("99999999999999999999", None, 1e20), ("", None, None), ("-", None, None),
    ],
)
def test_numbers_from_text(spark, text, whole, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(typed(F.col("t"), "int64"), typed(F.col("t"), "double")).first()) == (whole, number)


def plain_unique(names):
    seen, out = set(), []
    for name in names:
        chosen, n = name, 2
        while chosen.lower() in seen:
            chosen, n = f"{name}_{n}", n + 1
        seen.add(chosen.lower())
        out.append(chosen)
    return out


@pytest.mark.parametrize(
    "names", [["a", "A", "a_2", "a", "a_2", "A_3"], ["a_2", "a", "a", "a"], ["x"] * 7, ["b", "b_2", "b_3", "b", "B", "b_2", "b_2_2"], ["n"]]
)
def test_unique_names(spark, names):
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(unique_columns(F.col("n"))).first()[0] == plain_unique(names)


def test_many_equal_names(spark):
    names = [f"c{i}" for i in range(1000)] + ["same"] * 1000
    df = spark.createDataFrame([(names,)] * 2, "n array<string>").select(unique_columns(F.col("n")).alias("u"))
    df.limit(1).collect()
    start = time.time()
    rows = df.collect()
    assert rows[0][0] == plain_unique(names) and time.time() - start < 6


def test_median_of_a_tight_cluster_and_an_outlier(spark):
    base = 1_700_000_000_000_000
    df = spark.range(200_000).select((F.lit(base) + F.col("id")).cast("double").alias("x"), F.lit("g").alias("g"))
    df = df.unionByName(spark.createDataFrame([(base * 1.0015, "g"), (1e300, "g"), (-5.0, "g")], "x double, g string"))
    exact = df.select(F.median("x")).first()[0]
    for dims in ([], ["g"]):
        assert aggregate(df, dims, [M.median("x").named("m")]).first()["m"] == exact


def test_names_in_any_case_and_absent_columns(spark):
    df = spark.createDataFrame([("n", 2, 3.0), ("s", 4, 5.0)], "Region string, Amount int, Price double")
    measures = [M.total("amount").named("t"), M.filtered(M.total("PRICE"), "region", "n").named("f"), M.total("none").named("b")]
    assert aggregate(df, [], measures).collect() == [(6, 3.0, None)]
    assert aggregate(df, ["region"], [M.ratio(M.total("amount"), M.total("gone")).named("r")]).select("r").distinct().collect() == [(None,)]


def test_sheets_with_texts_dates_and_many_dimensions(spark):
    dims = [f"d{i}" for i in range(70)]
    row = [str(i) for i in range(70)]
    day = datetime.date(2024, 5, 6)
    df = spark.createDataFrame([(*row, "word", day)], ", ".join(f"{d} string" for d in dims) + ", t string, day date")
    visuals = [sheets.Visual(d, d.upper()) for d in dims]
    visuals += [sheets.Visual("only", "d1", M.only("t")), sheets.Visual("latest", None, M.maximum("day")), sheets.Visual("gone", "nowhere")]
    got = {r["visual"]: tuple(r)[1:] for r in sheets.sheet(df, visuals).collect()}
    assert len(got) == 73 and got["d69"] == ("69", 1.0, None)
    assert got["only"] == ("1", None, "word") and got["latest"] == (None, None, "2024-05-06") and got["gone"] == (None, None, None)


def xlsx(rows):
    cells = "".join(
        "<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in row) + "</row>" for row in rows
    )
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="sheet.xml"/></Relationships>')
        book.writestr("xl/sheet.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_star_over_workbooks_and_broken_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx([["k", "v"], ["1", "x"]]))
    (tmp_path / "b.xlsx").write_bytes(xlsx([["v", "w"], ["y", "z"]]))
    (tmp_path / "c.xlsx").write_bytes(b"PK no workbook")
    spec = LoadSpec("T", Source("excel", f"file://{tmp_path}", {"embedded_labels": True}), (Field("Value", "v"),), star=True)
    df, status = load_table(spark, spec)
    assert status.status == "connected" and df.columns == ["k", "v", "w", "Value"]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [("1", "x", None, "x"), (None, "y", "z", "y")]))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    assert [r["path"].rsplit("/", 1)[1] for r in workbook.faulty_workbooks(files).collect()] == ["c.xlsx"]


@pytest.mark.parametrize("kind, path", [("", "old.xls"), ("xml", "rows.xml")])
def test_sources_that_cannot_be_read_end_as_schema_only(spark, kind, path):
    df, status = load_table(spark, LoadSpec("T", Source(kind, path), (Field("a"),)))
    assert status.status == "schema-only" and status.reason and df.columns == ["a"] and df.count() == 0


def test_filters_and_stars_of_scripts_are_carried(spark):
    script = "T: LOAD *, Upper(a) AS U, a AS b FROM [t.csv] (txt, embedded labels) WHERE a > 3;"
    load = sc.parse_loads(spark.createDataFrame([("x", script)], "app string, script string")).first()
    spec = spec_of(load)
    assert spec.star and spec.unapplied_filter == "WHERE a > 3"
    assert [f.name for f in spec.physical()] == ["b"] and [f.name for f in spec.dropped()] == ["U"]
