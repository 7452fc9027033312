import pytest
from pyspark.sql import functions as F

from tallyloom.operators import scripts as sc


def corpus(spark, *texts):
    return spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(texts)], "app string, script string")


def loads(spark, text):
    return sc.parse_loads(corpus(spark, text)).orderBy("pos").collect()


def fields(spark, text):
    out = sc.script_fields(sc.parse_loads(corpus(spark, text))).orderBy("load_pos", "pos").collect()
    return [(r["field"], r["expression"], r["is_derived"]) for r in out]


def clean(spark, text):
    return sc.clean_scripts(corpus(spark, text)).first()["script"]


@pytest.mark.parametrize(
    "text, left",
    [
        ("a // b\nc", "a \nc"), ("x 'lib://a/b' // c", "x 'lib://a/b' "), ("[a//b] /* c\n */ d", "[a//b]  d"),
        ("REM gone;\nkept;", "\nkept;"), ("a; REM kept here", "a; REM kept here"), ("a;rem gone; b", "a; b"),
        ("/* open", ""), ("'open // quote", "'open // quote"), ("[open // gone", "[open "), ("THEOREM x;", "THEOREM x;"),
        ('a "b /* c */" d', 'a "b /* c */" d'), ("a\r\nb", "a\nb"),
    ],
)
def test_comments(spark, text, left):
    assert clean(spark, text) == left


def test_statements_keep_quoted_semicolons(spark):
    out = sc.script_statements(corpus(spark, "a ';' b;;\n [x;y]; \"p;q\" z; last"))
    assert [r["statement"] for r in out.orderBy("pos").collect()] == ["a ';' b", "[x;y]", '"p;q" z', "last"]


def test_long_scripts_do_not_exhaust_the_stack(spark):
    body = "\n".join(f"row {i},'value; {i}'" for i in range(40_000))
    text = f"T: LOAD k, v INLINE [k,v\n{body}\n];\n" + "".join(f"SET v{i} = '{i}'; // {i}\n" for i in range(3000)) + "U: LOAD a FROM b.csv;"
    out = {r["table"]: r["pos"] for r in loads(spark, text)}
    assert out == {"T": 0, "U": 3001}


@pytest.mark.parametrize("label", ["Cases", "Stores", "Document", "Forecast", "Settings", "Case", "[Set of x]"])
def test_labels_that_begin_like_keywords(spark, label):
    assert [r["table"] for r in loads(spark, f"{label}: LOAD a FROM x.csv")] == [label.strip("[]")]


@pytest.mark.parametrize(
    "text", ["SET x = LOAD", "TRACE LOAD a FROM b", "JOIN (T) LOAD a FROM b.csv", "a LOADER b", "STORE T INTO LOAD", "DECLARE FIELD DEFINITION LOAD"]
)
def test_statements_that_load_nothing(spark, text):
    assert loads(spark, text) == []


def test_star_of_an_inline_block(spark):
    assert [f[0] for f in fields(spark, "T: LOAD * INLINE [\n'a' | b c\n1|2] (delimiter is '|')")] == ["a", "b c"]
    assert fields(spark, "T: LOAD * FROM x.csv") == [("*", "*", False)]


def test_resident_name_without_its_filter(spark):
    row = loads(spark, "LOAD a RESIDENT [My Table] WHERE a > 1 ORDER BY a")[0]
    assert (row["resident"], row["table"], row["filter"]) == ("My Table", "My Table", "WHERE a > 1 ORDER BY a")


def test_derived_unless_a_bare_name(spark):
    text = "T: LOAD Year(d), [Net Sales (x)], Amount, a+b AS c, [Order ID] AS id, 'x' AS y, Sub-Category FROM t.csv"
    assert fields(spark, text) == [
        ("Year(d)", "Year(d)", True), ("Net Sales (x)", "[Net Sales (x)]", False), ("Amount", "Amount", False),
        ("c", "a+b", True), ("id", "[Order ID]", False), ("y", "'x'", False), ("Sub-Category", "Sub-Category", True),
    ]


def test_commas_and_keywords_inside_parentheses(spark):
    text = "T: LOAD If(a in ('x, y', 'z'), Peek('b', -1, 'FROM'), (c, (d))) AS e, [f, g] AS [h, FROM i] FROM [p from q.csv] (txt)"
    assert [f[0] for f in fields(spark, text)] == ["e", "h, FROM i"]
    assert loads(spark, text)[0]["path"] == "p from q.csv"


def test_alias_is_the_outer_one(spark):
    assert fields(spark, "T: LOAD Date(x, 'a as b') as [Sold as New], Basil FROM t.csv")[0][:2] == ("Sold as New", "Date(x, 'a as b')")


def test_tags_and_prefixes(spark):
    row = loads(spark, "Map: MAPPING LOAD a Tagged ('$key', $text) RESIDENT t")[0]
    assert row["is_mapping"] and row["fields"][0]["tags"] == ["$key", "$text"] and row["fields"][0]["field"] == "a"
    assert loads(spark, "ADD LOAD a FROM x.csv")[0]["table"] == "x"
    assert loads(spark, "CONCATENATE (Sales) LOAD a FROM x.csv")[0]["table"] == "Sales"


def test_variables(spark):
    text = "SET a = 1;\nLET b = Now();\nLET c = 'x(y)';\nLET d = 'lit';\nSet A = $(d)/z;\nSET e=$(a);SET f = 3;\n"
    out = {r["name"]: (r["value"], r["expanded"]) for r in sc.script_variables(corpus(spark, text)).collect()}
    # an assignment counts where it begins a line
    assert out == {"d": ("lit", "lit"), "a": ("$(d)/z", "lit/z"), "e": ("$(a)", "lit/z")}


def test_expansion_stops(spark):
    text = "SET a = $(b)x;\nSET b = $(a)y;\nT: LOAD k FROM $(a).csv;"
    path = loads(spark, text)[0]["path"]
    assert path.endswith(".csv") and path.count("x") + path.count("y") == 6


@pytest.mark.parametrize(
    "tail, kind, path",
    [
        ("FROM a.QVD", "qvd", "a.QVD"), ("FROM [lib://D/x y.txt]", "delimited", "lib://D/x y.txt"), ("FROM a.bin (biff)", "xls", "a.bin"),
        ("FROM a", "unknown", "a"), ("FROM f(1).csv", "delimited", "f(1).csv"), ("SQL SELECT x FROM t", "sql", ""), ("", "unknown", ""),
        ("FROM 'a.tab' (txt, delimiter is \\t) WHERE x = '('", "delimited", "a.tab"), ("FROM a.json (json)", "json", "a.json"),
    ],
)
def test_sources(spark, tail, kind, path):
    row = loads(spark, f"T: LOAD k {tail}")[0]
    assert (row["kind"], row["path"]) == (kind, path)


def test_unnamed_loads(spark):
    assert [r["table"] for r in loads(spark, "LOAD a;\nLOAD b FROM [lib://D/sub/File.Name.csv];\nLOAD c INLINE [c\n1]")] == [
        "Table_0", "File.Name", "Table_2"
    ]


def test_repeated_loads_merge(spark):
    text = "T: LOAD a, B;\nt: LOAD b, c FROM x.csv;\nT: LOAD d RESIDENT u;\nMap: MAPPING LOAD z FROM m.csv;"
    row = sc.parse_tables(corpus(spark, text)).collect()
    assert len(row) == 1
    assert (row[0]["table"], row[0]["kind"], row[0]["path"], row[0]["n_loads"]) == ("T", "delimited", "x.csv", 3)
    assert [f["field"] for f in row[0]["fields"]] == ["a", "B", "c", "d"]


def test_plain_field_names(spark):
    text = "LOAD a, [b c] AS d, " + "x" * 61 + ", load e, if(f) , A\nFROM t;"
    got = sc.script_field_names(corpus(spark, text)).orderBy("pos").collect()
    assert [r["field"] for r in got] == ["a", "d"]


def test_plain_field_names_give_way_to_metadata(spark):
    known = [("a0", "LOAD x\nFROM t;", ["abc", "def", "ghi", "jkl"]), ("a1", "LOAD y\nFROM t;", ["abc", "de"])]
    df = spark.createDataFrame(known, "app string, script string, known array<string>")
    assert [(r["app"], r["field"]) for r in sc.script_field_names(df, F.col("known")).collect()] == [("a1", "y")]


def test_no_shuffle_from_script_to_tables(spark):
    plan = sc.audit_tables(sc.parse_tables(corpus(spark, "T: LOAD a FROM b.csv")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
