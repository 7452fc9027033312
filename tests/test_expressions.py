import pytest

from tallyloom.functions import measures as M
from tallyloom.operators import expressions as ex
from tallyloom.operators import fields as fo
from tallyloom.plans.aggregate import aggregate


def classified(spark, *texts, known=None):
    df = spark.createDataFrame([(i, t, known or []) for i, t in enumerate(texts)], "i int, expression string, known array<string>")
    return ex.classify(df, "known").orderBy("i").collect()


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Sum(a)/Sum(b)", "ratio"), ("Sum(A)+Count(B)", "unresolved"), ("Sum(a*b)", "unresolved"), ("Total Sum(a)", "unresolved"),
        ("sum ( [a b] )", "simple"), ("COUNT(DISTINCT x)", "count_distinct"), ("Count(DISTINCT [x])", "count_distinct"),
        ("Max({<y={1}>} x)", "filtered_eq"), ("Median({<y={1}>} x)", "unresolved"), ("Median(a)/Sum(b)", "unresolved"),
        (None, "rows"), ("  ", "rows"), ("Sum([a)", "unresolved"),
    ],
)
def test_whole_text_decides(spark, text, kind):
    assert classified(spark, text)[0]["class"] == kind


def test_known_spelling(spark):
    row = classified(spark, "sum(net)/count([cust id])", known=["NET", "Cust ID"])[0]
    assert (row["field"], row["field2"], row["measure"]) == ("NET", "Cust ID", "NET per Cust ID")


def test_classified_expressions_become_measures(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", None)], "s string, x double")
    texts = ["Sum(x)", "Count(x)", "Count(DISTINCT s)", "Avg(x)/Count(x)", "Sum({<s={'b'}>} x)", "Count({<s={'a','b'}>} x)", "Aggr(x)", ""]
    measures = [M.from_class(r) for r in classified(spark, *texts)]
    assert tuple(aggregate(df, [], measures).first()) == (4.0, 2, 2, 1.0, 3.0, 2, None, 3)


def test_names_agree_with_the_driver_side(spark):
    texts = ["Sum(net_sales)", "Stdev(Qty)", "Only(x)", "Count(x)", "Sum(a)/Sum(B)", "Min({<s={'q'}>} x)", "what? [is] (this)"]
    rows = classified(spark, *texts)
    assert [M.from_class(r).name for r in rows] == [r["measure"] for r in rows]


def test_targets_and_owner(spark):
    fields = spark.createDataFrame(
        [("a", "T", "Sales", 0, 0), ("a", "U", "sales", 1, 0), ("a", "U", "City", 1, 1), ("b", "T", "City", 0, 0)],
        "app string, table string, field string, load_pos int, pos int",
    )
    expressions = spark.createDataFrame([("a", "Sum(SALES)"), ("a", "Sum(SALES)"), ("b", "Sum([Sales])")], "app string, expression string")
    assert sorted(map(tuple, ex.measure_targets(expressions, fields).collect())) == [("a", "Sum(SALES)", "T"), ("a", "Sum(SALES)", "U")]
    assert {(r["app"], r["field"]): r["table"] for r in fo.field_owner(fields).collect()} == {
        ("a", "sales"): "T", ("a", "city"): "U", ("b", "city"): "T"
    }
    assert {r["app"]: r["table"] for r in fo.primary_table(fields).collect()} == {"a": "U", "b": "T"}
