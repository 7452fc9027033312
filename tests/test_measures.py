import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.plans import sheets, visuals
from tallyloom.plans.aggregate import aggregate, exact_median


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("a", "x", 1.0, 2.0), ("a", "y", None, 0.0), ("b", "x", 3.0, 0.0), (None, "x", 5.0, None), ("b", "X", 7.0, 0.0)]
    return spark.createDataFrame(rows, "g string, h string, n double, d double")


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_counts_skip_null_but_not_empty_text(spark):
    df = spark.createDataFrame([("",), (None,), ("v",)], "f string")
    row = aggregate(df, [], [M.row_count(), M.count("f"), M.count_distinct("f")]).first()
    assert tuple(row) == (3, 2, 2)
    assert aggregate(df, [], [M.count_distinct("f", count_blank=True)]).first()[0] == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "f double")
    row = aggregate(df, [], [M.row_count(), M.total("f"), M.average("f"), M.median("f"), M.only("f")]).first()
    assert tuple(row) == (0, None, None, None, None)
    assert aggregate(df, [], [M.median("f"), M.total("f")], median="distributed").first()[0] is None


def test_ratio_of_nothing_is_zero(sales):
    assert values(aggregate(sales, ["g"], [M.ratio(M.total("n"), M.total("d"))])) == {"a": 0.5, "b": 0.0, None: 0.0}


def test_ratio_keeps_a_blank_numerator(spark):
    df = spark.createDataFrame([(None, 2.0)], "n double, d double")
    assert aggregate(df, [], [M.ratio(M.total("n"), M.total("d"))]).first()[0] is None


def test_ratio_takes_known_parts_only():
    with pytest.raises(ValueError):
        M.ratio(M.median("n"), M.total("d"))


def test_only_is_strict_on_request(sales):
    assert values(aggregate(sales, ["g"], [M.only("n")])) == {"a": 1.0, "b": 3.0, None: 5.0}
    assert values(aggregate(sales, ["g"], [M.only("n", strict=True)])) == {"a": 1.0, "b": None, None: 5.0}


def test_filter_reads_its_value_as_the_field_s_type(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, n double")
    assert aggregate(df, [], [M.filtered(M.total("n"), "k", "2")]).first()[0] == 3.0
    assert aggregate(df, [], [M.filtered(M.total("n"), "k", "no number")]).first()[0] is None
    assert aggregate(df, [], [M.filtered(M.count("n"), "k")]).first()[0] == 0


def test_filter_on_the_own_dimension_replaces_it(sales):
    assert values(visuals.category(sales, "g", M.filtered(M.total("n"), "g", "b"))) == {"a": 10.0, "b": 10.0, None: 10.0}
    beside = values(visuals.category(sales, "g", M.filtered(M.total("n"), "h", "x")))
    assert beside == {"a": 1.0, "b": 3.0, None: 5.0}


def test_a_lone_filtered_card_filters_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    card = visuals.card(df, M.filtered(M.total("o_totalprice"), "o_orderstatus", "F"))
    assert "EqualTo(o_orderstatus,F)" in card._jdf.queryExecution().toString()


def test_names():
    assert M.total("net sales").name == "Net Sales Sum"
    assert M.total("netSales").name == "netSales Sum"
    assert M.count_distinct("OrderID").name == "Unique OrderID"
    assert M.ratio(M.total("Profit"), M.total("sales")).name == "Profit per Sales"
    assert M.filtered(M.count("CaseID"), "Status", "Open").name == "CaseID Count (Open)"
    assert M.filtered(M.total("x"), "Status", "a", "b").name == "X Sum (Filtered)"
    assert M.unresolved("Aggr(Sum(x), [y])").name == "[Needs Review] Aggr Sum x y"


def test_hidden_blanks_and_case(sales):
    assert "b" not in values(visuals.category(sales, "g", M.filtered(M.total("n"), "h", "y"), hide_blank=True))
    folded = values(visuals.category(sales.where("h is not null"), "h", M.row_count(), ignore_case=True))
    assert {k.lower(): v for k, v in folded.items()} == {"x": 4, "y": 1}


def test_sorted_category(sales):
    out = visuals.category(sales, "g", M.total("n"), order_by=[F.col("`N Sum`").desc()])
    assert [r[0] for r in out.collect()] == ["b", None, "a"]


def test_resolve_field():
    columns = ["Region", "SALES"]
    assert visuals.resolve_field(columns, "[sales]") == "SALES"
    assert visuals.resolve_field(columns, "none") == "Region"
    with pytest.raises(KeyError):
        visuals.resolve_field(columns, "none", strict=True)


@pytest.mark.parametrize("seed", range(4))
def test_distributed_median_is_exact(spark, seed):
    rng = random.Random(seed)
    pools = [
        lambda: rng.choice([-1.5, 0.0, 2.0, 2.0]), lambda: rng.uniform(-1e6, 1e6), lambda: rng.expovariate(1) * 1e-9,
        lambda: float(rng.randint(-3, 3)), lambda: None if rng.random() < 0.3 else 10 ** rng.uniform(-300, 300),
    ]
    rows = [(k if k < 4 else None, pools[k]()) for k in range(5) for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "k int, v double")
    expected = {}
    for key in {k for k, _ in rows}:
        held = [v for k, v in rows if k == key and v is not None]
        expected[key] = statistics.median(held) if held else None
    got = values(exact_median(df, ["k"], "v"))
    assert {k: v for k, v in expected.items() if v is not None} == pytest.approx(got, rel=1e-12)
    everything = [v for _, v in rows if v is not None]
    assert exact_median(df, [], "v").first()[0] == pytest.approx(statistics.median(everything), rel=1e-12)


def test_median_of_infinite_and_missing_numbers(spark):
    df = spark.createDataFrame([(float("inf"),), (-math.inf,), (4.0,), (math.nan,), (5.0,)], "v double")
    both = [exact_median(df, [], "v").first()[0], df.agg(F.median("v")).first()[0]]
    assert both[0] == both[1] == 5.0


def test_medians_join_other_measures(sales):
    measures = [M.median("n"), M.total("n"), M.row_count()]
    built_in = sorted(map(tuple, aggregate(sales, ["g"], measures, median="builtin").collect()), key=str)
    apart = sorted(map(tuple, aggregate(sales, ["g"], measures, median="distributed").collect()), key=str)
    assert built_in == apart


def test_a_hot_group_is_not_gathered_for_its_median(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    held = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert values(exact_median(df, ["g"], "v")) == {"hot": (held[99_999] + held[100_000]) / 2}


def test_sheet_of_an_empty_table_shows_its_cards(spark):
    df = spark.createDataFrame([], "g string, n double")
    cards = [sheets.Visual("rows"), sheets.Visual("sum", None, M.total("n")), sheets.Visual("by", "g", M.total("n"))]
    assert {r["visual"]: r["value"] for r in sheets.sheet(df, cards).collect()} == {"rows": 0.0, "sum": None}


def test_sheet_scans_once_for_all_simple_visuals(spark, lineitem):
    page = sheets.kpi_page(
        ["l_returnflag", "l_linestatus"], [M.total("l_quantity"), M.average("l_tax"), M.maximum("l_discount")]
    )
    plan = sheets.sheet(lineitem, page)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "l_comment" not in plan and "l_orderkey" not in plan


def test_sheet_keeps_a_null_category_apart_from_the_total(sales):
    rows = sheets.sheet(sales, [sheets.Visual("all", None, M.total("n")), sheets.Visual("by g", "g", M.total("n"))]).collect()
    assert sorted((r[0], str(r[1]), r[2]) for r in rows) == [
        ("all", "None", 16.0), ("by g", "None", 5.0), ("by g", "a", 1.0), ("by g", "b", 10.0)
    ]


def test_unrelated_needs_no_cross_join(sales, lineitem):
    out = visuals.unrelated(sales, "g", lineitem, M.row_count())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r[1] for r in out.collect()} == {lineitem.count()}
