import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed, names
from tallyloom.functions.types import TypeBook, resolve_type, typed
from tallyloom.operators.preview import synthetic_value


def in_order(taken, words):
    """Names made unique one after another: the plain rule, for comparison."""
    seen, out = {t.lower() for t in taken}, []
    for word in words:
        name, n = word, 2
        while name.lower() in seen:
            name, n = f"{word}_{n}", n + 1
        seen.add(name.lower())
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_follow_the_order(spark, seed):
    rng = random.Random(seed)
    stems = ["a", "A", "a_2", "A_2", "a_3", "b", "b_2_2", "b_2", "c"]
    lists = [[rng.choice(stems) for _ in range(rng.randint(0, 12))] for _ in range(80)]
    df = spark.createDataFrame([(i, words) for i, words in enumerate(lists)], "i int, words array<string>")
    got = dict(df.select("i", names.unique_columns(F.col("words"))).collect())
    assert got == {i: in_order([], words) for i, words in enumerate(lists)}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def words(*items):
    return F.array(*[F.lit(x) for x in items])


def test_reserved_words(spark):
    assert one(spark, names.sanitize_columns(words("Data", "DATA", "Database", " Query "))) == [
        "Entity_Data", "Entity_DATA_2", "Database", "Entity_Query"
    ]


def test_measure_names_avoid_columns(spark):
    got = one(spark, names.measure_names(words("Sum(x)", "Sum x", "%%"), words("total_sumx")))
    assert got == ["Total_Sumx_2", "Total_Sum_x", "Total_Measure_3"]


@pytest.mark.parametrize(
    "name, safe",
    [(" Sales 2024 ", "Sales_2024"), ("1st", "T_1st"), ("__a__", "a"), ("é", fixed.DEFAULT_TABLE_NAME), ("", fixed.DEFAULT_TABLE_NAME), (None, fixed.DEFAULT_TABLE_NAME)],
)
def test_safe_table_name(spark, name, safe):
    assert one(spark, names.safe_table_name(F.lit(name).cast("string"))) == safe


def test_title_case(spark):
    for text in ("order_qty", "it's 3rd-party", "ÄRA über x2y"):
        assert one(spark, names.title_case(F.lit(text))) == text.title()


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("3.5", "int64", 4), ("2.5", "int64", 2), ("-2.5", "int64", -2), (" 7 ", "int64", 7), ("", "int64", None),
        ("9007199254740993", "int64", 9007199254740993), ("99999999999999999999", "int64", None), ("1,234", "int64", None),
        ("1e3", "int64", 1000), ("x", "double", None), (".5", "double", 0.5), ("-1e-3", "double", -0.001), ("yes", "boolean", True),
        ("maybe", "boolean", None), ("", "string", ""),
    ],
)
def test_typed(spark, text, kind, value):
    assert one(spark, typed(F.lit(text), kind)) == value


def test_typed_dates(spark):
    assert str(one(spark, typed(F.lit("2024-03-01 10:00:00"), "dateTime"))) == "2024-03-01 10:00:00"
    assert one(spark, typed(F.lit("1/5/2024"), "dateTime")) is None
    assert str(one(spark, typed(F.lit("1/5/2024"), "dateTime", ["M/d/yyyy"]))) == "2024-01-05 00:00:00"
    assert str(one(spark, typed(F.lit("45292.5"), "dateTime", serial_dates=True))) == "2024-01-01 12:00:00"
    with pytest.raises(ValueError):
        typed(F.lit("x"), "money")


@pytest.mark.parametrize(
    "tags, numeric, kind",
    [
        (["$DATE", "$numeric"], True, "dateTime"), (["$text"], True, "string"), (["$text", "$numeric"], False, "double"),
        (["$integer"], False, "int64"), ([], True, "double"), ([], False, "string"),
    ],
)
def test_evidence_is_the_same_on_both_sides(spark, tags, numeric, kind):
    column = resolve_type(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), F.lit(numeric))
    assert one(spark, column) == kind
    assert TypeBook([{"name": "Id", "tags": tags, "is_numeric": numeric}]).type_of("ID") == kind


def test_types_never_come_from_names(spark):
    assert TypeBook().type_of("Amount") == "string"
    assert one(spark, names.name_type(F.lit("Amount"))) == "double"


def test_roles_fall_back(spark):
    listed = words("x", "Genre of film", "y")
    assert one(spark, names.numeric_role(listed)) == "y"
    assert one(spark, names.category_role(listed)) == "Genre of film"
    assert one(spark, names.identifier_role(words("p", "q"))) == "p"


def test_preview_values(spark):
    assert one(spark, synthetic_value(F.lit("Sales"), F.lit(70))) == str((70 * 125 + 450) % 8500 + 150)
    assert one(spark, synthetic_value(F.lit("Rating"), F.lit(20))) == "3.0"
    assert one(spark, synthetic_value(F.lit("row_id"), F.lit(1))) == "row_id_1001"


@pytest.mark.parametrize(
    "words",
    [
        ["a"] * 300 + [f"a_{i}" for i in range(2, 302)],
        [f"a_{i}" for i in range(300, 1, -2)] + ["A"] * 300,
        ["a", "A", "a_2", "a", "a_2_2", "a_2", "a_3", "a_03", "a"] * 20,
        [f"n{i // 3}" for i in range(3000)],
    ],
)
def test_many_names_that_end_in_numbers(spark, words):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(names.unique_columns(F.col("w"))).first()[0] == in_order([], words)
