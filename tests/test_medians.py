"""Medians of many groups and columns in shared passes."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import measures as M
from tallyloom.plans import medians, sheets
from tallyloom.plans.aggregate import aggregate, exact_median


def middle(values):
    held = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return statistics.median(held) if held else None


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(9)
    rows = [
        (rng.choice(["a", "b", None]), rng.randint(0, 6), rng.uniform(-5, 5) if rng.random() < 0.9 else None, float(rng.randint(0, 3)))
        for _ in range(4000)
    ] + [("none", 99, None, None)]
    return rows, spark.createDataFrame(rows, "g string, h int, x double, y double").cache()


@pytest.mark.parametrize("grid, few", [(200, 1 << 20), (16, 40), (2, 1)])
def test_brackets_narrow_until_few_values_are_left(numbers, monkeypatch, grid, few):
    rows, df = numbers
    monkeypatch.setattr(medians, "GRID", grid)
    monkeypatch.setattr(medians, "FEW", few)
    got = {r["g"]: r["m"] for r in exact_median(df, ["g"], "x", "m").collect()}
    assert got == {g: middle(r[2] for r in rows if r[0] == g) for g in {r[0] for r in rows}}


def test_a_sketch_that_misses_is_widened(numbers, monkeypatch):
    """Ranks are counted, so an answer never rests on a sketch."""
    rows, df = numbers
    rough = F.percentile_approx
    monkeypatch.setattr(medians.F, "percentile_approx", lambda c, p, a: F.transform(rough(c, p, a), lambda v: v + 0.3))
    assert exact_median(df, [], "x").first()[0] == middle(r[2] for r in rows)


def test_several_medians_share_the_passes(numbers, monkeypatch):
    rows, df = numbers
    calls, original = [], medians._narrowed
    monkeypatch.setattr(medians, "_narrowed", lambda *a: calls.append(1) or original(*a))
    measures = [M.median("x"), M.median("y"), M.filtered(M.total("y"), "g", "a"), M.row_count()]
    got = {(r[0], r[1]): tuple(r)[2:4] for r in aggregate(df, ["g", "h"], measures).collect()}
    groups = {(r[0], r[1]) for r in rows}
    assert got == {k: tuple(middle(r[i] for r in rows if (r[0], r[1]) == k) for i in (2, 3)) for k in groups}
    assert len(calls) == 1


def test_medians_of_a_sheet_share_the_passes(numbers, monkeypatch):
    rows, df = numbers
    calls, original = [], medians._narrowed
    monkeypatch.setattr(medians, "_narrowed", lambda *a: calls.append(1) or original(*a))
    page = [sheets.Visual("by g", "g", M.median("x")), sheets.Visual("by h", "H", M.median("y")), sheets.Visual("all", None, M.median("x"))]
    got = {(r["visual"], r["category"]): r["value"] for r in sheets.sheet(df, page).collect()}
    expected = {("by g", g): middle(r[2] for r in rows if r[0] == g) for g in {r[0] for r in rows}}
    expected |= {("by h", str(h)): middle(r[3] for r in rows if r[1] == h) for h in {r[1] for r in rows}}
    assert got == expected | {("all", None): middle(r[2] for r in rows)} and len(calls) == 1
    empty = {r["visual"]: r["value"] for r in sheets.sheet(df.limit(0), page).collect()}
    assert empty == {"all": None}


def test_ends_of_the_range(spark):
    for held in ([math.inf] * 3, [-math.inf, math.inf, 1.0], [math.nan] * 3, [math.nan, 1.0, math.nan], [0.0, -0.0], [1e308, 1.7e308, 1e308], [5e-324, 0.0]):
        got = exact_median(spark.createDataFrame([(v,) for v in held], "v double"), [], "v").first()[0]
        assert got == middle(held) or (math.isnan(got) and math.isnan(middle(held)))
    assert exact_median(spark.createDataFrame([], "v double"), [], "v").first()[0] is None
    assert exact_median(spark.createDataFrame([], "k int, v double"), ["k"], "v").collect() == []
