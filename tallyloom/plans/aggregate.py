"""One grouped pass for many measures, with a plan of its own for large exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import field
from tallyloom.functions.measures import MEDIAN, Measure, actual_name
from tallyloom.plans.medians import exact_medians, matched


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that also matches null keys; the keys come once."""
    return matched(left, right, keys, "left")


def aggregate(df: DataFrame, dims: list[str], measures: list[Measure], median: str = "distributed") -> DataFrame:
    """``dims`` and one column per measure; one row in all when there are no dims.

    Names count without regard to case; a measure of a column that is not there is blank.
    ``median`` is ``distributed``, which no group is too large for and which runs its passes at once, those of all medians
    together, or ``builtin``, which holds a group in one task. Both are exact.
    """
    measures = [m.bound(df.columns) for m in measures]
    dims = [actual_name(df.columns, d) or d for d in dims]
    used = [c for c in df.columns if c in _fields(dims, measures)]
    df = df.select(*[field(c) for c in used])
    schema = df.schema
    apart = [m for m in measures if m.function == MEDIAN]
    if median == "builtin":
        apart = []
    together = [m for m in measures if m not in apart]
    columns = [m.column(schema) for m in together] or [F.count(F.lit(1)).alias("_rows")]
    shared = _only_filter(together)
    if not dims and not apart and shared:
        # one filter for the whole row of cards: let it reach the scan
        return df.where(shared.condition(schema)).agg(*[m.unfiltered().column(schema) for m in together])
    result = df.groupBy(*[field(d) for d in dims]).agg(*columns) if dims else df.agg(*columns)
    if apart:
        middles = _medians(df, dims, apart)
        if dims:
            result = join_on_keys(result, middles, dims)
        else:
            result = result.select("*", *[middles.select(field(m.name)).scalar().alias(m.name) for m in apart])
    return result.select(*[field(d) for d in dims], *[field(m.name) for m in measures])


def _fields(dims: list[str], measures: list[Measure]) -> set[str]:
    names = set(dims)
    for m in measures:
        names.update(x for x in (m.field, m.filter_field) if x)
        if m.top:
            names |= _fields([], [m.top, m.bottom])
    return names


def _only_filter(measures: list[Measure]) -> Measure | None:
    filters = {(m.filter_field, m.filter_values) for m in measures}
    return measures[0] if len(filters) == 1 and measures[0].is_filtered else None


def _medians(df: DataFrame, dims: list[str], measures: list[Measure]) -> DataFrame:
    """``dims`` and one column per median, all from the same two passes."""
    cells = F.array(*[F.struct(F.lit(i).alias("_task"), measured(m, df.schema).alias("_x")) for i, m in enumerate(measures)])
    medians = exact_medians(df.select(*[field(d) for d in dims], F.inline(cells)), [*dims, "_task"])
    columns = [F.max(F.when(F.col("_task") == i, F.col("median"))).alias(m.name) for i, m in enumerate(measures)]
    return medians.groupBy(*[field(d) for d in dims]).agg(*columns) if dims else medians.agg(*columns)


def measured(m: Measure, schema) -> Column:
    """What a median is taken of: its field as a number, null where its filter does not hold."""
    x = field(m.field).cast("double")
    return F.when(m.condition(schema), x) if m.is_filtered else x


def exact_median(df: DataFrame, dims: list[str], value: str, name: str = "median") -> DataFrame:
    """The exact median per group, however large a group is; groups without numbers have null."""
    rows = df.select(*[field(d) for d in dims], field(value).cast("double").alias("_x"))
    return exact_medians(rows, dims).withColumnRenamed("median", name)
