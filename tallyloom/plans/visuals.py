"""Single visuals: slicer, card, table, category chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions import measures as M
from tallyloom.functions.columns import field, text_map
from tallyloom.functions.measures import Measure
from tallyloom.plans.aggregate import aggregate, join_on_keys


def resolve_field(columns: list[str], raw: str | None, strict: bool = False) -> str:
    """The column a chart means: brackets dropped, case ignored, else the first column.

    ``strict`` raises instead of falling back.
    """
    wanted = (raw or "").strip().strip("[]")
    for exact in (True, False):
        for column in columns:
            if column == wanted or (not exact and column.lower() == wanted.lower()):
                return column
    if strict or not columns:
        raise KeyError(f"no column {raw!r}")
    return columns[0]


def visual_type(chart_type: Column) -> Column:
    """The visual that a chart type becomes."""
    known = F.try_element_at(text_map(fixed.VISUAL_TYPES), F.lower(chart_type))
    return F.coalesce(known, F.lit(fixed.DEFAULT_VISUAL_TYPE))


def folded(df: DataFrame, dim: str) -> DataFrame:
    """``dim`` compared without regard to case from here on."""
    return df.withColumn(dim, F.collate(field(dim), "UTF8_LCASE"))


def slicer(df: DataFrame, column: str) -> DataFrame:
    """The values of one column."""
    return df.select(field(column)).distinct()


def card(df: DataFrame, measure: Measure | None = None) -> DataFrame:
    """One measure over all rows; the row count when none is named."""
    return aggregate(df, [], [measure or M.row_count()])


def category(
    df: DataFrame,
    dim: str,
    measure: Measure | None = None,
    *,
    hide_blank: bool = False,
    ignore_case: bool = False,
    order_by: list[Column] | None = None,
) -> DataFrame:
    """One measure per value of one dimension; row count when no measure is named.

    A measure filtered on the dimension itself ignores the value it stands beside: every
    value shows the filtered total.
    """
    measure = (measure or M.row_count()).bound(df.columns)
    dim = M.actual_name(df.columns, dim) or dim
    df = folded(df, dim) if ignore_case else df
    if measure.filter_field == dim:
        result = filter_override(df, [dim], measure)
    elif ignore_case:
        # of the spellings of one value the least is shown, whatever order rows come in
        plain = df.withColumn("_label", field(dim).cast("string collate UTF8_BINARY"))
        rows = aggregate(plain, [dim], [measure, M.minimum("_label").named("_label")])
        result = rows.select(field("_label").alias(dim), field(measure.name))
    else:
        result = aggregate(df, [dim], [measure])
    if hide_blank:
        result = result.where(field(measure.name).isNotNull())
    return result.orderBy(*order_by) if order_by else result


def filter_override(df: DataFrame, dims: list[str], measure: Measure) -> DataFrame:
    """A filtered measure grouped by its own filter field: the filter replaces the group's value."""
    others = [d for d in dims if d != measure.filter_field]
    groups = df.select(*[field(d) for d in dims]).distinct()
    kept = aggregate(df.where(measure.condition(df.schema)), others, [measure.unfiltered()])
    if others:
        return join_on_keys(groups, kept, others)
    return groups.select("*", kept.scalar().alias(measure.name))


def table(df: DataFrame, dim: str | None = None, measure: Measure | None = None) -> DataFrame:
    """The first dimension and/or the first measure; with neither, the first column's values."""
    if dim and measure:
        return category(df, dim, measure)
    if measure:
        return card(df, measure)
    return slicer(df, dim or df.columns[0])


def unrelated(dim_df: DataFrame, dim: str, measure_df: DataFrame, measure: Measure) -> DataFrame:
    """A dimension beside a measure of a table it has no relationship with: the same total everywhere."""
    value = aggregate(measure_df, [], [measure]).scalar()
    return slicer(dim_df, dim).select("*", value.alias(measure.name))
