"""All visuals of a sheet in one pass over the data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions import measures as M
from tallyloom.functions.columns import field
from tallyloom.functions.measures import Measure
from tallyloom.plans.aggregate import aggregate, measured
from tallyloom.plans.medians import exact_medians
from tallyloom.plans.visuals import filter_override, resolve_field, unrelated

OUTPUT = ("visual", "category", "value", "text")
#: Dimensions that one grouping-set query takes; their grouping id then never runs out of bits.
DIMS_TOGETHER = 24
ZERO_WHEN_EMPTY = (M.ROWS, M.COUNT, M.RATIO)
#: Measures that are a value of their field, which equal rows do not change, and the types whose values have one size.
ONE_VALUE = ("min", "max", "only")
FIXED_SIZE = (T.NumericType, T.BooleanType, T.DatetimeType, T.AnyTimeType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType)


@dataclass(frozen=True)
class Visual:
    """A visual of a sheet: a card has no dimension, a slicer no measure."""

    name: str
    dim: str | None = None
    measure: Measure | None = None


def sheet(df: DataFrame, visuals: list[Visual]) -> DataFrame:
    """Rows (visual, category as text, value as double, text) of every visual.

    A measure that is no number, such as the first date, stands in ``text`` and has no ``value``. Names
    count without regard to case; a visual of a column that is not there is one blank row.

    The data is scanned once for all measures of fixed state, whatever the number of
    dimensions, by grouping sets. All medians share the two passes of ``exact_medians``, which are run at once. Distinct
    counts keep state that grows, so they get a grouped query per dimension, as does each filter on a visual's own dimension.
    A first or last text has no fixed size, and one such measure would have the shared pass sort every row: it is taken of
    the different texts of its dimension.
    """
    visuals = [_bound(_complete(v), df.columns) for v in visuals]
    texts = [v for v in visuals if _is_text(v.measure, df.schema) and not _overrides(v)]
    shared = [v for v in visuals if v.measure.is_single_pass and not _overrides(v) and v not in texts]
    dims = list(dict.fromkeys(v.dim for v in shared))
    groups = [dims[i : i + DIMS_TOGETHER] for i in range(0, len(dims), DIMS_TOGETHER)]
    parts = [_shared(df, [v for v in shared if v.dim in group]) for group in groups]
    middles = [v for v in visuals if v.measure.function == M.MEDIAN and not _overrides(v)]
    if middles:
        parts.append(_medians(df, middles))
    by_dim: dict[tuple[str | None, bool], list[Visual]] = {}
    for v in visuals:
        if _overrides(v):
            parts.append(_long(filter_override(df, [v.dim], v.measure), [v], [v.measure.name]))
        elif v in texts and v.dim:
            parts.append(_texts(df, v))
        elif v not in shared and v not in middles:
            by_dim.setdefault((v.dim, v in texts), []).append(v)
    for (dim, _), together in by_dim.items():
        slots = [f"_m{i}" for i in range(len(together))]
        measures = [v.measure.named(slot) for v, slot in zip(together, slots)]
        parts.append(_long(aggregate(df, [dim] if dim else [], measures), together, slots))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _medians(df: DataFrame, visuals: list[Visual]) -> DataFrame:
    """The rows of all median visuals: each data row once for every visual, under the visual's own dimension."""
    dims = list(dict.fromkeys(v.dim for v in visuals if v.dim))
    slots = [f"_d{i}" for i in range(len(dims))]
    own = lambda v, d: field(d) if d == v.dim else F.lit(None).cast(df.schema[d].dataType)
    cells = [
        F.struct(F.lit(i).alias("_task"), *(own(v, d).alias(s) for d, s in zip(dims, slots)), measured(v.measure, df.schema).alias("_x"))
        for i, v in enumerate(visuals)
    ]
    medians = exact_medians(df.select(F.inline(F.array(*cells))), ["_task", *slots])
    shown = [F.when(F.col("_task") == i, F.col(slots[dims.index(v.dim)]).cast("string")) for i, v in enumerate(visuals) if v.dim]
    tasks = df.sparkSession.createDataFrame([(i, v.name, v.dim is None) for i, v in enumerate(visuals)], "_task int, visual string, card boolean")
    # a card has its row even where the table has none
    rows = tasks.join(medians.withColumn("_found", F.lit(1)), "_task", "left").where("card OR _found IS NOT NULL")
    category = F.coalesce(*shown) if shown else F.lit(None).cast("string")
    return rows.select("visual", category.alias("category"), F.col("median").alias("value"), F.lit(None).cast("string").alias("text"))


def _is_text(m: Measure, schema: T.StructType) -> bool:
    return m.function in ONE_VALUE and not isinstance(schema[m.field].dataType, FIXED_SIZE)


def _texts(df: DataFrame, v: Visual) -> DataFrame:
    """The rows of a visual whose measure is one text per dimension: equal texts meet by hashing, few are left to sort."""
    x = field(v.measure.field)
    held = F.when(v.measure.condition(df.schema), x) if v.measure.is_filtered else x
    different = df.select(field(v.dim), held.alias("_text")).distinct()
    measure = replace(v.measure.unfiltered(), field="_text").named("_m")
    return _long(aggregate(different, [v.dim], [measure]), [v], ["_m"])


def _overrides(v: Visual) -> bool:
    """The measure is filtered on the very dimension it stands beside."""
    return v.dim is not None and v.measure.filter_field == v.dim


def _bound(v: Visual, columns: list[str]) -> Visual:
    dim = M.actual_name(columns, v.dim) if v.dim else None
    if v.dim and not dim:
        return Visual(v.name, None, Measure(M.BLANK, name=v.measure.name, text=f"no column {v.dim}"))
    return Visual(v.name, dim, v.measure.bound(columns))


def sheet_of_tables(tables: dict[str, DataFrame], visuals: list[Visual]) -> DataFrame:
    """The rows of ``sheet`` for visuals whose fields may stand in different tables.

    A dimension and a measure belong to the first table that has them, the measure to the dimension's table
    if that has it too. A measure of another table, unrelated to the dimension, shows its total beside every value.
    """
    own: dict[str, list[Visual]] = {}
    parts = []
    for v in map(_complete, visuals):
        owners = [n for n, df in tables.items() if not v.dim or M.actual_name(df.columns, v.dim)]
        home = owners[0] if owners else next(iter(tables))
        able = [n for n, df in tables.items() if v.measure.bound(df.columns).function == v.measure.function]
        if home in able or not able:
            own.setdefault(home, []).append(v)
        elif not v.dim:
            own.setdefault(able[0], []).append(v)
        else:
            dim = M.actual_name(tables[home].columns, v.dim)
            rows = unrelated(tables[home], dim, tables[able[0]], v.measure.bound(tables[able[0]].columns).named("_m"))
            parts.append(_long(rows, [Visual(v.name, dim, v.measure)], ["_m"]))
    parts = [sheet(tables[name], group) for name, group in own.items()] + parts
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _shown(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A measure as number and as text, one of them null."""
    if isinstance(kind, (T.NumericType, T.NullType)):
        return value.cast("double"), F.lit(None).cast("string")
    return F.lit(None).cast("double"), value.cast("string")


def _complete(v: Visual) -> Visual:
    return v if v.measure else Visual(v.name, v.dim, M.row_count())


def _long(rows: DataFrame, visuals: list[Visual], columns: list[str]) -> DataFrame:
    """One output row per visual for every row of a grouped result that holds them side by side."""
    cells = [
        F.struct(
            F.lit(v.name).alias("visual"), _label(v).alias("category"),
            *(x.alias(n) for x, n in zip(_shown(field(c), rows.schema[c].dataType), OUTPUT[2:])),
        )
        for v, c in zip(visuals, columns)
    ]
    return rows.select(F.inline(F.array(*cells)))


def _label(v: Visual) -> Column:
    return field(v.dim).cast("string") if v.dim else F.lit(None).cast("string")


def _shared(df: DataFrame, visuals: list[Visual]) -> DataFrame:
    dims = list(dict.fromkeys(v.dim for v in visuals if v.dim))
    slots: dict[Measure, str] = {}
    for v in visuals:
        slots.setdefault(v.measure, f"_m{len(slots)}")
    values = df.agg(*[m.value(df.schema).alias(slot) for m, slot in slots.items()]).schema
    columns = []
    for m, slot in slots.items():
        number, text = _shown(m.value(df.schema), values[slot].dataType)
        columns += [number.alias(slot), text.alias(f"{slot}_text")]
    cards = [v for v in visuals if not v.dim]
    if not dims:
        grouped = df.agg(*columns).withColumn("_set", F.lit(0))
        by_set = {None: 0}
    else:
        names = [field(d) for d in dims]
        sets = [[field(d)] for d in dims] + ([[]] if cards else [])
        grouped = df.groupingSets(sets, *names).agg(F.grouping_id(*names).alias("_set"), *columns)
        # the id has one bit per dimension, set where the dimension is rolled up
        every = (1 << len(dims)) - 1
        by_set = {d: every - (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
        by_set[None] = every
    cells = F.array(
        *[
            F.struct(
                F.lit(by_set[v.dim]).cast("bigint").alias("set"),
                F.lit(v.name).alias("visual"),
                _label(v).alias("category"),
                F.col(slots[v.measure]).alias("value"),
                F.col(f"{slots[v.measure]}_text").alias("text"),
            )
            for v in visuals
        ]
    )
    mine = F.filter(cells, lambda c: c["set"] == F.col("_set"))
    rows = grouped.select(F.inline(mine)).select(*OUTPUT)
    if not cards or not dims:
        return rows
    # an empty table has no grand-total group, but a card always shows its one row
    blank = F.array(
        *[
            F.struct(
                F.lit(v.name).alias("visual"),
                F.lit(None).cast("string").alias("category"),
                F.lit(0.0 if v.measure.function in ZERO_WHEN_EMPTY else None).cast("double").alias("value"),
                F.lit(None).cast("string").alias("text"),
            )
            for v in cards
        ]
    )
    wanted = df.sparkSession.range(0, 1, 1, 1).select(F.inline(blank)).withColumn("_found", F.lit(0))
    return (
        rows.withColumn("_found", F.lit(1))
        .unionByName(wanted)
        .groupBy("visual", "category")
        .agg(F.max_by(F.struct("value", "text"), "_found").alias("best"))
        .select("visual", "category", "best.value", "best.text")
    )


def of_charts(charts, dimensions, measures, columns: list[str]) -> list[Visual]:
    """The visuals of one sheet from its catalogue rows, in order.

    ``charts`` has (chart, type), ``dimensions`` (chart, pos, field), ``measures`` the classified
    expressions with (chart, pos). A chart shows its first dimension and first measure; what it
    lacks is the first column and the row count.
    """
    visuals = []
    for number, chart in enumerate(charts, 1):
        dims = sorted((d["pos"], d["field"]) for d in dimensions if d["chart"] == chart["chart"])
        own = sorted((m for m in measures if m["chart"] == chart["chart"]), key=lambda m: m["pos"])
        kind = fixed.VISUAL_TYPES.get(chart["type"].lower(), fixed.DEFAULT_VISUAL_TYPE)
        measure = M.from_class(own[0]) if own else None
        named = dims[0][1] if dims else ""
        has_dim = kind != "card" and (named or kind != "tableEx" or not measure)
        dim = resolve_field(columns, named) if has_dim else None
        visuals.append(Visual(chart["chart"] or f"Visual {number}", dim, None if kind == "slicer" else measure))
    return visuals


def kpi_page(columns: list[str], measures: list[Measure]) -> list[Visual]:
    """The first page of the built-in template: three cards and two charts."""
    c1, c2, _ = _three(columns)
    m1, m2, m3 = _three(measures)
    return [
        Visual("Card_1", None, m1),
        Visual("Card_2", None, m2),
        Visual("Card_3", None, m3),
        Visual("ColChart_1", c1, m1),
        Visual("LineChart_1", c2, m2),
    ]


def category_page(columns: list[str], measures: list[Measure]) -> list[Visual]:
    """The second page: a share, a comparison and a trend."""
    c1, c2, c3 = _three(columns)
    m1, m2, m3 = _three(measures)
    return [Visual("Donut_1", c1, m1), Visual("Bar_1", c2, m3), Visual("Area_1", c3, m2)]


def extra_page(columns: list[str], measures: list[Measure]) -> list[Visual]:
    """Every page after the second."""
    _, c2, c3 = _three(columns)
    m1, _, m3 = _three(measures)
    return [Visual("Card_A1", None, m1), Visual("Col_A1", c2, m1), Visual("Line_A1", c3, m3)]


def _three(items: list):
    """The first three, the first one standing in for those that are missing."""
    return tuple(items[i] if i < len(items) else items[0] for i in range(3))
