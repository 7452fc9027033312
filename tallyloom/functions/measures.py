"""Measures: named aggregates that a visual evaluates for a whole table or per dimension."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions.columns import field as by_name

ROWS, COUNT, DISTINCT, MEDIAN, BLANK, RATIO = "rows", "count", "count_distinct", "median", "blank", "ratio"


def actual_name(columns: list[str], wanted: str) -> str | None:
    """The column of that name: exact first, then without regard to case."""
    if wanted in columns:
        return wanted
    return next((c for c in columns if c.lower() == wanted.lower()), None)


def _label(name: str) -> str:
    return name if any(ch.isupper() for ch in name) else name.title()


@dataclass(frozen=True)
class Measure:
    """One aggregate. Build it with the functions below rather than directly."""

    function: str
    field: str | None = None
    name: str = ""
    filter_field: str | None = None
    filter_values: tuple = ()
    top: "Measure | None" = None
    bottom: "Measure | None" = None
    count_blank: bool = False
    strict: bool = False
    text: str = ""

    def named(self, name: str) -> "Measure":
        return replace(self, name=name)

    @property
    def is_filtered(self) -> bool:
        return self.filter_field is not None

    @property
    def is_single_pass(self) -> bool:
        """Keeps a state of fixed size per group, so any number of them share one scan."""
        if self.function == RATIO:
            return self.top.is_single_pass and self.bottom.is_single_pass
        return self.function not in (DISTINCT, MEDIAN)

    def bound(self, columns: list[str]) -> "Measure":
        """The measure with its fields named as in ``columns``; blank if one of them is not there."""
        if self.function == RATIO:
            top, bottom = self.top.bound(columns), self.bottom.bound(columns)
            if BLANK in (top.function, bottom.function):
                return Measure(BLANK, name=self.name, text=f"{top.text} / {bottom.text}")
            return replace(self, top=top, bottom=bottom)
        found = {n: actual_name(columns, f) for n in ("field", "filter_field") if (f := getattr(self, n)) is not None}
        if None in found.values():
            return Measure(BLANK, name=self.name, text=self.text or f"{self.function}({self.field})")
        return replace(self, **found)

    def unfiltered(self) -> "Measure":
        return replace(self, filter_field=None, filter_values=())

    def condition(self, schema: T.StructType) -> Column:
        """The filter; its values are read as the type of the filtered field."""
        kind = schema[self.filter_field].dataType
        values = [F.lit(v).try_cast(kind) for v in self.filter_values]
        column = by_name(self.filter_field)
        if not values:
            return F.lit(False)
        return column == values[0] if len(values) == 1 else column.isin(*values)

    def value(self, schema: T.StructType) -> Column:
        """The aggregate expression, without a name."""
        if self.function == RATIO:
            top, bottom = self.top.value(schema), self.bottom.value(schema)
            return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(0.0)).otherwise(top / bottom)
        if self.function == BLANK:
            return F.lit(None).cast("double")
        x = F.lit(1) if self.function == ROWS else by_name(self.field)
        if self.is_filtered:
            x = F.when(self.condition(schema), x)
        if self.function == DISTINCT:
            counted = F.count_distinct(x)
            if self.count_blank:
                blank = by_name(self.field).isNull()
                blank = blank & self.condition(schema) if self.is_filtered else blank
                counted = counted + F.coalesce(F.max(blank.cast("bigint")), F.lit(0).cast("bigint"))
            return counted
        if self.function == "only" and self.strict:
            return F.when(F.min(x) == F.max(x), F.min(x))
        build = {
            ROWS: F.count,
            COUNT: F.count,
            "sum": F.sum,
            "avg": F.avg,
            "min": F.min,
            "max": F.max,
            MEDIAN: F.median,
            "stdev": F.stddev_pop,
            "only": F.min,
        }
        return build[self.function](x)

    def column(self, schema: T.StructType) -> Column:
        return self.value(schema).alias(self.name)


def row_count(table: str = "") -> Measure:
    """All rows, whatever they hold."""
    return Measure(ROWS, name=f"Total {table} Rows" if table else "Total Count")


def count(field: str) -> Measure:
    """Rows whose field is not null; empty text counts."""
    return Measure(COUNT, field, f"{_label(field)} Count")


def count_distinct(field: str, count_blank: bool = False) -> Measure:
    """Distinct values; ``count_blank`` counts null as one more value."""
    return Measure(DISTINCT, field, f"Unique {_label(field)}", count_blank=count_blank)


def _simple(function: str, field: str, **options) -> Measure:
    return Measure(function, field, f"{_label(field)} {fixed.MEASURE_SUFFIXES[function]}", **options)


def total(field: str) -> Measure:
    return _simple("sum", field)


def average(field: str) -> Measure:
    return _simple("avg", field)


def minimum(field: str) -> Measure:
    return _simple("min", field)


def maximum(field: str) -> Measure:
    return _simple("max", field)


def median(field: str) -> Measure:
    """The exact median, interpolated between the two middle values."""
    return _simple(MEDIAN, field)


def stdev(field: str) -> Measure:
    """The population standard deviation."""
    return _simple("stdev", field)


def only(field: str, strict: bool = False) -> Measure:
    """The smallest value; ``strict`` gives null unless all values are the same."""
    return _simple("only", field, strict=strict)


def ratio(top: Measure, bottom: Measure) -> Measure:
    """``top / bottom``; 0 where the denominator is 0 or null."""
    for part in (top, bottom):
        if part.function not in fixed.RATIO_FUNCTIONS:
            raise ValueError(f"a ratio takes {fixed.RATIO_FUNCTIONS}, not {part.function}")
    return Measure(RATIO, name=f"{_label(top.field)} per {_label(bottom.field)}", top=top, bottom=bottom)


def filtered(measure: Measure, field: str, *values) -> Measure:
    """The measure over the rows whose ``field`` is one of ``values``; no values, no rows."""
    if measure.function not in fixed.FILTERED_FUNCTIONS:
        raise ValueError(f"a filtered measure takes {fixed.FILTERED_FUNCTIONS}, not {measure.function}")
    shown = values[0] if len(values) == 1 else "Filtered"
    return replace(measure, name=f"{measure.name} ({shown})", filter_field=field, filter_values=values)


def unresolved(text: str) -> Measure:
    """An expression nobody could read: always blank, never a guess."""
    words = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text).split())
    return Measure(BLANK, name=f"[Needs Review] {words[:40] or 'Expression'}", text=text)


def automatic(schema: T.StructType, table: str, measurable: list[str]) -> list[Measure]:
    """A row count, and a total for every measurable column."""
    totals = [total(c).named(f"Total {c}") for c in schema.names if c in measurable]
    return [row_count(table), *totals]


def from_class(row) -> Measure:
    """A measure from one classified expression, a row of ``operators.expressions.classify``."""
    kind, function, values = row["class"], row["function"], list(row["values"] or ())
    build = {"sum": total, "avg": average, "min": minimum, "max": maximum, "median": median,
             "stdev": stdev, "only": only, "count": count}
    if kind == "rows":
        return row_count()
    if kind == "count":
        return count(row["field"])
    if kind == "count_distinct":
        return count_distinct(row["field"])
    if kind == "simple":
        return build[function](row["field"])
    if kind == "ratio":
        return ratio(build[function](row["field"]), build[row["function2"]](row["field2"]))
    if kind in ("filtered_eq", "filtered_in"):
        return filtered(build[function](row["field"]), row["filter_field"], *values)
    return unresolved(row["expression"])
