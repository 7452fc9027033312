"""Types by evidence, and typed columns whose bad cells are null."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions.columns import strip_space, text_array

STRING, INT64, DOUBLE, DATETIME, BOOLEAN = "string", "int64", "double", "dateTime", "boolean"

# A cast that fails is many times slower than one that works, so text that plainly is no number
# never gets to the cast. Nor does text that a cast reads although it is none, such as ``10d``.
_NUMBER_START = r"^[\x00-\x20+\-.0-9inIN]"
_NUMBER = (
    r"(?i)^[\x00-\x20]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)[\x00-\x20]*$"
)
_DIGITS = r"^-?[0-9]{1,18}$"
_TRUTHS = ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0")

SPARK_TYPES: dict[str, T.DataType] = {
    STRING: T.StringType(),
    INT64: T.LongType(),
    DOUBLE: T.DoubleType(),
    DATETIME: T.TimestampNTZType(),
    BOOLEAN: T.BooleanType(),
}


def resolve_type(tags: Column, is_numeric: Column) -> Column:
    """The type name that a field's tags and numeric flag speak for; text without evidence."""
    tags = F.coalesce(F.transform(tags, lambda t: F.lower(t)), F.array().cast("array<string>"))
    numeric = F.array_contains(tags, fixed.NUMERIC_TAG)
    return (
        F.when(F.arrays_overlap(tags, text_array(fixed.DATE_TAGS)), DATETIME)
        .when(F.arrays_overlap(tags, text_array(fixed.TEXT_TAGS)) & ~numeric, STRING)
        .when(F.array_contains(tags, fixed.INTEGER_TAG), INT64)
        .when(numeric | F.coalesce(is_numeric, F.lit(False)), DOUBLE)
        .otherwise(STRING)
    )


def is_measurable(type_name: Column, name: Column) -> Column:
    """A number that is no key by its name."""
    return type_name.isin(INT64, DOUBLE) & ~name.rlike("(?i)" + fixed.KEY_LIKE_NAME)


def measurable_names(schema: T.StructType) -> list[str]:
    """The numeric columns of a table that are no keys by their names."""
    numbers = [c.name for c in schema if isinstance(c.dataType, T.NumericType)]
    return [n for n in numbers if not re.search(fixed.KEY_LIKE_NAME, n, re.IGNORECASE)]


def number_or_null(text: Column) -> Column:
    """The text as a number; the first letter alone rules out most texts, however long."""
    return F.when(_is_number(text), text.try_cast("double"))


def _is_number(text: Column) -> Column:
    return F.substring(text, 1, 1).rlike(_NUMBER_START) & text.rlike(_NUMBER)


def typed(
    value: Column,
    type_name: str,
    datetime_formats: Iterable[str] = (),
    serial_dates: bool = False,
) -> Column:
    """``value`` (text) as the type; a cell that does not fit is null, never an error.

    Text with a fraction becomes an integer by rounding half to even. ``serial_dates`` reads
    a plain number as the day count that workbooks store.
    """
    text = value.cast("string")
    if type_name == STRING:
        return text
    number = number_or_null(text)
    if type_name == DOUBLE:
        return number
    if type_name == INT64:
        # most integers are written as such; only what has a point, an exponent or blanks goes through decimals
        plain = text.rlike(_DIGITS)
        exact = F.when(~plain & _is_number(text), text.try_cast("decimal(38,18)"))
        return F.when(plain, text.try_cast("bigint")).otherwise(F.bround(exact, 0).try_cast("bigint"))
    if type_name == BOOLEAN:
        return F.when(F.lower(strip_space(text)).isin(*_TRUTHS), text.try_cast("boolean"))
    if type_name == DATETIME:
        readings = [text.try_cast("timestamp_ntz")]
        readings += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in datetime_formats]
        if serial_dates:
            days = number
            micros = F.round((days - F.lit(25569.0)) * F.lit(86_400_000_000.0)).try_cast("bigint")
            epoch = F.lit("1970-01-01").cast("timestamp_ntz")
            wall = epoch + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))
            readings = [F.when(days.isNotNull(), wall).otherwise(readings[0])] + readings[1:]
        return F.coalesce(*readings)
    raise ValueError(f"unknown type {type_name!r}")


class TypeBook:
    """Type evidence of one app by field name, for the loads planned on the driver."""

    def __init__(self, fields: Iterable[dict] = (), script_tags: dict[str, Iterable[str]] | None = None):
        self._evidence: dict[str, tuple[set[str], bool]] = {}
        for entry in fields:
            name = (entry.get("name") or "").strip().lower()
            if name:
                tags = {str(t).lower() for t in entry.get("tags") or ()}
                self._evidence[name] = (tags, bool(entry.get("is_numeric")))
        self.add_tags(script_tags or {})

    def copy(self) -> TypeBook:
        same = TypeBook()
        same._evidence = dict(self._evidence)
        return same

    def add_tags(self, tags_by_field: dict[str, Iterable[str]]) -> None:
        """Tags written in a script join those of the data model."""
        for name, tags in tags_by_field.items():
            known, numeric = self._evidence.get(name.lower(), (set(), False))
            self._evidence[name.lower()] = (known | {str(t).lower() for t in tags}, numeric)

    def type_of(self, name: str) -> str:
        tags, numeric = self._evidence.get((name or "").lower(), (set(), False))
        if tags.intersection(fixed.DATE_TAGS):
            return DATETIME
        if fixed.NUMERIC_TAG not in tags and tags.intersection(fixed.TEXT_TAGS):
            return STRING
        if fixed.INTEGER_TAG in tags:
            return INT64
        return DOUBLE if numeric or fixed.NUMERIC_TAG in tags else STRING
