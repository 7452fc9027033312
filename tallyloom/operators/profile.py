"""Profiles of fields and tables, measured from the data in one pass; app assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed
from tallyloom.functions.columns import field
from tallyloom.functions.names import looks_personal
from tallyloom.functions.types import number_or_null

_WIDTHS = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}
_SLOTS = {"l": "bigint", "d": "double", "s": "string"}


def _slot(column: T.StructField) -> str:
    if isinstance(column.dataType, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "l"
    return "d" if isinstance(column.dataType, T.FractionalType) and not isinstance(column.dataType, T.DecimalType) else "s"


def _as_slot(column: T.StructField) -> Column:
    value, kind = field(column.name), column.dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        # by the clock's parts: a detour over a time zone would merge hours where clocks change
        minutes = F.unix_date(value.cast("date")).cast("bigint") * 1440 + F.hour(value) * 60 + F.minute(value)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast(_SLOTS[_slot(column)])


def _given_tags(kind: T.DataType) -> list[str]:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return ["$timestamp"]
    if isinstance(kind, T.DateType):
        return ["$date"]
    if isinstance(kind, T.NumericType):
        return ["$numeric"]
    return []


def profile_fields(df: DataFrame, table: str) -> DataFrame:
    """(table, field, cardinality, total_count, is_numeric, tags, byte_size), one row per column.

    Columns become rows of the column's number and the 128 bits that two hashes give of a value, long or short, so no value is
    shuffled, and equal values shrink to one row before they are counted. That costs one scan and one shuffle for any
    number of columns, and a value that fills most of a column is combined before the shuffle.
    """
    cells = []
    for i, c in enumerate(df.schema):
        value = _one_zero(c)
        key = [F.when(value.isNotNull(), F.xxhash64(value)).alias("a"), F.xxhash64(F.lit(1), value).alias("b")]
        cells.append(F.struct(F.lit(i).alias("i"), *key, *(f.alias(n) for f, n in zip(_facts(c), _FACTS))))
    flags = [F.bool_and(f).alias(f) for f in _FACTS[1:]]
    distinct = df.select(F.inline(F.array(*cells))).where("a IS NOT NULL").groupBy("i", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *flags
    )
    sums = distinct.groupBy("i").agg(
        F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("total_count"), F.sum("bytes").alias("text_bytes"), *flags
    )
    named = _columns_table(df)
    numeric_text = (F.col("slot") == "s") & F.coalesce("reads_as_number", F.lit(False))
    is_numeric = F.array_contains("given", fixed.NUMERIC_TAG) | numeric_text
    extra = F.array(
        F.when(numeric_text, fixed.NUMERIC_TAG),
        F.when(is_numeric & F.coalesce("integral", F.lit(False)), fixed.INTEGER_TAG),
        F.when((F.col("slot") == "s") & ~numeric_text, "$text"),
        F.when((F.col("slot") == "s") & ~numeric_text & F.coalesce("ascii", F.lit(False)), "$ascii"),
    )
    total = F.coalesce("total_count", F.lit(0))
    return named.join(sums, "i", "left").select(
        F.lit(table).alias("table"), "field",
        F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        total.alias("total_count"),
        is_numeric.alias("is_numeric"),
        F.array_compact(F.concat("given", extra)).alias("tags"),
        F.when(F.col("width") > 0, total * F.col("width")).otherwise(F.coalesce("text_bytes", F.lit(0))).alias("byte_size"),
    )


def _one_zero(column: T.StructField) -> Column:
    """The value in its slot; zero has no sign."""
    value = _as_slot(column)
    return value + F.lit(0.0) if _slot(column) == "d" else value


_FACTS = ("bytes", "reads_as_number", "integral", "ascii")


def _facts(column: T.StructField) -> list[Column]:
    """Of a value: bytes of text, whether it reads as a number, is a whole number, and is plain letters."""
    value, yes = _as_slot(column), F.lit(True)
    whole = lambda n: F.coalesce(n == F.floor(n), F.lit(False))
    if _slot(column) != "s":
        return [F.lit(0).cast("bigint"), yes, whole(value) if _slot(column) == "d" else yes, yes]
    number, size = number_or_null(value), F.octet_length(value)
    return [F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")), number.isNotNull(), whole(number), F.coalesce(size == F.length(value), yes)]


def _columns_table(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: metadata only, as wide as the schema."""
    rows = [
        F.struct(
            F.lit(i).alias("i"), F.lit(c.name).alias("field"), F.lit(_slot(c)).alias("slot"),
            F.lit(_WIDTHS.get(type(c.dataType), 0)).alias("width"),
            F.array(*[F.lit(t) for t in _given_tags(c.dataType)]).cast("array<string>").alias("given"),
        )
        for i, c in enumerate(df.schema)
    ]
    return df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, fields, key_fields, byte_size); a key field is one that several tables have."""
    owners: dict[str, int] = {}
    for df in tables.values():
        for name in {c.lower() for c in df.columns}:
            owners[name] = owners.get(name, 0) + 1
    result = None
    for table, df in tables.items():
        sizes = [
            F.count(field(c.name)) * _WIDTHS[type(c.dataType)]
            if type(c.dataType) in _WIDTHS
            else F.coalesce(F.sum(F.octet_length(_as_slot(c))), F.lit(0))
            for c in df.schema
        ]
        size = sizes[0]
        for more in sizes[1:]:
            size = size + more
        keys = sum(owners[c.lower()] > 1 for c in df.columns)
        row = df.agg(F.count(F.lit(1)).alias("rows"), size.cast("bigint").alias("byte_size")).select(
            F.lit(table).alias("table"), "rows", F.lit(len(df.columns)).alias("fields"),
            F.lit(keys).alias("key_fields"), "byte_size",
        )
        result = row if result is None else result.unionByName(row)
    return result


def pii_fields(fields: DataFrame) -> DataFrame:
    """(app, table, field): fields whose name hints at personal data."""
    return fields.where(looks_personal(F.col("field"))).select("app", "table", "field")


def measurable_without_keys(profile: DataFrame, measurable: Column) -> DataFrame:
    """The measurable fields of a profile whose values are not all different."""
    return profile.where(measurable & (F.col("cardinality") < F.col("total_count")))


def app_volumetrics(sheets: DataFrame, charts: DataFrame) -> DataFrame:
    """(app, pages, visuals, kpis): at least one page, otherwise what is there.

    Both are counted in one aggregate, so there is one shuffle, of partial counts.
    """
    is_kpi = F.lower("type").isin(*fixed.KPI_TYPES)
    counted = sheets.select("app", F.lit(1).alias("page"), F.lit(0).alias("visual"), F.lit(0).alias("kpi")).unionByName(
        charts.select("app", F.lit(0).alias("page"), F.lit(1).alias("visual"), is_kpi.cast("int").alias("kpi"))
    )
    return counted.groupBy("app").agg(
        F.greatest(F.sum("page"), F.lit(1)).alias("pages"), F.sum("visual").alias("visuals"), F.sum("kpi").alias("kpis")
    )
