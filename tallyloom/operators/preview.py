"""Previews: the first rows of a table, and rows made up from column names alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions.columns import field, text_array
from tallyloom.functions.names import name_type

PREVIEW_ROWS = 100


def preview(df: DataFrame, *order_by: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the order of the given columns: each task keeps that many, one task merges."""
    return df.orderBy(*[field(c) for c in order_by]).limit(rows)


def synthetic_preview(columns: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """``columns`` (with ``column``) × row number: made-up values by column name, marked as such.

    The rows demonstrate a layout; they are never a stand-in for data, and the check for
    fabricated content finds them.
    """
    numbered = columns.select("*", F.explode(F.sequence(F.lit(1), F.lit(rows))).alias("row"))
    made_up = synthetic_value(F.col("column"), F.col("row"))
    return numbered.select("*", made_up.alias("value"), F.lit(True).alias("synthetic"))


def synthetic_value(name: Column, i: Column) -> Column:
    """The made-up text of row ``i``, counted from 1, for a column of that name."""
    lowered = F.lower(name)

    def like(*words: str) -> Column:
        return lowered.rlike("|".join(words))

    def cycle(words: tuple[str, ...]) -> Column:
        return F.element_at(text_array(words), (i % len(words) + 1).cast("int"))

    number = i.cast("string")
    return (
        F.when(
            name_type(name) == "double",
            F.when(like("rating", "score"), ((F.lit(30) + i % 20) / 10).cast("decimal(3,1)").cast("string")).otherwise(
                ((i * 125 + 450) % 8500 + 150).cast("string")
            ),
        )
        .when(like("category", "type", "genre"), cycle(fixed.PREVIEW_CATEGORIES))
        .when(like("city", "location", "state", "region", "country"), cycle(fixed.PREVIEW_CITIES))
        .when(like("status"), cycle(fixed.PREVIEW_STATUSES))
        .when(
            like("merchant", "company", "customer", "name"),
            F.concat(cycle(fixed.PREVIEW_MERCHANTS), F.lit(" "), number),
        )
        .when(like("id", "code", "key"), F.concat(name, F.lit("_"), (i + 1000).cast("string")))
        .otherwise(F.concat(name, F.lit("_"), number))
    )
