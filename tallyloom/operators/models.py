"""What an app's model holds beside its loads: its measures, and a table where no load can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.names import safe_table_name
from tallyloom.functions.types import is_measurable
from tallyloom.operators.expressions import classify, measure_targets


def model_measures(columns: DataFrame, expressions: DataFrame) -> DataFrame:
    """(app, table, pos, measure, expression): the measures of every table, the first of a name counts.

    A row count, a total for every measurable column, then the chart expressions that name a field of the
    table. ``columns`` has (app, table, pos, column, type), ``expressions`` (app, pos, expression).
    """
    rows = columns.select("app", "table").distinct().select(
        "app", "table", F.lit(0).alias("stage"), F.lit(0).alias("at"),
        F.concat(F.lit("Total "), "table", F.lit(" Rows")).alias("measure"), F.lit("Count(*)").alias("expression"),
    )
    totals = columns.where(is_measurable(F.col("type"), F.col("column"))).select(
        "app", "table", F.lit(1).alias("stage"), F.col("pos").alias("at"),
        F.concat(F.lit("Total "), "column").alias("measure"), F.concat(F.lit("Sum(["), "column", F.lit("])")).alias("expression"),
    )
    asked = expressions.where("expression <> ''").groupBy("app", "expression").agg(F.min("pos").alias("at"))
    owned = columns.select("app", "table", F.col("column").alias("field"))
    named = classify(asked).select("app", "expression", "at", "measure")
    # place and name go along with the expression, so the targets need not meet it again
    charts = measure_targets(named, owned, keep=("at", "measure")).select(
        "app", "table", F.lit(2).alias("stage"), "at", "measure", "expression"
    )
    first = (
        rows.unionByName(totals).unionByName(charts).groupBy("app", "table", "measure")
        .agg(F.min(F.struct("stage", "at", "expression")).alias("m"))
    )
    # the measures of one table are one array in one row
    placed = first.groupBy("app", "table").agg(
        F.array_sort(F.collect_list(F.struct("m.stage", "m.at", "measure", "m.expression"))).alias("measures")
    )
    return placed.select("app", "table", F.posexplode("measures").alias("pos", "m")).select(
        "app", "table", "pos", "m.measure", "m.expression"
    )


def fallback_tables(tables: DataFrame, fields: DataFrame, model: DataFrame, default: str = "Table") -> DataFrame:
    """(app, table, pos, field, kind) for apps without a table of their own: all fields of the data model.

    The table is named like the model's first. ``tables`` has (app), ``fields`` (app, pos, field), ``model``
    (app, pos, table). Nothing can be read from it, so its kind is ``unknown``.
    """
    lost = fields.join(tables.select("app").distinct(), "app", "left_anti")
    names = model.groupBy("app").agg(F.min_by("table", "pos").alias("table"))
    return lost.join(names, "app", "left").select(
        "app", F.coalesce("table", safe_table_name(F.lit(default))).alias("table"), "pos", "field", F.lit("unknown").alias("kind")
    )
