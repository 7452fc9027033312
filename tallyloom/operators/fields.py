"""Fields across the tables of an app: owner, primary table, type by all the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions.columns import text_array
from tallyloom.functions.types import is_measurable, resolve_type


def field_owner(fields: DataFrame) -> DataFrame:
    """(app, field, table): the first table that has a field, in load order; case ignored.

    ``fields`` has (app, table, field, load_pos, pos). A partial aggregate rather than a
    window, so a field that most tables share is never gathered in one place.
    """
    return (
        fields.groupBy("app", F.lower("field").alias("field"))
        .agg(F.min_by("table", F.struct("load_pos", "pos")).alias("table"))
    )


def primary_table(fields: DataFrame) -> DataFrame:
    """(app, table, n_fields): the table with the most fields, the earlier one of equals."""
    sizes = fields.groupBy("app", "table").agg(F.count(F.lit(1)).alias("n_fields"), F.min("load_pos").alias("first"))
    best = F.max_by(F.struct("table", "n_fields"), F.struct("n_fields", -F.col("first")))
    return sizes.groupBy("app").agg(best.alias("best")).select("app", "best.table", "best.n_fields")


def resolve_types(metadata: DataFrame, script_fields: DataFrame | None = None) -> DataFrame:
    """(app, field, type, is_measurable) of every field, by metadata and script tags together.

    ``metadata`` has (app, field, tags, is_numeric); ``script_fields`` has (app, field, tags).
    Tags of one field come together as flags, a state of fixed size however often it is named.
    """
    evidence = metadata.select("app", "field", "tags", "is_numeric", F.lit(0).alias("rank"))
    if script_fields is not None:
        evidence = evidence.unionByName(
            script_fields.select("app", "field", "tags", F.lit(False).alias("is_numeric"), F.lit(1).alias("rank"))
        )
    known = (*fixed.DATE_TAGS, *fixed.TEXT_TAGS, fixed.INTEGER_TAG, fixed.NUMERIC_TAG)
    tags = F.transform("tags", lambda t: F.lower(t))
    met = evidence.groupBy("app", F.lower("field").alias("_key")).agg(
        F.min_by("field", F.struct("rank", "field")).alias("field"),
        F.bool_or("is_numeric").alias("is_numeric"),
        *[F.bool_or(F.array_contains(tags, t)).alias(f"has{i}") for i, t in enumerate(known)],
    )
    together = F.filter(
        F.zip_with(
            text_array(known), F.array(*[F.col(f"has{i}") for i in range(len(known))]),
            lambda tag, has: F.when(has, tag),
        ),
        lambda tag: tag.isNotNull(),
    )
    typed = met.select("app", "field", resolve_type(together, F.col("is_numeric")).alias("type"))
    return typed.withColumn("is_measurable", is_measurable(F.col("type"), F.col("field")))
