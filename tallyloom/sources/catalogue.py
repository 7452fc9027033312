"""Catalogue files: one JSON record per app in, flat tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.catalog import CATALOGUE, classify


def read_catalogue(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Catalogue records below a path, with the explicit schema.

    ``multiline`` reads files that hold one record over many lines; without it a file holds a
    record per line and can be split between tasks.
    """
    return spark.read.schema(CATALOGUE).option("multiLine", multiline).json(path)


def write_objects(objects: DataFrame, path: str) -> DataFrame:
    """Objects (app, offset, text) told apart once and stored in a folder per kind, read back.

    Every flat table is then read from the folder of its own kind alone, and a lost executor
    costs a part of a stored table rather than the inflating of the app files.
    """
    classify(objects).write.partitionBy("kind").parquet(path)
    return objects.sparkSession.read.parquet(path)


def write_catalogue(
    tables: dict[str, DataFrame], path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()
) -> None:
    """One folder per catalogue table. Partition by a column of few values only, never by app."""
    for name, df in tables.items():
        df.write.mode("errorifexists").format(fmt).partitionBy(*partition_by).save(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{path}/{name}")
