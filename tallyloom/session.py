"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # above the engine's own limit for estimates, broadcast by the size that a shuffle measured
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets the delimited reader take the single-byte codepages
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app_name: str = "tallyloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library expects; ``settings`` win over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder path below the shared folder named in ``spark.checkpoint.dir``.

    Where that setting is missing the warehouse folder takes its place, unless that is a local folder of the driver and
    executors run on other machines, which then could not reach it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        alone = spark.sparkContext.master.startswith("local")
        if not alone and (warehouse.startswith(("file:", "/")) or "://" not in warehouse):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        shared = f"{warehouse}/scratch"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once below the shared folder, with the writer's ``options``, and read back.

    Later steps neither compute it again nor depend on the executors that made it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
