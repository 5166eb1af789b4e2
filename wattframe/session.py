"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# All market time is network-local and naive, so a session in a zone with
# daylight saving would shift truncations. Everything runs in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, name: str = "wattframe", **conf: str) -> SparkSession:
    """A session for local runs and tests; on a cluster, pass no master."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only a local session without one gets a folder of its own.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = _LOCAL.get("folder") or _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="wattframe-"))
    return shared


_LOCAL: dict[str, str] = {}


def stage(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, its lineage cut.

    For results read several times.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """`df` written once as a Parquet table in the shared folder, partitioned by some columns, and read back.

    For results of which several parts or few columns are read.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
