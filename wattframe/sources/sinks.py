"""Writing facts, rollups and published series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fact(df: DataFrame, path: str, ts: str = "interval", grain: str = "month", mode: str = "overwrite") -> None:
    """A fact as Parquet by month or day; overwriting replaces touched partitions only.

    Rows of a partition value go together, and Spark splits a heavy month by
    its measured size.
    """
    pattern = {"month": "yyyyMM", "day": "yyyyMMdd"}[grain]
    name = {"month": "yyyymm", "day": "yyyymmdd"}[grain]
    tagged = df.withColumn(name, F.date_format(F.col(ts), pattern).cast("int"))
    shuffled = tagged.hint("rebalance", F.col(name))
    shuffled.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def read_fact(spark, path: str, start=None, end=None, ts: str = "interval") -> DataFrame:
    """A fact restricted in time; the month partitions outside are not read."""
    from wattframe.functions.timebucket import ts_lit

    df = spark.read.parquet(path)
    for bound, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c < v)):
        if bound is not None:
            df = df.filter(keep(F.col(ts), ts_lit(bound)))
            if "yyyymm" in df.columns:
                month = bound.year * 100 + bound.month
                df = df.filter(F.col("yyyymm") >= month if bound is start else F.col("yyyymm") <= month)
    return df.drop("yyyymm")


def write_series(df: DataFrame, base_path: str, partition_cols: Sequence[str], mode: str = "overwrite") -> None:
    """Published series as a tree of JSON files, one folder level per key.

    Rows of a key go together, but Spark splits a large key by its measured size.
    """
    df.hint("rebalance", *[F.col(c) for c in partition_cols]).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partition_cols).json(base_path)
