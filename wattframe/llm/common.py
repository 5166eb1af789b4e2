"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattframe.session import shared_folder, stage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as a table in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves no remainder by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """`df` with inclusive running sums over a global order, without gathering it in one task.

    Rows are range-partitioned, each range is summed by itself, and the sums of the ranges before it (one row
    for each range) are added.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in totals.items()]).select(
        "_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in totals.items()])
    out = local.join(offsets, "_range")
    return out.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals]
    )


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each row begins and the last ends. Null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text; a longer text comes by itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end
