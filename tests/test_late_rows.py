"""Rows later than any watermark are summed and kept, and the newest hour is written."""

import pytest
from helpers import at, frame, rows
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattframe.streaming import jobs as J

ONCE = {"availableNow": True}
SF = "/root/testdata/sf0.001"


def fed(spark, path, start, df, parts):
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        start(J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)).awaitTermination()


def test_rollup_sums_late_rows_and_open_windows(spark, tmp_path):
    df, path = frame(spark, "ts timestamp_ntz, k string, v double, n int", *[(at(7 * i), "ab"[i % 2], float(i), i) for i in range(500)]), str(tmp_path)
    late = F.col("n") % 7 == 0
    fed(spark, path, lambda s: J.start_rollup(s, ["k"], ["v"], "ts", f"{path}/store", f"{path}/out", f"{path}/cp", trigger=ONCE), df, [~late, late])
    want = df.groupBy(F.window("ts", "5 minutes").start.alias("interval"), "k").agg(F.sum("v").alias("v"), F.count("v").alias("readings"))
    assert rows(spark.read.parquet(f"{path}/out").select("interval", "k", "v", "readings")) == rows(want)


def test_dedupe_keeps_late_keys_once(spark, tmp_path):
    df, path = frame(spark, "k string, t timestamp_ntz, n int", *[("ab"[i % 2], at(60 * (i % 90)), i) for i in range(180)]), str(tmp_path)
    late = F.col("n") % 7 == 0
    fed(spark, path, lambda s: J.start_dedupe(s, ["k", "t"], "t", f"{path}/out", f"{path}/cp", trigger=ONCE), df, [~late, late])
    assert rows(spark.read.parquet(f"{path}/out").select("k", "t")) == rows(df.select("k", "t").distinct())


@pytest.mark.parametrize("name", ["st3_tumbling_rollup", "st3_tumbling_rollup_all", "st4_dedupe_first"])
def test_queries_agree_with_sql_on_late_rows(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None
