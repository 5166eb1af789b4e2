"""Chunked scans agree with plain windows and with Python."""

import random
from datetime import timedelta

import pytest
from helpers import at, frame, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattframe.operators import ordered as O

SCHEMA = "k string, t timestamp_ntz, v double, w double"


@pytest.fixture(scope="module")
def series(spark):
    """Three series over weeks, one holding most rows, with many holes."""
    rng = random.Random(7)
    data = []
    for key, n in (("a", 400), ("b", 30), ("c", 1), (None, 12)):
        for m in sorted(rng.sample(range(0, 60 * 24 * 40, 5), n)):
            v = None if rng.random() < 0.5 else round(rng.uniform(-50, 50), 2)
            data.append((key, at(m), v, round(rng.uniform(0, 9), 1)))
    return frame(spark, SCHEMA, *data).cache()


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_lag(series, chunk):
    assert rows(O.lag_row(series, ["k"], "t", ["v", "w"], chunk=chunk)) == rows(
        O.lag_row(series, ["k"], "t", ["v", "w"], chunk=None)
    )


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_next(series, chunk):
    assert rows(O.next_row(series, ["k"], "t", ["v"], chunk=chunk)) == rows(
        O.next_row(series, ["k"], "t", ["v"], chunk=None)
    )


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_last_known(series, chunk):
    assert rows(O.last_known(series, ["k"], "t", ["v"], chunk)) == rows(O.last_known(series, ["k"], "t", ["v"], None))


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_linear(series, chunk):
    assert rows(O.linear_between(series, ["k"], "t", ["v"], chunk)) == rows(
        O.linear_between(series, ["k"], "t", ["v"], None)
    )


@pytest.mark.parametrize("chunk", ["day", "year"])
def test_running_extremes(series, chunk):
    values = {"hi": (F.col("v"), "max"), "lo": (F.col("v"), "min")}
    got = O.running_extremes(series, ["k"], "t", values, chunk)
    w = Window.partitionBy("k").orderBy("t")
    want = series.select(
        "*",
        F.max("v").over(w).alias("hi"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_hi"),
        F.min("v").over(w).alias("lo"),
        F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_lo"),
    )
    assert rows(got) == rows(want)


def test_lag_step_needs_no_join(spark):
    data = [("a", at(5 * i), float(i)) for i in range(900)]
    df = frame(spark, "k string, t timestamp_ntz, v double", *data)
    got = O.lag_step(df, ["k"], "t", ["v"], timedelta(minutes=5), chunk="day")
    assert rows(got, "t") == [(k, t, v, v - 1 if v else None) for k, t, v in data]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_hot_series_is_cut_up(spark, series):
    """The wide rows are shuffled by key and chunk, never by key alone."""
    out = O.last_known(series, ["k"], "t", ["v"], "day")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert any("_chunk" in w.split("],")[1] for w in windows)


def test_join_and_window_share_one_shuffle(spark, series):
    """With a join that shuffles, the wide side is exchanged exactly once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = O.last_known(series, ["k"], "t", ["v"], "day")
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Wide rows, chunk summary, and the summary rows along each series and back.
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" in plan and len(exchanges) == 4
