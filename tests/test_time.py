from datetime import datetime, timedelta

import pytest
from helpers import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattframe.functions import timebucket as T
from wattframe.functions.clean import clean_capacity, clean_code, parse_interval, parse_size, parse_ts, sigfig

D = datetime


@pytest.mark.parametrize(
    ("at", "week", "season", "fy"),
    [
        (D(2024, 1, 1), D(2023, 12, 31), D(2023, 12, 1), D(2024, 1, 1)),
        (D(2024, 2, 29, 12), D(2024, 2, 25), D(2023, 12, 1), D(2024, 1, 1)),
        (D(2024, 6, 30, 23, 55), D(2024, 6, 30), D(2024, 6, 1), D(2024, 1, 1)),
        (D(2024, 7, 1), D(2024, 6, 30), D(2024, 6, 1), D(2025, 1, 1)),
        (D(2024, 12, 31), D(2024, 12, 29), D(2024, 12, 1), D(2025, 1, 1)),
    ],
)
def test_calendar_buckets(spark, at, week, season, fy):
    df = frame(spark, "t timestamp_ntz", (at,))
    row = df.select(T.bucket("t", "7d"), T.bucket("t", "season"), T.bucket("t", "fy")).first()
    assert tuple(row) == (week, season, fy)


def test_buckets_stay_naive(spark):
    df = frame(spark, "t timestamp_ntz", (D(2024, 5, 17, 13, 47, 12),))
    out = df.select(*[T.bucket("t", i).alias(f"b{n}") for n, i in enumerate(T.INTERVALS)])
    assert {f.dataType.typeName() for f in out.schema} == {"timestamp_ntz"}


@settings(max_examples=200, deadline=None)
@given(st.datetimes(min_value=D(1999, 1, 1), max_value=D(2035, 1, 1)))
def test_period_bounds(now):
    for period, days in (("day", (1, 1)), ("month", (28, 31)), ("quarter", (89, 92)), ("year", (365, 366))):
        start, end = T.period_bounds(now, period)
        assert start < end <= now and days[0] <= (end - start).days <= days[1]


@given(st.datetimes(min_value=D(1999, 1, 1), max_value=D(2035, 1, 1)))
def test_day_end_only_at_midnight(now):
    assert T.is_period_end(now, "day") == ((now.hour, now.minute, now.second) == (0, 0, 0))
    assert T.is_period_end(now.replace(day=1, month=7, hour=0, minute=0, second=0), "financial_year")


def test_ranges():
    with pytest.raises(ValueError):
        T.check_range("5m", D(2024, 1, 1), D(2024, 1, 10))
    T.check_range("5m", D(2024, 1, 1), D(2024, 1, 9))
    assert T.default_range("1d", D(2024, 7, 1))[0] == D(2024, 7, 1) - timedelta(days=183)
    with pytest.raises(ValueError):
        T.guard_intervals(D(2024, 1, 1), D(2024, 1, 30), timedelta(minutes=5))
    first, last = D(2020, 3, 4, 5, 6), D(2024, 5, 17, 13, 47)
    assert T.resolve_range(first, last, "1M", period="all") == (D(2020, 3, 1), D(2024, 4, 30, 23, 59, 59))
    assert T.resolve_range(first, last, "1d", year=2023) == (D(2023, 1, 1), D(2023, 12, 31, 23, 59, 59))
    assert T.resolve_range(first, last, "1d", year=2024, now=last)[1] == D(2024, 5, 16, 23, 59, 59)
    assert T.resolve_range(first, last, "30m", period="7d") == (D(2024, 5, 10, 13, 30), D(2024, 5, 17, 13, 30))
    assert T.resolve_range(first, last, "5m", forecast=True) == (last, last + timedelta(days=7))
    assert T.snap_window(D(2024, 1, 1, 0, 50), D(2024, 1, 1, 23, 45)) == (D(2024, 1, 1, 0, 30), D(2024, 1, 1, 23, 30))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1/11/08 0:00", D(2008, 11, 1)),
        ("2020/06/01 21:35:00", D(2020, 6, 1, 21, 35)),
        ("27/9/2019  2:55:00 pm", D(2019, 9, 27, 14, 55)),
        ("20201008133000", D(2020, 10, 8, 13, 30)),
        ("2021-01-02T03:04:05", D(2021, 1, 2, 3, 4, 5)),
        ("20210102", D(2021, 1, 2)),
        ("nonsense", None),
    ],
)
def test_parse_ts(spark, text, want):
    assert frame(spark, "s string", (text,)).select(parse_ts("s")).first()[0] == want


def test_cleaning(spark):
    df = frame(spark, "s string", (" bw01 ",), ("-",), ("",), ("AB_x000D_",), (None,))
    assert rows(df.select(clean_code("s"))) == sorted([("BW01",), ("",), (None,), ("AB",), (None,)], key=repr)
    caps = frame(spark, "s string", ("10-20",), ("3/4",), ("1,5",), ("-",), (" 7 ",))
    assert {r[0] for r in caps.select(clean_capacity("s")).collect()} == {20.0, 4.0, 1.5, None, 7.0}
    nums = frame(spark, "v double", (123456.7,), (0.012345,), (0.0,), (-98.76543,))
    assert {r[0] for r in nums.select(sigfig("v", 4)).collect()} == {123456.0, 0.01234, 0.0, -98.77}
    assert frame(spark, "s string", ("5m",)).select(parse_interval("s")).first()[0] == 5
    assert frame(spark, "s string", ("1M",)).select(parse_size("s")).first()[0] == 1048576


def test_epoch_seconds_ignores_session_zone(spark):
    df = frame(spark, "t timestamp_ntz", (D(2024, 3, 31, 2, 30),))
    want = int((D(2024, 3, 31, 2, 30) - D(1970, 1, 1)).total_seconds())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(T.epoch_seconds("t")).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unknown_bucket_is_refused():
    with pytest.raises(ValueError):
        T.bucket(F.lit(None), "2h")
