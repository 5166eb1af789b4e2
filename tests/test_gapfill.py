from datetime import datetime, timedelta

import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from wattframe.operators import gapfill as G

FIVE = timedelta(minutes=5)
S = "k string, t timestamp_ntz, v double"


def test_gapfill_grid_is_half_open_and_keeps_row_at_end(spark):
    df = frame(spark, S, ("a", at(5), 1.0), ("a", at(20), 2.0))
    out = G.gapfill(df, ["k"], "t", FIVE, at(0), at(20))
    assert rows(out, "t") == [("a", at(0), None), ("a", at(5), 1.0), ("a", at(10), None), ("a", at(15), None), ("a", at(20), 2.0)]


def test_locf_flavours(spark):
    df = frame(spark, S, ("a", at(0), 1.0), ("a", at(5), None))
    full = G.gapfill(df, ["k"], "t", FIVE, at(0), at(15), present="seen")
    carried = G.locf(full, ["k"], "t", ["v"])
    assert [r[2] for r in rows(carried.select("k", "t", "v"), "t")] == [1.0, 1.0, 1.0]
    plain = G.locf(full, ["k"], "t", ["v"], treat_null_as_missing=False, present="seen")
    assert [r[2] for r in rows(plain.select("k", "t", "v"), "t")] == [1.0, None, None]


def test_interpolate_never_extrapolates(spark):
    df = frame(spark, S, ("a", at(0), None), ("a", at(5), 10.0), ("a", at(10), None), ("a", at(15), 20.0), ("a", at(20), None))
    assert [r[2] for r in rows(G.interpolate(df, ["k"], "t", ["v"]), "t")] == [None, 10.0, 15.0, 20.0, None]


def test_tail_is_bounded(spark):
    df = frame(spark, S, ("a", at(0), 6.0), ("a", at(30), 12.0))
    full = G.gapfill(df, ["k"], "t", FIVE, at(0), at(70))
    got = [r[2] for r in rows(G.interpolate_with_tail(full, ["k"], "t", "v"), "t")]
    assert got == [6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 12.0, 12.0, 12.0, 12.0, 12.0, None, None]


def test_spread_equals_grid_fill(spark):
    data = [("a", at(10), 1.0), ("a", at(25), 4.0), ("b", at(0), 2.0)]
    df = frame(spark, S, *data)
    full = G.gapfill(df, ["k"], "t", FIVE, at(0), at(60))
    held = G.locf(full, ["k"], "t", ["v"]).filter("v IS NOT NULL")
    assert rows(G.spread(df, ["k"], "t", FIVE, at(60), hold=["v"])) == rows(held)
    lined = G.interpolate(full, ["k"], "t", ["v"]).filter("v IS NOT NULL")
    assert rows(G.spread(df, ["k"], "t", FIVE, at(60), line=["v"]).filter("v IS NOT NULL")) == rows(lined)


def test_locf_bounded_is_seeded_and_bounded(spark):
    df = frame(spark, S, ("a", at(-30), 3.0), ("a", at(0), 4.0), ("a", at(-90), 9.0))
    got = rows(G.locf_bounded(df, ["k"], "t", ["v"], FIVE, at(0), at(120)), "t")
    assert got[0] == ("a", at(-30), 3.0) and got[-1] == ("a", at(25), 4.0)
    assert [v for _, t, v in got if t >= at(0)] == [4.0] * 6


@pytest.mark.parametrize(
    ("interval", "points", "missing"),
    [
        ("1d", [datetime(2024, 1, d) for d in (1, 2, 4, 5)], [datetime(2024, 1, 3)]),
        ("5m", [at(0), at(20)], [at(5), at(10), at(15)]),
        ("1M", [datetime(2024, 1, 1), datetime(2024, 3, 1)], [datetime(2024, 2, 1)]),
        ("1d", [datetime(2024, 1, 1)], []),
    ],
)
def test_interior_gaps(spark, interval, points, missing):
    df = frame(spark, S, *[("a", p, 1.0) for p in points])
    out = rows(G.fill_interior(df, ["k"], "t", interval), "t")
    assert [t for _, t, v in out if v is None] == missing
    assert len(out) == len(points) + len(missing)


def test_dense_monthly_series(spark):
    df = frame(spark, S, *[("a", datetime(2024, m, 1), v) for m, v in ((1, 10.0), (2, 20.0), (4, 40.0))])
    row = G.dense_series(df, ["k"], "t", "v", "1M").first()
    assert row["data"] == [10.0, 20.0, None, 40.0]
    assert (row["start"], row["last"]) == (datetime(2024, 1, 1), datetime(2024, 4, 1))


def test_dense_series_off_grid_keeps_its_points(spark):
    df = frame(spark, S, ("a", at(0), 1.0), ("a", at(7), 2.0), ("a", at(20), 3.0))
    assert G.dense_series(df, ["k"], "t", "v", "5m").first()["data"] == [1.0, 2.0, 3.0]


def test_series_edges(spark):
    df = frame(spark, S, *[("a", at(5 * i), v) for i, v in enumerate([None, 1.0, None, 2.0, None])], ("z", at(0), None))
    assert [r[2] for r in rows(G.trim_nulls(df, ["k"], "t", "v"), "t")] == [1.0, None, 2.0]
    cast = rows(G.cast_trailing_nulls(df, ["k"], "t", "v").filter("k = 'a'"), "t")
    assert [r[2] for r in cast] == [None, 1.0, None, 2.0, 0.0]
    kept = G.drop_empty_series(df.withColumn("v", F.coalesce("v", F.lit(0.0))), ["k"], "v")
    assert {r[0] for r in rows(kept)} == {"a"}


def test_missing_intervals_align_to_step(spark):
    log = frame(spark, "source string, t timestamp_ntz", ("x", at(0)), ("x", at(60)))
    out = G.missing_intervals(log, "source", "t", timedelta(minutes=30), at(10), at(100))
    assert rows(out, "t") == [("x", at(30)), ("x", at(90))]


def test_pad_combinations_uses_no_cross_join(spark):
    df = frame(spark, "n string, m int, f string, c double", ("N", 1, "x", 1.0), ("W", 2, "y", 2.0))
    out = G.pad_combinations(df, ["m", "f"], ["n"], "c")
    assert len(rows(out)) == 8 and out.agg(F.sum("c")).first()[0] == 3.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cap_to_settled(spark):
    df = frame(spark, S, ("a", at(0), 1.0), ("a", at(5), 2.0))
    assert rows(G.cap_to_settled(df, "t", at(60), at(60))) == [("a", at(0), 1.0)]
    old = at(60 * 24 * 30)
    assert len(rows(G.cap_to_settled(df, "t", old, old))) == 2


def test_validate_length(spark):
    df = frame(spark, S, ("a", at(0), 1.0), ("a", at(5), 1.0), ("b", at(0), 1.0))
    assert rows(G.validate_length(df, ["k"], "t", FIVE, at(0), at(5))) == [("b", 1, 2)]


def test_long_grid_holds_no_folded_range(spark):
    df = frame(spark, S, ("a", at(0), 1.0))
    out = G.grid(df, ["k"], "t", FIVE, datetime(1999, 1, 1), datetime(2024, 1, 1, 0, 3))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5_000
    got = out.agg(F.count_distinct("t").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    assert got["n"] == 9131 * 288 + 1 and got["lo"] == datetime(1999, 1, 1) and got["hi"] == datetime(2024, 1, 1)


def test_a_series_beyond_the_allowed_span_is_an_error(spark):
    df = frame(spark, S, ("a", at(0), 1.0), ("a", at(60 * 24 * 40), 2.0))
    with pytest.raises(Exception, match="at most 32 days"):
        G.dense_series(df, ["k"], "t", "v", "1h").collect()
