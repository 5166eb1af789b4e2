from datetime import datetime, timedelta

from helpers import at, frame, rows
from pyspark.sql import functions as F

from wattframe.operators import history as H
from wattframe.operators import quality as Q
from wattframe.operators import versioning as V

T = "interval timestamp_ntz, network_id string, unit_code string, generated double, energy double, is_forecast boolean"


def test_frozen_night(spark):
    units = frame(spark, "unit_code string, network_region string, fueltech_id string, capacity_registered double", ("S", "NSW1", "solar_utility", 100.0))
    night = [(at(22 * 60 + 5 * i), "NEM", "S", 60.76, 5.0, False) for i in range(30)]
    wobble = [(at(48 * 60 + 22 * 60 + 5 * i), "NEM", "S", 11.0 + i, 5.0, False) for i in range(8)]
    small = [(at(96 * 60 + 22 * 60 + 5 * i), "NEM", "S", 5.0, 5.0, False) for i in range(30)]
    out = Q.frozen_telemetry(frame(spark, T, *night, *wobble, *small), units, at(0)).collect()
    assert [(r.night, r.intervals, r.is_constant) for r in out] == [(datetime(2024, 1, 1), 30, True), (datetime(2024, 1, 3), 8, False)]


def test_dropped_codes(spark):
    units = frame(spark, "unit_code string, fueltech_id string, facility_code string", ("OK", "wind", "F"), ("HALF", None, "F"))
    rows_ = [(at(0), "NEM", c, 60.0, e, False) for c, e in (("OK", 5.0), ("HALF", 5.0), ("GONE", 7.0), ("TINY", 0.5), ("V-SA", 9.0), ("BBATTERY", 9.0))]
    out = Q.dropped_codes(frame(spark, T, *rows_), units, at(-60))
    assert [(r.code, r.reason) for r in out.collect()] == [("GONE", "no units row"), ("HALF", "unit has no fueltech or station")]


def test_effective_status(spark):
    df = frame(spark, "s string, g double, m double, r double", ("operating", 90.0, 100.0, None), ("operating", 91.0, 100.0, None), ("operating", None, 100.0, None), ("retired", 1.0, 100.0, None), ("operating", 45.0, None, 50.0))
    got = [r[0] for r in df.select(Q.effective_status(*[F.col(c) for c in "sgmr"])).collect()]
    assert got == ["commissioning", "operating", "operating", "retired", "commissioning"]


def test_resolve_codes_keeps_claimed_prefix(spark):
    df = frame(spark, "code string", ("0WNSF",), ("WNSF",), ("0NEW1",), ("01X",))
    got = {r.code: r.operational_code for r in Q.resolve_codes(df).collect()}
    assert got == {"0WNSF": "0WNSF", "WNSF": "WNSF", "0NEW1": "NEW1", "01X": "01X"}


def test_new_codes_are_filtered(spark):
    units = frame(spark, "unit_code string", ("A",))
    rows_ = [(at(0), n, c, 1.0, 1.0, False) for n, c in (("NEM", "A"), ("NEM", "DG_X"), ("NEM", "FRESH"), ("WEM", "DG_X"), ("NEM", "ABV1"))]
    assert rows(Q.new_codes(frame(spark, T, *rows_), units, at(-1)).select("network_id", "unit_code")) == [("NEM", "FRESH"), ("WEM", "DG_X")]


def test_feed_gap(spark):
    units = frame(spark, "status_id string, network_id string, dispatch_type string, data_last_seen timestamp_ntz", ("operating", "NEM", "GENERATOR", at(0)))
    assert Q.feed_gap(units, at(30)).first().has_gap is False
    assert Q.feed_gap(units, at(31)).first().has_gap is True
    assert Q.feed_gap(units.filter("false"), at(31)).first().has_gap is True


def test_value_at_takes_changes_at_the_same_time(spark):
    history = frame(spark, "unit_id int, changed_at timestamp_ntz, capacity_registered double", (1, at(0), 10.0), (1, at(60), None), (1, at(120), 30.0))
    probes = frame(spark, "unit_id int, t timestamp_ntz", (1, at(-5)), (1, at(0)), (1, at(90)), (1, at(120)), (2, at(0)))
    for chunk in (None, "day"):
        got = rows(H.value_at(probes, history, "unit_id", "t", "capacity_registered", chunk=chunk))
        assert got == sorted([(1, at(-5), None), (1, at(0), 10.0), (1, at(90), 10.0), (1, at(120), 30.0), (2, at(0), None)], key=repr)


def test_capture_changes_is_null_safe(spark):
    s = "unit_id int, capacity_registered double, emissions_factor_co2 double, emission_factor_source string"
    now = frame(spark, s, (1, 10.0, None, "a"), (2, 10.0, 0.5, None), (3, 1.0, 1.0, "x"))
    new = frame(spark, s, (1, 10.0, 0.4, "a"), (2, 10.0, None, None), (3, 1.0, 1.0, "x"))
    got = rows(H.capture_changes(now, new, at(0)), "unit_id")
    assert [(r[0], r[2], r[3]) for r in got] == [(1, None, 0.4), (2, None, None)]


def test_upsert_modes(spark):
    s = "k int, a double, b double"
    target = frame(spark, s, (1, 1.0, 1.0), (2, None, 2.0))
    updates = frame(spark, "k int, a double, n int", (1, 9.0, 1), (1, None, 2), (2, 5.0, 1), (3, 7.0, 1))
    assert rows(V.upsert(target, updates, ["k"], ["a"], "n"), "k") == [(1, None, 1.0), (2, 5.0, 2.0), (3, 7.0, None)]
    assert rows(V.upsert(target, updates, ["k"], ["a"], "n", "fill_nulls"), "k") == [(1, 1.0, 1.0), (2, 5.0, 2.0), (3, 7.0, None)]
    assert rows(V.upsert(target, updates, ["k"], ["a"], "n", "ignore"), "k") == [(1, 1.0, 1.0), (2, None, 2.0), (3, 7.0, None)]
    assert rows(V.merge_sparse(target, updates, ["k"], ["a"], "n"), "k") == [(1, 1.0, 1.0), (2, 5.0, 2.0), (3, 7.0, None)]


def test_partial_rollup_never_beats_a_full_one(spark):
    df = frame(spark, "day int, interval int, version long", (1, 0, 900), (2, 0, 100), (2, 1, 100))
    got = {r.day: r.v for r in df.groupBy("day").agg(V.completeness_version("interval", "version").alias("v")).collect()}
    assert got[2] > got[1]


def test_dedupe_combines_before_the_shuffle(spark):
    """A key with very many copies costs one row per task, not a huge group."""
    df = spark.range(0, 50_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), (F.col("id") * 2).alias("v"))
    out = V.dedupe_last(df, ["k"], "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    assert rows(out, "k") == [(0, 49998, 99996), (1, 49999, 99998), (2, 49997, 99994)]


def test_list_facilities_drops_empty_ones(spark):
    units = frame(spark, "facility_code string, unit_code string, fueltech_id string, status_id string, dispatch_type string, capacity_registered double, capacity_maximum double, max_generation double, approved boolean, interconnector boolean", ("A", "A1", "wind", "operating", "GENERATOR", 10.0, None, 9.9, True, False), ("B", "B1", "coal_black", "operating", "GENERATOR", 10.0, None, None, True, False), ("C", "C1", "wind", "operating", "GENERATOR", 1.0, None, None, False, False))
    sites = frame(spark, "facility_code string, network_id string, network_region string", ("A", "NEM", "NSW1"), ("B", "NEM", "NSW1"), ("C", "NEM", "NSW1"))
    got = Q.list_facilities(sites, units, groups=["wind"]).collect()
    assert [(r.facility_code, [u.unit_code for u in r.units]) for r in got] == [("A", ["A1"])]


def test_changed_since(spark):
    df = frame(spark, "id int, t timestamp_ntz", (1, at(0)), (2, at(60 * 30)))
    assert [r.id for r in Q.changed_since(df, "t", at(0) + timedelta(hours=31), 24).collect()] == [2]
