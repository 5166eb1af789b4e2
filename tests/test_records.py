import random
from datetime import datetime

import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from wattframe.operators import records as R

SCHEMA = "k string, t timestamp_ntz, v double, n long"


def found(df, **kw):
    kw = {"floor": 0.0, "threshold": 1, **kw}
    out = R.detect_records(df, ["k"], "t", "v", "n", **kw)
    return sorted((r.aggregate, r.t, r.value) for r in out.collect())


def test_highs_and_lows(spark):
    values = [100.0, 90.0, 120.0, 120.2, 130.0, 80.0, None, 0.0]
    df = frame(spark, SCHEMA, *[("a", at(5 * i), v, 1) for i, v in enumerate(values)])
    assert found(df) == [
        ("high", at(0), 100.0),
        ("high", at(10), 120.0),
        ("high", at(20), 130.0),
        ("low", at(0), 100.0),
        ("low", at(5), 90.0),
        ("low", at(25), 80.0),
    ]


def test_floor_and_completeness(spark):
    df = frame(spark, SCHEMA, ("a", at(0), 90.0, 288), ("a", at(5), 110.0, 288), ("a", at(10), 5.0, 100), ("a", at(15), 80.0, 288))
    assert found(df, floor=100.0, threshold=288) == [("high", at(5), 110.0), ("low", at(0), 90.0), ("low", at(15), 80.0)]


def test_negative_lows_only_where_allowed(spark):
    df = frame(spark, SCHEMA, ("a", at(0), 10.0, 1), ("a", at(5), -5.0, 1))
    assert ("low", at(5), -5.0) not in found(df)
    assert ("low", at(5), -5.0) in found(df, allow_negative=True)


@pytest.mark.parametrize("chunk", [None, "day"])
def test_against_a_plain_loop(spark, chunk):
    rng = random.Random(11)
    data = [("a" if i % 3 else "b", at(5 * i), round(rng.uniform(1, 400), 1), 1) for i in range(900)]
    want = []
    for key in "ab":
        hi = lo = None
        for _, t, v, _ in [d for d in data if d[0] == key]:
            r = float(int(v + 0.5))
            if hi is None or r > hi:
                want.append((key, "high", t, r))
                hi = r
            if lo is None or v < lo:
                want.append((key, "low", t, v))
                lo = v
    out = R.detect_records(frame(spark, SCHEMA, *data), ["k"], "t", "v", "n", -1.0, 1, chunk=chunk)
    assert sorted((r.k, r.aggregate, r.t, r.value) for r in out.collect()) == sorted(want)


REC = "record_id string, interval timestamp_ntz, period string, value double, instance_id string"


def ramp(spark, n=13, step=5, period="interval"):
    return frame(spark, REC, *[("r", at(step * i), period, 100.0 + 20 * i, f"id{i}") for i in range(n)])


def test_debounce_keeps_one_per_window_and_relinks(spark):
    kept = R.chain(R.debounce(ramp(spark)))
    assert rows(kept.select("interval", "previous_instance_id"), "interval") == [(at(0), None), (at(50), "id0")]


def test_debounce_off_and_long_periods(spark):
    assert R.debounce(ramp(spark, 5), 0).count() == 5
    days = ramp(spark, 2, 5, "day")
    assert R.debounce(days).count() == 2


def test_debounce_reanchors_like_a_fold(spark):
    rng = random.Random(3)
    minutes = sorted(rng.sample(range(0, 5 * 2000, 5), 500))
    df = frame(spark, REC, *[("r", at(m), "interval", float(i), f"id{i}") for i, m in enumerate(minutes)])
    want, last = [], None
    for m in minutes:
        if last is None or m - last >= 50:
            want.append(at(m))
            last = m
    assert [r[1] for r in rows(R.debounce(df), "interval")] == want


def test_debounce_is_seeded_by_state(spark):
    state = frame(spark, "record_id string, interval timestamp_ntz", ("r", at(-20)))
    got = [r[1] for r in rows(R.debounce(ramp(spark), state=state), "interval")]
    assert got == [at(30)]


@pytest.mark.parametrize(
    ("aggregate", "metric", "value", "previous", "new"),
    [
        ("high", "power", 100.4, 100.0, False),
        ("high", "power", 101.0, 100.0, True),
        ("low", "power", 99.0, 100.0, True),
        ("low", "power", 99.6, 100.0, False),
        ("high", "renewable_proportion", 50.12, 50.11, True),
        ("high", "renewable_proportion", 50.111, 50.11, False),
        ("low", "power", 0.0, 5.0, False),
    ],
)
def test_is_new(spark, aggregate, metric, value, previous, new):
    df = frame(spark, "a string, m string, t timestamp_ntz, v double, pt timestamp_ntz, p double", (aggregate, metric, at(60), value, at(0), previous))
    assert df.select(R.is_new(*[F.col(c) for c in ("a", "m", "t", "v", "pt", "p")])).first()[0] is new
    early = df.withColumn("pt", F.col("t"))
    assert early.select(R.is_new(*[F.col(c) for c in ("a", "m", "t", "v", "pt", "p")])).first()[0] is False


@pytest.mark.parametrize(
    ("case", "score"),
    [
        (("NEM", None, "solar", "power", "interval", "high"), 10),
        (("NEM", "NSW1", "solar", "energy", "day", "high"), 9),
        (("NEM", None, "battery_charging", "power", "interval", "high"), 8),
        (("NEM", None, "coal", "power", "interval", "low"), 10),
        (("NEM", None, "demand", "energy", "day", "high"), 10),
        (("NEM", "SA1", None, "renewable_proportion", "day", "low"), 4),
        (("NEM", None, "renewables", "emissions", "month", "high"), 0),
        (("NEM", None, None, "price", "interval", "high"), 1),
        (("NEM", None, "hydro", "energy", "month", "low"), 1),
        (("NEM", None, "wind", "energy", "month", "high"), 9),
    ],
)
def test_significance(spark, case, score):
    schema = "network string, region string, fueltech string, metric string, period string, aggregate string"
    df = frame(spark, schema, case)
    assert df.select(R.significance(*[F.col(c) for c in df.columns])).first()[0] == score


def test_names_and_text(spark):
    df = frame(spark, "region string, fueltech string, metric string, period string, t timestamp_ntz", ("NSW1", "battery_charging", "power", "interval", at(0)), (None, None, "renewable_proportion", "season", at(0)))
    ids = df.select(R.record_id(F.lit("au"), F.lit("NEM"), *[F.col(c) for c in ("region", "fueltech", "metric", "period")], F.lit("high"), F.col("t")))
    assert [r[0] for r in ids.collect()] == ["au.nem.nsw1.battery_charging.power.interval.high", "au.nem.renewables.proportion.summer.high"]
    text = df.select(R.describe(F.lit("NEM"), *[F.col(c) for c in ("region", "fueltech", "metric", "period")], F.lit("high"), F.col("t")))
    assert text.first()[0] == "Interval Battery (charging) Generation high record for NEM in New South Wales"


def test_pct_change_limits(spark):
    df = frame(spark, "v double, p double", (110.0, 100.0), (100.001, 100.0), (1e6, 1.0), (1.0, 0.0), (-5.0, -10.0))
    got = df.select(R.pct_change(F.col("v"), F.col("p")).alias("a"), R.pct_change(F.col("v"), F.col("p"), True).alias("b")).collect()
    assert [r.a for r in got] == [10.0, None, None, None, -50.0]
    assert got[-1].b == 50.0


def test_completed_periods():
    spans = R.completed_periods(datetime(2024, 5, 15, 10, 5))
    assert spans["quarter"] == (datetime(2024, 1, 1), datetime(2024, 4, 1))
    assert spans["year"] == (datetime(2023, 1, 1), datetime(2024, 1, 1))
    assert R.completed_periods(datetime(2024, 1, 15))["quarter"] == (datetime(2023, 10, 1), datetime(2024, 1, 1))


def test_search_defaults_to_whole_networks(spark):
    schema = "record_id string, interval timestamp_ntz, network_id string, network_region string, significance int, fueltech_id string, aggregate string, metric string, period string"
    df = frame(
        spark,
        schema,
        ("au.nem.x", at(0), "NEM", None, 9, "wind", "high", "power", "day"),
        ("au.nem.nsw1.x", at(5), "NEM", "NSW1", 9, "wind", "high", "power", "day"),
        ("au.wem.x", at(5), "WEM", None, 5, "wind", "high", "power", "day"),
    )
    assert {r.record_id for r in R.search(df).collect()} == {"au.nem.x", "au.wem.x"}
    assert {r.record_id for r in R.search(df, places=["NSW1"]).collect()} == {"au.nem.nsw1.x"}
    assert {r.record_id for r in R.search(df, regions=["NSW1"], pattern="AU.*.x").collect()} == {"au.nem.nsw1.x"}
    assert {r.record_id for r in R.search(df, significance_min=9).collect()} == {"au.nem.x"}
    assert [r.total for r in R.page(df, [F.col("record_id")], 2).collect()] == [3, 3]


def test_pages_by_key_follow_each_other(spark):
    df = frame(spark, "v int, w string, n int", *[((None, 3, 1)[i % 3], (None, "x")[i % 2], i) for i in range(25)])
    for order in ([("v", True), ("w", False), ("n", True)], [("v", False), ("w", True), ("n", False)]):
        got, key = [], None
        while page := [tuple(r) for r in R.page_after(df, order, 4, key).collect()]:
            got, key = got + page, page[-1]
        assert got == [tuple(r) for r in df.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in order]).collect()]


def test_repair_and_reconcile(spark):
    schema = "record_id string, interval timestamp_ntz, value double, value_unit string"
    stored = frame(spark, schema, ("a.demand.energy.day", at(0), 5.0, "GWh"), ("b", at(0), 1.0, "MW"))
    rebuilt = frame(spark, schema, ("a.demand.energy.day", at(0), 5000.0, "MWh"), ("b", at(0), 9.0, "MW"))
    fixed = R.repair(stored, "%.demand.energy.%", rebuilt)
    assert rows(fixed.select("record_id", "value")) == [("a.demand.energy.day", 5000.0), ("b", 1.0)]
    report = R.repair_report(stored, fixed, rebuilt, "%.demand.energy.%", "MWh").first()
    assert report.sound and report.before_odd_units == 1
    merged = R.reconcile(stored, rebuilt.withColumn("interval", F.col("interval") + F.expr("INTERVAL 1 DAY")), at(0))
    assert merged.count() == 4


LONG = "metric string, period string, grouping string, network_region string, fueltech_id string, interval timestamp_ntz, value double, interval_count long"


def test_every_period_has_records(spark):
    """Weeks, seasons and financial years too; the period the end falls into is left out."""
    end = datetime(2024, 12, 20)
    starts = {
        "day": (datetime(2024, 11, 4), datetime(2024, 12, 20)),
        "week": (datetime(2024, 11, 4), datetime(2024, 12, 16)),
        "month": (datetime(2024, 10, 1), datetime(2024, 12, 1)),
        "quarter": (datetime(2024, 7, 1), datetime(2024, 10, 1)),
        "season": (datetime(2024, 9, 1), datetime(2024, 12, 1)),
        "year": (datetime(2023, 1, 1), datetime(2024, 1, 1)),
        "financial_year": (datetime(2023, 7, 1), datetime(2024, 7, 1)),
    }
    data = [("energy", p, "fueltech", "NSW1", "wind", t, 10.0 + i, 10**6) for p, pair in starts.items() for i, t in enumerate(pair)]
    got = R.find_records(frame(spark, LONG, *data), end)
    assert {(r.period, r.interval) for r in got.collect()} == {(p, pair[0]) for p, pair in starts.items()}


def test_an_unknown_period_is_refused(spark):
    row = ("energy", "decade", "fueltech", "NSW1", "wind", datetime(2024, 1, 1), 1.0, 1)
    with pytest.raises(Exception, match="unknown period"):
        R.find_records(frame(spark, LONG, row), datetime(2024, 12, 20)).collect()
