"""Jobs fed in several batches leave what one batch job computes."""

import random
import time
from datetime import timedelta

import numpy as np
import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from wattframe.operators import enrich as E
from wattframe.operators import rollups as R
from wattframe.streaming import jobs as J
from wattframe.streaming.state import followers

ONCE = {"availableNow": True}
SCHEMA = "event_id long, interval timestamp_ntz, network_id string, unit_code string, generated double, energy double, energy_storage double, is_forecast boolean"
UNITS = (
    "unit_code string, facility_code string, network_id string, network_region string, fueltech_id string, "
    "fueltech_group_id string, renewable boolean, status_id string, emissions_factor_co2 double"
)


def batches(spark, path, df, parts):
    """Files that arrive one after the other."""
    for i, condition in enumerate(parts):
        df.filter(condition).coalesce(1).write.mode("append").parquet(f"{path}/in")
        spark.catalog.clearCache()
        yield i


def readings(spark):
    rng = random.Random(5)
    data = []
    for n in range(400):
        unit = rng.choice(["C1", "W1"])
        data.append((n, at(5 * rng.randrange(0, 600)), "NEM", unit, round(rng.uniform(0, 90), 2), round(rng.uniform(0, 9), 2), None, False))
    return frame(spark, SCHEMA, *data)


def units(spark):
    return frame(spark, UNITS, ("C1", "F1", "NEM", "NSW1", "coal_black", "coal", False, "operating", 0.9), ("W1", "F2", "NEM", "NSW1", "wind", "wind", True, "operating", None))


def market(spark):
    s = "interval timestamp_ntz, network_id string, network_region string, price double, is_forecast boolean"
    return frame(spark, s, *[(at(30 * i), "NEM", "NSW1", 50.0 + i, False) for i in range(110)])


def test_unit_facts_heal_late_rows(spark, tmp_path):
    df, path = readings(spark), str(tmp_path)
    late = F.col("event_id") % 4 == 0
    for _ in batches(spark, path, df, [~late, late]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_unit_facts(stream, lambda: market(spark), lambda: units(spark), f"{path}/store", f"{path}/fact", f"{path}/cp", trigger=ONCE).awaitTermination()
    got = spark.read.parquet(f"{path}/fact").drop("version", J.DAY)
    want = E.unit_intervals(df, market(spark), units(spark), at(0), at(60 * 72)).drop("version")
    cols = sorted(want.columns)
    assert rows(got.select(*cols)) == rows(want.select(*cols))


def test_prices_hold_over_midnight(spark, tmp_path):
    s = "interval timestamp_ntz, network_id string, network_region string, price double, is_forecast boolean"
    few = frame(spark, s, (at(60 * 22), "NEM", "NSW1", 80.0, False), (at(60 * 30), "NEM", "NSW1", 90.0, False))
    df, path = readings(spark), str(tmp_path)
    day = F.dayofmonth("interval")
    for _ in batches(spark, path, df, [day == 2, day == 1, day > 2]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_unit_facts(stream, lambda: few, lambda: units(spark), f"{path}/store", f"{path}/fact", f"{path}/cp", trigger=ONCE).awaitTermination()
    got = spark.read.parquet(f"{path}/fact").drop("version", J.DAY)
    want = E.unit_intervals(df, few, units(spark), at(0), at(60 * 72)).drop("version")
    cols = sorted(want.columns)
    assert rows(got.select(*cols)) == rows(want.select(*cols))


def test_late_rows_mend_the_next_day(spark, tmp_path):
    s = "interval timestamp_ntz, network_id string, unit_code string, generated double, energy double, energy_quality_flag short"
    df = frame(spark, s, *[(at(5 * i), "NEM", "A", float(i * i % 97), None, 0) for i in range(600)])
    path = str(tmp_path)
    late = F.col("interval") == F.lit(at(24 * 60 - 5)).cast("timestamp_ntz")
    for _ in batches(spark, path, df, [~late, late]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_energy(stream, f"{path}/store", f"{path}/energy", f"{path}/cp", trigger=ONCE).awaitTermination()
    got = rows(spark.read.parquet(f"{path}/energy").select("interval", "energy"), "interval")
    power = [float(i * i % 97) for i in range(600)]
    assert got == [(at(5 * i), (power[i] + power[i - 1]) / 2 / 12) for i in range(1, 600)]


def test_only_touched_days_are_recomputed(spark, tmp_path):
    s = "k int, interval timestamp_ntz"
    df = frame(spark, s, (1, at(10)), (2, at(24 * 60 * 40)))
    assert J.touched_days(df, str(tmp_path / "none")) == {at(0).date(), at(24 * 60 * 40).date()}


def test_last_row_wins_across_batches(spark, tmp_path):
    s = "k string, interval timestamp_ntz, v double, n long"
    df = frame(spark, s, ("a", at(0), 1.0, 1), ("a", at(0), 2.0, 2), ("b", at(0), 5.0, 3), ("a", at(0), 3.0, 4), ("c", at(5), 6.0, 5))
    path = str(tmp_path)
    for _ in batches(spark, path, df, [F.col("n") <= 3, F.col("n") > 3]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_upsert(stream, ["k", "interval"], "n", "interval", f"{path}/out", f"{path}/cp", trigger=ONCE).awaitTermination()
    assert rows(spark.read.parquet(f"{path}/out").select("k", "v")) == [("a", 3.0), ("b", 5.0), ("c", 6.0)]


def test_rebuild_touches_whole_days(spark, tmp_path):
    measures = [c for c in E.MARKET_MEASURES]
    s = "interval timestamp_ntz, network_id string, network_region string, " + ", ".join(f"{c} double" for c in measures) + ", version long"
    df = frame(spark, s, *[(at(5 * i), "NEM", "NSW1", *[float(i)] * len(measures), 1) for i in range(700)])
    path = str(tmp_path)
    late = F.minute("interval") == 25
    for _ in batches(spark, path, df, [~late, late]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_rebuild(stream, R.market_daily, ["interval", "network_id", "network_region"], f"{path}/store", f"{path}/daily", f"{path}/cp", trigger=ONCE).awaitTermination()
    got = spark.read.parquet(f"{path}/daily").drop(J.DAY)
    want = R.market_daily(df)
    assert rows(got.select(*sorted(got.columns))) == rows(want.select(*sorted(want.columns)))


def test_records_across_batches_follow_a_fold(spark, tmp_path):
    rng = random.Random(9)
    data = [("r" if i % 2 else "s", at(5 * i), round(rng.uniform(1, 500), 1), "high", "interval", 0) for i in range(300)]
    s = "record_id string, interval timestamp_ntz, value double, aggregate string, period string, digits int"
    df = frame(spark, s, *data)
    path = str(tmp_path)
    cut = F.lit(at(700)).cast("timestamp_ntz")
    for _ in batches(spark, path, df, [F.col("interval") < cut, F.col("interval") >= cut]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_records(stream, f"{path}/out", f"{path}/cp", trigger=ONCE).awaitTermination()
    want = []
    for key in "rs":
        value = last = None
        for _, t, v, *_ in [d for d in data if d[0] == key]:
            if value is None or (round(v) > value and (t - last).total_seconds() >= 3000):
                want.append((key, t, v, last))
                value, last = round(v), t
    out = J.read_records(spark, f"{path}/out")
    assert rows(out.select("record_id", "interval", "value", "previous_interval")) == sorted(want, key=repr)
    ids = {(r.record_id, r.interval): r.instance_id for r in out.collect()}
    assert len(set(ids.values())) == len(want)
    assert all(r.previous_instance_id == ids.get((r.record_id, r.previous_interval)) for r in out.collect())


def test_energy_across_batches(spark, tmp_path):
    s = "interval timestamp_ntz, network_id string, unit_code string, generated double, energy double, energy_quality_flag short"
    df = frame(spark, s, *[(at(5 * i), "NEM", "A", float(i), None, 0) for i in range(400)])
    path = str(tmp_path)
    for _ in batches(spark, path, df, [F.col("generated") < 250, F.col("generated") >= 250]):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_energy(stream, f"{path}/store", f"{path}/energy", f"{path}/cp", trigger=ONCE).awaitTermination()
    got = rows(spark.read.parquet(f"{path}/energy").select("interval", "energy"), "interval")
    assert got == [(at(5 * i), (2 * i - 1) / 2 / 12) for i in range(1, 400)]


def test_silence_is_noticed_and_ends(spark, tmp_path):
    s = "network_id string, interval timestamp_ntz"
    df = frame(spark, s, ("NEM", at(0)), ("WEM", at(0)), (None, at(0)), ("NEM", None), ("NEM", at(60)), ("WEM", at(65)), ("NEM", at(65)))
    path = str(tmp_path)
    parts = [F.coalesce(F.col("interval"), F.lit(at(0))) <= F.lit(at(0)).cast("timestamp_ntz"), F.col("interval") == F.lit(at(60)).cast("timestamp_ntz"), F.col("interval") == F.lit(at(65)).cast("timestamp_ntz")]
    silent = []
    for _ in batches(spark, path, df, parts):
        stream = J.stream_table(spark, f"{path}/in", df.schema, per_batch=1)
        J.start_silence_alert(stream, f"{path}/out", f"{path}/cp", clock="EventTime", trigger=ONCE).awaitTermination()
        silent.append([tuple(r) for r in J.read_alerts(spark, f"{path}/out").collect()])
    assert silent == [[], [("WEM", at(0), at(30))], []]


def test_a_timer_tells_of_feeds_that_all_have_stopped(spark, tmp_path):
    """After one file nothing comes any more, and no batch has rows: the alerts come all the same."""
    df = frame(spark, "network_id string, interval timestamp_ntz", ("NEM", at(0)), ("WEM", at(5)))
    path = str(tmp_path)
    df.write.parquet(f"{path}/in")
    job = J.start_silence_alert(
        J.stream_table(spark, f"{path}/in", df.schema), f"{path}/out", f"{path}/cp", timedelta(seconds=2), trigger={"processingTime": "1 second"}
    )
    try:
        until = time.time() + 90
        found = []
        while time.time() < until and len(found) < 2:
            time.sleep(1)
            found = rows(J.read_alerts(spark, f"{path}/out").select("network_id", "last_seen")) if (tmp_path / "out").exists() else []
        assert found == [("NEM", at(0)), ("WEM", at(5))]
        assert job.exception() is None
    finally:
        job.stop()


def fold(data, gap=3000):
    """The records among (id, time, value) rows, one after the other in order of time."""
    kept, standing = [], {}
    for key, t, v in sorted(data, key=lambda d: (d[0], d[1])):
        value, last = standing.get(key, (None, None))
        if value is None or (round(v) > value and (t - last).total_seconds() >= gap):
            kept.append((key, t, v, last))
            standing[key] = (round(v), t)
    return sorted(kept, key=repr)


@pytest.mark.parametrize("period", ["interval", "day"])
@pytest.mark.parametrize("aggregate", ["high", "low"])
def test_late_rows_are_judged_again(spark, tmp_path, period, aggregate):
    rng = random.Random(4)
    sign = 1 if aggregate == "high" else -1
    data = [("rs"[i % 2], at(5 * (i // 2)), sign * round(rng.uniform(1, 300) + i / 4, 1), i) for i in range(1600)]
    df = frame(spark, "record_id string, interval timestamp_ntz, value double, n int", *data)
    df = df.select("record_id", "interval", "value", F.lit(aggregate).alias("aggregate"), F.lit(period).alias("period"), F.lit(0).alias("digits"), "n")
    path = str(tmp_path)
    first, second = (F.col("n") % 11 != 0) & (F.col("n") > 500), (F.col("n") % 11 != 0) & (F.col("n") <= 500)
    arrived = []
    for part, keep in ((first, lambda n: n % 11 and n > 500), (second, lambda n: n % 11 and n <= 500), (F.col("n") % 11 == 0, lambda n: n % 11 == 0)):
        df.filter(part).write.mode("append").parquet(f"{path}/in")
        stream = J.stream_table(spark, f"{path}/in", df.schema).drop("n")
        J.start_records(stream, f"{path}/out", f"{path}/cp", trigger=ONCE).awaitTermination()
        arrived += [d for d in data if keep(d[3])]
        want = fold([(k, t, sign * v) for k, t, v, _ in arrived], 3000 if period == "interval" else 1)
        got = J.read_records(spark, f"{path}/out").select("record_id", "interval", "value", "previous_interval")
        assert rows(got) == sorted([(k, t, sign * v, last) for k, t, v, last in want], key=repr)
    withdrawn = spark.read.parquet(f"{path}/out").filter("NOT kept")
    assert withdrawn.count() > 0


def test_rows_that_can_be_records_are_enough():
    """Whatever stands before a day, chaining the rows found gives what chaining all of them does."""
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.integers(1, 60))
        at_ = np.sort(rng.choice(288, n, replace=False)) * 300_000_000
        value, gap = rng.integers(0, 12, n).astype(float), int(rng.choice([0, 600, 3000, 90_000])) * 1_000_000
        found, stands = followers(at_, value, gap)

        def chain(rows, standing, last, at_=at_, value=value, gap=gap):
            out = []
            for i in rows:
                if value[i] > standing and (last is None or at_[i] - last >= gap):
                    out.append(int(i))
                    standing, last = value[i], at_[i]
            return out, standing

        for standing, last in [(-np.inf, None)] + [(float(rng.integers(-1, 12)), -int(rng.integers(1, 4000)) * 1_000_000) for _ in range(6)]:
            whole, end = chain(range(n), standing, last)
            assert whole == chain(found, standing, last)[0], trial
            assert end >= stands, trial


def test_a_late_price_mends_the_days_of_a_gap(spark, tmp_path):
    """Prices of day 1 come last; days 2 to 4 have none, day 5 has one at noon."""
    s = "event_id long, " + SCHEMA.split(", ", 1)[1]
    df = frame(spark, s, *[(i, at(60 * i), "NEM", "C1", 60.0, 5.0, None, False) for i in range(24 * 6)])
    m = "interval timestamp_ntz, network_id string, network_region string, price double, is_forecast boolean"
    prices = frame(spark, m, (at(0), "NEM", "NSW1", 10.0, False), (at(60 * 24 * 4 + 720), "NEM", "NSW1", 70.0, False), (at(60 * 24), "NEM", "NSW1", None, False), (at(600), "NEM", "NSW1", 30.0, False))
    path = str(tmp_path)
    rewritten = []
    for part in (F.col("interval") != F.lit(at(600)).cast("timestamp_ntz"), F.col("interval") == F.lit(at(600)).cast("timestamp_ntz")):
        prices.filter(part).write.mode("append").parquet(f"{path}/market")
        df.write.mode("ignore").parquet(f"{path}/in")
        telemetry, published = J.stream_table(spark, f"{path}/in", df.schema), J.stream_table(spark, f"{path}/market", prices.schema)

        def fact(seen, known, first, last, number):
            rewritten.append((first, last))
            return E.unit_intervals(seen, known, units(spark), first, last, version=number, chunk="day", carry_in=True)

        J.start_facts_of_both(
            telemetry, published, ["interval", "network_id", "network_region"], fact, f"{path}/store", f"{path}/known", f"{path}/fact", f"{path}/cp", trigger=ONCE
        ).awaitTermination()
    got = spark.read.parquet(f"{path}/fact")
    want = E.unit_intervals(df, prices, units(spark), at(0), at(60 * 24 * 6)).drop("version")
    assert rows(got.select(*sorted(want.columns))) == rows(want.select(*sorted(want.columns)))
    assert rewritten[-1] == (at(0), at(60 * 24 * 5)), "day 6 has its price from day 5 and stays"
    assert {r[0] for r in got.filter(F.dayofmonth("interval") == 6).select("version").distinct().collect()} == {0}


def test_the_first_to_arrive_wins(spark, tmp_path):
    s = "k string, t timestamp_ntz, v int, n int"
    df = frame(spark, s, ("a", at(0), 9, 4), ("a", at(0), 2, 3), ("b", at(5), 3, 1), ("a", at(0), 1, 0), ("c", at(0), None, 9), ("c", at(0), 5, 8))
    path = str(tmp_path)
    for _ in batches(spark, path, df.repartition(3), [F.col("n") >= 3, F.col("n") < 3]):
        stream = J.stream_table(spark, f"{path}/in", df.schema)
        J.start_dedupe(stream, ["k", "t"], "t", f"{path}/out", f"{path}/cp", ["n"], trigger=ONCE).awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    assert rows(out.select("k", "v", "n", "arrived.batch")) == [("a", 2, 3, 0), ("b", 3, 1, 1), ("c", 5, 8, 0)]


def test_dealt_days_are_written_by_the_tasks_that_have_them(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), (20240101 + F.col("id") % 100).cast("int").alias(J.DAY))
    before = spark.conf.get(J.WRITERS)
    J.write_dealt_days(rows.coalesce(1), f"{tmp_path}/fact")
    J.write_dealt_days(rows.filter("id = 7"), f"{tmp_path}/fact")
    assert spark.conf.get(J.WRITERS) == before
    got = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/fact").collect())
    assert got == [n for n in range(200) if n != 107]
