from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from wattframe.operators import enrich as E
from wattframe.operators import flows as X
from wattframe.operators import ingest as I

UNITS = (
    "unit_code string, facility_code string, network_id string, network_region string, fueltech_id string, "
    "fueltech_group_id string, renewable boolean, status_id string, emissions_factor_co2 double, interconnector boolean, "
    "interconnector_region_from string, interconnector_region_to string"
)
TELEMETRY = (
    "interval timestamp_ntz, network_id string, unit_code string, generated double, energy double, "
    "energy_storage double, is_forecast boolean"
)
MARKET = (
    "interval timestamp_ntz, network_id string, network_region string, price double, price_dispatch double, demand double, "
    "demand_total double, ss_solar_uigf double, ss_solar_clearedmw double, ss_wind_uigf double, ss_wind_clearedmw double, "
    "is_forecast boolean"
)


def units(spark):
    return frame(
        spark,
        UNITS,
        ("COAL", "F1", "NEM", "NSW1", "coal_black", "coal", False, "operating", 0.9, False, None, None),
        ("WIND", "F2", "NEM", "NSW1", "wind", "wind", True, "operating", None, False, None, None),
        ("BATT", "F3", "NEM", "NSW1", "battery", "battery", False, "operating", None, False, None, None),
        ("ROOF", "F4", "AEMO_ROOFTOP", "NSW1", "solar_rooftop", "solar", True, "operating", None, False, None, None),
        ("TUMUT3", "F5", "NEM", "NSW1", "hydro", "hydro", True, "operating", None, False, None, None),
    )


def reading(minute, unit, mw, network="NEM", per=12, forecast=False):
    return (at(minute), network, unit, mw, None if mw is None else mw / per, None, forecast)


def price(minute, region="NSW1", p=100.0, network="NEM", demand=6000.0, total=6600.0):
    return (at(minute), network, region, p, None, demand, total, 30.0, 6.0, 200.0, 80.0, False)


def test_unit_fact(spark):
    telemetry = frame(
        spark,
        TELEMETRY,
        reading(0, "COAL", 120.0),
        reading(0, "COAL", 12.0),
        reading(0, "WIND", -6.0),
        reading(0, "BATT", -24.0),
        reading(5, "COAL", 240.0, forecast=True),
        reading(10, "COAL", 60.0),
        reading(-30, "ROOF", 60.0, "AEMO_ROOFTOP", 2),
        reading(15, "COAL", 60.0),
    )
    market = frame(spark, MARKET, price(0), price(10, p=None))
    out = E.unit_intervals(telemetry, market, units(spark), at(0), at(15))
    got = {(r.unit_code, r.interval): r for r in out.collect()}
    coal = got["COAL", at(0)]
    assert (coal.generated, coal.energy, coal.emissions, coal.market_value) == (132.0, 11.0, 9.9, 1100.0)
    # Draw of a one-way unit is floored, of a battery it is not; neither earns.
    assert got["WIND", at(0)].generated == 0.0
    assert (got["BATT", at(0)].generated, got["BATT", at(0)].emissions, got["BATT", at(0)].market_value) == (-24.0, 0.0, 0.0)
    # The price is carried over its hole; the end is excluded.
    assert got["COAL", at(10)].market_value == 500.0
    assert ("COAL", at(15)) not in got and ("COAL", at(5)) not in got
    # The rooftop reading before the window holds for one half-hour block only.
    assert not [k for k in got if k[0] == "ROOF"]


def test_rooftop_is_carried_with_rescaled_energy(spark):
    telemetry = frame(spark, TELEMETRY, reading(-30, "ROOF", 60.0, "AEMO_ROOFTOP", 2), reading(0, "ROOF", 120.0, "AEMO_ROOFTOP", 2))
    out = E.unit_intervals(telemetry, frame(spark, MARKET, price(0)), units(spark), at(0), at(60))
    got = rows(out.select("interval", "generated", "energy", "market_value"), "interval")
    assert [g[0] for g in got] == [at(m) for m in range(0, 30, 5)]
    assert {g[1:] for g in got} == {(120.0, 10.0, 1000.0)}


def test_missing_price_gives_no_value(spark):
    telemetry = frame(spark, TELEMETRY, reading(0, "COAL", 120.0))
    out = E.unit_intervals(telemetry, frame(spark, MARKET, price(5)), units(spark), at(0), at(15)).first()
    assert out.market_value is None and out.emissions == 9.0


@pytest.mark.parametrize(("network", "scale"), [("NEM", 1), ("WEM", 6)])
def test_pair_energies(spark, network, scale):
    """A flat hour: 6000 MW over five minutes is 500 MWh, over thirty 3000."""
    names = {
        "demand": 6000.0,
        "demand_total": 6600.0,
        "rooftop_solar": 400.0,
        "renewable_generation": 1200.0,
        "storage_generation": 60.0,
        "curtailment_solar_total": 24.0,
        "curtailment_wind_total": 120.0,
    }
    schema = "network_id string, price double, " + ", ".join(f"{n} double, prev_{n} double" for n in names)
    df = frame(spark, schema, (network, 100.0, *[v for v in names.values() for _ in (0, 1)]))
    shaped = E.gross_and_renewable(E.gross_and_renewable(df), "prev_")
    rate = {"NEM": 12.0, "WEM": 2.0}[network]
    row = E.demand_value(E.pair_energy(shaped, E._PAIRS, F.lit(rate))).first()
    assert row.demand_energy == 500.0 * scale and row.demand_total_energy == 550.0 * scale
    assert row.demand_gross_energy == pytest.approx(583.3333 * scale, abs=1e-3)
    assert row.generation_renewable_energy == pytest.approx(133.3333 * scale, abs=1e-3)
    assert row.generation_renewable_with_storage_energy == pytest.approx(138.3333 * scale, abs=1e-3)
    assert row.curtailment_energy_solar_total == 2.0 * scale and row.curtailment_energy_wind_total == 10.0 * scale
    assert row.demand_market_value == 50_000.0 * scale


def test_market_fact(spark):
    telemetry = frame(
        spark,
        TELEMETRY,
        *[reading(m, "WIND", 600.0) for m in range(-60, 65, 5)],
        *[reading(m, "TUMUT3", 60.0) for m in range(-60, 65, 5)],
        *[reading(m, "ROOF", 400.0, "AEMO_ROOFTOP", 2) for m in (-60, -30, 0, 30)],
    )
    market = frame(spark, MARKET, *[price(m, p=100.0 if m % 30 == 0 else None) for m in range(-60, 65, 5)])
    out = {r.interval: r for r in E.market_summary(telemetry, market, units(spark), at(0), at(60)).collect()}
    assert min(out) == at(0) and max(out) == at(60)
    row = out[at(25)]
    assert (row.price, row.demand_energy, row.demand_gross) == (100.0, 500.0, 7000.0)
    assert (row.generation_renewable, row.generation_renewable_with_storage) == (1000.0, 1060.0)
    assert (row.curtailment_solar_total, row.curtailment_wind_total, row.curtailment_total) == (24.0, 120.0, 144.0)
    # Rooftop is held 25 minutes past its last reading, then counts as nothing.
    assert out[at(55)].demand_gross == 7000.0 and out[at(60)].demand_gross == 6600.0
    assert row.energy_imports is None


def test_trapezoid(spark):
    schema = "interval timestamp_ntz, network_id string, unit_code string, generated double, energy double, energy_quality_flag short"
    df = frame(
        spark,
        schema,
        (at(-5), "NEM", "A", 10.0, None, 0),
        (at(0), "NEM", "A", 20.0, None, 0),
        (at(15), "NEM", "A", 40.0, None, 0),
        (at(20), "NEM", "A", 40.0, 1.0, 2),
        (at(0), "WEM", "B", 1.0, None, 0),
        (at(5), "WEM", "B", 1.0, None, 0),
        (at(0), "NEM", "C", 5.0, None, 0),
    )
    got = rows(E.trapezoid_energy(df, at(0), at(60)), "interval")
    assert [(r[0], r[2], r[4], r[5]) for r in got] == [(at(0), "A", 1.25, 2), (at(15), "A", 2.5, 2)]


# --- flows ---------------------------------------------------------------------------------

EDGES = "interval timestamp_ntz, interconnector_region_from string, interconnector_region_to string, energy double"
NODES = "interval timestamp_ntz, network_region string, energy double, emissions double, emissions_intensity double"


def flow_case(spark, seed=3, n=30):
    rng = np.random.default_rng(seed)
    regions = X.NEM_REGIONS
    edges, nodes = [], []
    for i in range(n):
        for a, b in (("NSW1", "QLD1"), ("NSW1", "VIC1"), ("SA1", "VIC1"), ("TAS1", "VIC1"), ("SA1", "NSW1")):
            edges.append((at(5 * i), a, b, float(np.round(rng.uniform(-40, 40), 3))))
        for r in regions:
            e = float(np.round(rng.uniform(1, 90), 3))
            m = float(np.round(e * rng.uniform(0, 1), 3))
            nodes.append((at(5 * i), r, e, m, m / e))
    return frame(spark, EDGES, *edges), frame(spark, NODES, *nodes), edges, nodes


def test_negative_flow_turns(spark):
    edges = frame(spark, EDGES, (at(0), "NSW1", "VIC1", -5.0), (at(0), "NSW1", "QLD1", 3.0))
    got = {r.network_region: (r.energy_imports, r.energy_exports) for r in X.region_flows(edges).collect()}
    assert got == {"NSW1": (5.0, 3.0), "VIC1": (0.0, 5.0), "QLD1": (3.0, 0.0)}


def test_simple_flows_use_source_intensity(spark):
    edges = frame(spark, EDGES, (at(0), "VIC1", "NSW1", 10.0), (at(0), "TAS1", "VIC1", 4.0))
    nodes = frame(spark, NODES, (at(0), "VIC1", 100.0, 90.0, 0.9))
    got = {r.network_region: r for r in X.solve_flows(edges, nodes).collect()}
    assert got["NSW1"].emissions_imports == pytest.approx(9.0) and got["VIC1"].emissions_exports == pytest.approx(9.0)
    assert got["VIC1"].emissions_imports == 0.0


def test_mix_flows_match_a_plain_solve(spark):
    edges, nodes, edge_rows, node_rows = flow_case(spark)
    got = {(r.interval, r.network_region): r for r in X.solve_flows(edges, nodes, mix=True).collect()}
    regions = list(X.NEM_REGIONS)
    for moment in {e[0] for e in edge_rows}:
        flow = np.zeros((5, 5))
        for t, a, b, v in edge_rows:
            if t == moment:
                i, j = (regions.index(a), regions.index(b)) if v >= 0 else (regions.index(b), regions.index(a))
                flow[i, j] += abs(v)
        energy, out = np.zeros(5), np.zeros(5)
        for t, r, e, m, _ in node_rows:
            if t == moment:
                energy[regions.index(r)], out[regions.index(r)] = e, m
        x = np.linalg.lstsq(np.diag(energy + flow.sum(axis=0)) - flow.T, out, rcond=None)[0].clip(0)
        for i, r in enumerate(regions):
            row = got[moment, r]
            assert row.emissions_exports == pytest.approx(flow[i].sum() * x[i], abs=1e-6)
            assert row.emissions_imports == pytest.approx((flow[:, i] * x).sum(), abs=1e-6)


@pytest.mark.parametrize("mix", [False, True])
def test_imports_balance_exports(spark, mix):
    edges, nodes, *_ = flow_case(spark, 5)
    sums = X.solve_flows(edges, nodes, mix).agg(
        *[F.sum(c) for c in ("energy_imports", "energy_exports", "emissions_imports", "emissions_exports")]
    ).first()
    assert sums[0] == pytest.approx(sums[1]) and sums[2] == pytest.approx(sums[3])


def test_idle_regions_do_not_break_the_solve(spark):
    nodes = frame(spark, NODES, (at(0), "NSW1", 0.0, 0.0, 0.0))
    edges = frame(spark, EDGES, (at(5), "NSW1", "QLD1", 1.0))
    got = X.flow_emissions_mix(edges, nodes).collect()
    assert len(got) == 5 and all(r.energy_imports == 0 and r.emissions_exports == 0 for r in got)


def test_a_sixth_region_keeps_its_flows(spark):
    edges = frame(spark, EDGES, (at(0), "NSW1", "SNOWY1", 10.0))
    nodes = frame(spark, NODES, (at(0), "NSW1", 100.0, 50.0, 0.5))
    got = {r.network_region: r for r in X.solve_flows(edges, nodes, mix=True).collect()}
    assert got["NSW1"].energy_exports == got["SNOWY1"].energy_imports == 10.0
    assert got["SNOWY1"].emissions_imports == pytest.approx(5.0)


def test_a_network_of_many_parts_is_solved_part_by_part(spark):
    """Rings, a chain, a lone region and repeated rows, against one dense solve of each interval."""
    rng = np.random.default_rng(11)
    links = [(f"R{i:02}", f"R{(i + 1) % 7:02}") for i in range(7)] + [("S1", "S2"), ("S2", "S3"), ("S1", "S2")]
    names = sorted({n for link in links for n in link} | {"LONE"})
    edge_rows = [(at(5 * i), a, b, float(rng.uniform(-40, 40))) for i in range(25) for a, b in links]
    node_rows = [(at(5 * i), r, float(rng.uniform(1, 90)), float(rng.uniform(0, 50)), 0.0) for i in range(25) for r in [*names, "S1"]]
    extra = [(at(0), None, "S1", 5.0), (at(0), "S1", "S1", 5.0)]
    out = X.flow_emissions_mix(frame(spark, EDGES, *edge_rows, *extra), frame(spark, NODES, *node_rows, (at(0), None, 1.0, 1.0, 1.0)), regions=())
    got = {(r.interval, r.network_region): r for r in out.collect()}
    assert len(got) == 25 * len(names)
    where = {r: i for i, r in enumerate(names)}
    for moment in {e[0] for e in edge_rows}:
        flow, energy, out = np.zeros((len(names),) * 2), np.zeros(len(names)), np.zeros(len(names))
        for _, a, b, v in [e for e in edge_rows if e[0] == moment]:
            i, j = (where[a], where[b]) if v >= 0 else (where[b], where[a])
            flow[i, j] += abs(v)
        for _, r, e, m, _ in [x for x in node_rows if x[0] == moment]:
            energy[where[r]] += e
            out[where[r]] += m
        x = np.linalg.solve(np.diag(energy + flow.sum(axis=0)) - flow.T, out)
        for r, i in where.items():
            row = got[moment, r]
            assert row.energy_imports == pytest.approx(flow[:, i].sum()) and row.energy_exports == pytest.approx(flow[i].sum())
            assert row.emissions_exports == pytest.approx(flow[i].sum() * x[i]) and row.emissions_imports == pytest.approx((flow[:, i] * x).sum())


def test_no_nodes_give_no_mix(spark):
    assert X.flow_emissions_mix(frame(spark, EDGES, (at(0), "NSW1", "QLD1", 1.0)), frame(spark, NODES)).count() == 0


# --- ingest -------------------------------------------------------------------------------------


def test_battery_split(spark):
    schema = "interval timestamp_ntz, unit_code string, generated double, energy double"
    df = frame(spark, schema, (at(0), "B1", -50.0, -4.0), (at(5), "B1", 75.0, 6.0), (at(10), "B1", -25.0, -2.0), (at(0), "X", -1.0, 0.0))
    unit_map = frame(spark, "unit string, charge_unit string, discharge_unit string", ("B1", "B1L", "B1G"))
    got = rows(I.split_bidirectional(df, unit_map).select("unit_code", "generated"))
    assert got == sorted([("B1", -50.0), ("B1L", 50.0), ("B1", 75.0), ("B1G", 75.0), ("B1", -25.0), ("B1L", 25.0), ("X", -1.0)], key=repr)


def test_unit_map_rules(spark):
    schema = "facility_code string, unit_code string, fueltech_id string, dispatch_type string"
    df = frame(
        spark,
        schema,
        ("A", "A1", "battery", "BIDIRECTIONAL"),
        ("B", "B1", "battery", "BIDIRECTIONAL"),
        ("B", "B1L1", "battery_charging", "LOAD"),
        ("B", "B1G1", "battery_discharging", "GENERATOR"),
        ("C", "C1", "battery", "BIDIRECTIONAL"),
        ("C", "C1X", "battery_charging", "LOAD"),
        ("C", "C1Y", "battery_charging", "LOAD"),
        ("C", "C1Z", "battery_discharging", "GENERATOR"),
        ("D", "D1", "wind", "GENERATOR"),
        ("E", "LVES1", "battery", "BIDIRECTIONAL"),
    )
    got = {r.unit: (r.charge_unit, r.discharge_unit) for r in I.build_unit_map(df).collect()}
    assert got["A1"] == ("A1L", "A1G") and got["B1"] == ("B1L1", "B1G1")
    assert "C1" not in got and "D1" not in got
    assert got["LVES1"] == ("LVESL1", "LVESG1")


def test_cadence_and_derivation(spark):
    schema = "file string, t timestamp_ntz"
    thirty = [("a", at(30 * i)) for i in range(6)] + [("a", at(61))]
    odd = [("b", at(7 * i)) for i in range(6)]
    five = [("c", at(24 * 60 - 10 + 5 * i)) for i in range(5)]
    df = frame(spark, schema, *thirty, *odd, *five, ("d", at(0)))
    got = {r[0]: r[1] for r in I.detect_cadence(df, "t", ["file"]).collect()}
    assert got == {"a": 30, "b": 30, "c": 5, "d": 30}
    names = "power double, generated_scheduled double, generated_non_scheduled double, eoi_quantity double, interval_minutes int"
    cases = frame(spark, names, (None, None, None, 10.0, 30), (5.0, 1.0, None, None, 30), (None, 1.0, 2.0, None, 5), (0.0, None, None, None, 5))
    assert [(r.generated, r.energy) for r in I.derive_power_energy(cases).collect()] == [(20.0, 10.0), (5.0, 2.5), (3.0, None), (0.0, 0.0)]


def test_telemetry_keeps_last_duplicate(spark):
    schema = "settlementdate string, duid string, scadavalue string, n int"
    df = frame(spark, schema, ("2024/01/01 00:05:00", "A", "12", 1), ("2024/01/01 00:05:00", "A", "bad", 2), ("2024/01/01 00:10:00", "A", "24", 3))
    got = rows(I.to_telemetry(df, order="n").select("interval", "generated", "energy"), "interval")
    assert got == [(at(5), 0.0, 0.0), (at(10), 24.0, 2.0)]


def test_curtailment_needs_all_fields(spark):
    df = frame(spark, "settlementdate timestamp_ntz, regionid string, netinterchange double, totaldemand double, demand_and_nonschedgen double, n int", (at(0), "NSW1", 1.0, 2.0, 3.0, 1))
    demand, curtailed = I.region_summary(df, "n")
    assert curtailed is None and demand.first().demand_total == 3.0


def test_region_factor_limit(spark):
    with pytest.raises(ValueError):
        E.region_factor(None, None, timedelta(minutes=5), datetime(2024, 1, 1), datetime(2024, 2, 1))


def test_prices_are_joined_before_rows_are_repeated(spark):
    from wattframe.plans.enrich_plans import unit_fact
    from wattframe.plans.tables import Tables

    plan = unit_fact(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(") < plan.index("Join")


def test_priced_steps_over_midnight_and_for_two_networks_of_a_region(spark):
    def at(day, hour, minute=0):
        return datetime(2024, 1, day, hour, minute)

    rows = [("U1", "R", at(1, 23, 50), at(2, 0, 5)), ("U2", "Q", at(1, 0), at(1, 0)), ("U3", None, at(1, 0), at(1, 0, 5))]
    rows = spark.createDataFrame(rows, "unit_code string, network_region string, interval timestamp_ntz, _until timestamp_ntz")
    prices = [(at(1, 23, 55), "R", 1.0), (at(2, 0), "R", 2.0), (at(2, 0, 5), "R", 3.0), (at(2, 0, 5), "R", 4.0)]
    prices = spark.createDataFrame(prices, "interval timestamp_ntz, network_region string, price double")
    got = sorted((r.unit_code, r.interval, r.price) for r in E.priced_steps(rows, prices).collect() if r.unit_code == "U1")
    assert got == [
        ("U1", at(1, 23, 50), None),
        ("U1", at(1, 23, 55), 1.0),
        ("U1", at(2, 0), 2.0),
        ("U1", at(2, 0, 5), 3.0),
        ("U1", at(2, 0, 5), 4.0),
    ]
    rest = sorted((r.unit_code, r.interval, r.price) for r in E.priced_steps(rows, prices).collect() if r.unit_code != "U1")
    assert rest == [("U2", at(1, 0), None), ("U3", at(1, 0), None), ("U3", at(1, 0, 5), None)]


def test_steps_of_a_day_lie_in_few_tasks(spark):
    def at(day, hour, minute=0):
        return datetime(2024, 1, day, hour, minute)

    rows = [(f"U{n}", "R", at(1, 22), at(4, 2)) for n in range(40)]
    rows = spark.createDataFrame(rows, "unit_code string, network_region string, interval timestamp_ntz, _until timestamp_ntz")
    prices = spark.createDataFrame([(at(2, 0), "R", 2.0)], "interval timestamp_ntz, network_region string, price double")
    steps = E.priced_steps(rows, prices, 4, "day")
    assert steps.count() == 40 * (24 + 288 + 288 + 25)
    told = steps.select("day", F.to_date("interval").alias("date"), F.spark_partition_id().alias("task")).distinct().collect()
    assert sorted((r.day, r.date.day) for r in told) == [(20240101 + n, 1 + n) for n in range(4)]
    assert len({r.task for r in told}) == 4
    one_day = E.priced_steps(rows.withColumn("_until", F.col("interval")), prices, 1)
    assert one_day.select(F.spark_partition_id()).distinct().count() == 4


def test_prices_are_carried_from_one_read_of_the_market(spark, tmp_path):
    def at(day, hour, minute=0):
        return datetime(2024, 1, day, hour, minute)

    given = [(at(1, 9), 1.0), (at(1, 8), 9.0), (at(2, 0, 5), None), (at(2, 0, 10), 3.0), (at(2, 0, 12), 5.0)]
    given = spark.createDataFrame([(t, "NEM", "R", p) for t, p in given], "interval timestamp_ntz, network_id string, network_region string, price double")
    given.write.parquet(f"{tmp_path}/market")
    out = E.carried_prices(spark.read.parquet(f"{tmp_path}/market"), at(2, 0), at(2, 0, 20), "day", carry_in=True)
    assert out.inputFiles() == []
    assert sorted((r.interval.minute, r.price) for r in out.collect()) == [(0, 1.0), (5, 1.0), (10, 4.0), (15, 4.0)]
