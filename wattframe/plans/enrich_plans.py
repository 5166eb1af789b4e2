"""The enriched facts and the rules they are made of."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattframe.functions.timebucket import guard_intervals
from wattframe.operators import enrich as E
from wattframe.operators.flows import edge_energy, flow_emissions
from wattframe.plans.catalog import query
from wattframe.plans.sqltext import line, r4
from wattframe.plans.tables import END, START, Tables

_SPAN = "range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)"
_EARLY = "range(TIMESTAMP '2023-12-31 23:00:00', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)"


def keyed_telemetry(t: Tables):
    """Telemetry with its primary key honoured and an unsettled quality flag."""
    return (
        t.telemetry()
        .filter(~F.col("is_forecast"))
        .groupBy("interval", "network_id", "unit_code")
        .agg(F.round(F.sum("generated"), 2).alias("generated"), F.max("event_id").alias("n"))
        .select(
            "interval",
            "network_id",
            "unit_code",
            "generated",
            F.lit(None).cast("double").alias("energy"),
            F.when(F.col("n") % 9 == 0, 2).otherwise(0).cast("short").alias("energy_quality_flag"),
        )
    )


_KEYED = """keyed AS (
        SELECT interval, network_id, unit_code, round(sum(generated), 2) AS generated,
            CASE WHEN max(event_id) % 9 = 0 THEN 2 ELSE 0 END AS flag
        FROM x_telemetry WHERE NOT is_forecast GROUP BY 1, 2, 3)"""


@query(
    "e1_trapezoid_energy",
    f"""WITH {_KEYED}, paired AS (
            SELECT *, lag(generated) OVER (PARTITION BY network_id, unit_code ORDER BY interval) AS prev
            FROM keyed WHERE network_id NOT IN ('WEM', 'WEMDE', 'AEMO_ROOFTOP_BACKFILL')
                AND interval BETWEEN TIMESTAMP '2023-12-31 23:55:00' AND TIMESTAMP '2024-01-31')
        SELECT interval, network_id, unit_code, generated,
            (generated + prev) / 2 / (60 / CASE network_id WHEN 'AEMO_ROOFTOP' THEN 30.0::DOUBLE ELSE 5.0::DOUBLE END) AS energy,
            2 AS energy_quality_flag
        FROM paired WHERE prev IS NOT NULL AND flag < 2""",
)
def _trapezoid(t: Tables):
    return E.trapezoid_energy(keyed_telemetry(t), START, END, chunk="day")


_PRICED = f"""act AS (SELECT * FROM x_telemetry WHERE NOT is_forecast),
    published AS (SELECT interval, network_id, network_region, avg(price) AS price FROM x_market
        WHERE price IS NOT NULL GROUP BY 1, 2, 3),
    prices AS (
        SELECT network_id, network_region, interval,
            last_value(price IGNORE NULLS) OVER (PARTITION BY network_id, network_region ORDER BY interval) AS price
        FROM (SELECT network_id, network_region, r.interval AS interval
                FROM (SELECT DISTINCT network_id, network_region FROM published), {_SPAN})
            LEFT JOIN published USING (network_id, network_region, interval))"""

_TWO_WAY = "('battery', 'battery_charging', 'battery_discharging', 'pumps')"

_UNIT_FACT = f"""{_PRICED},
    plain AS (
        SELECT a.interval, a.network_id, u.network_region, u.facility_code, unit_code, u.status_id, u.fueltech_id,
            u.fueltech_group_id, u.renewable, emissions_factor_co2,
            CASE WHEN fueltech_id IN {_TWO_WAY} THEN {r4("sum(generated)")} ELSE greatest({r4("sum(generated)")}, 0) END AS generated,
            CASE WHEN fueltech_id IN {_TWO_WAY} THEN {r4("sum(energy)")} ELSE greatest({r4("sum(energy)")}, 0) END AS energy,
            {r4("sum(energy_storage)")} AS energy_storage
        FROM act a JOIN x_units u USING (unit_code)
        WHERE fueltech_id NOT IN ('solar_rooftop', 'imports', 'exports', 'interconnector')
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
    half AS (
        SELECT interval, a.network_id, unit_code, coalesce({r4("sum(generated)")}, 0) AS generated,
            coalesce({r4("sum(energy) / 6")}, 0) AS energy
        FROM act a JOIN x_units u USING (unit_code) WHERE fueltech_id = 'solar_rooftop' GROUP BY 1, 2, 3),
    ends AS (SELECT network_id, unit_code, min(interval) AS lo, max(interval) AS hi FROM half GROUP BY 1, 2),
    held AS (
        SELECT network_id, unit_code, interval,
            last_value(generated IGNORE NULLS) OVER w AS generated, last_value(energy IGNORE NULLS) OVER w AS energy
        FROM (SELECT network_id, unit_code, r.interval AS interval FROM ends, {_SPAN}
                WHERE r.interval >= lo AND r.interval <= hi + INTERVAL 25 MINUTES)
            LEFT JOIN half USING (network_id, unit_code, interval)
        WINDOW w AS (PARTITION BY network_id, unit_code ORDER BY interval)),
    both_kinds AS (
        SELECT interval, network_id, network_region, facility_code, unit_code, status_id, fueltech_id, fueltech_group_id,
            renewable, emissions_factor_co2, generated, energy, energy_storage FROM plain
        UNION ALL
        SELECT interval, h.network_id, network_region, facility_code, unit_code, status_id, fueltech_id, 'solar', true,
            emissions_factor_co2, generated, energy, NULL FROM held h JOIN x_units u USING (unit_code)),
    unit_fact AS (
        SELECT b.interval, b.network_id, b.network_region, facility_code, unit_code, status_id, fueltech_id,
            fueltech_group_id, renewable, generated, energy, energy_storage,
            CASE WHEN energy > 0 THEN coalesce({r4("emissions_factor_co2 * energy")}, 0) ELSE 0 END AS emissions,
            CASE WHEN energy > 0 THEN coalesce({r4("emissions_factor_co2")}, 0) ELSE 0 END AS emission_factor,
            CASE WHEN energy > 0 THEN {r4("energy * p.price")} ELSE 0 END AS market_value, 0 AS version
        FROM both_kinds b LEFT JOIN prices p ON p.interval = b.interval AND p.network_region = b.network_region)"""


def unit_fact(t: Tables):
    return E.unit_intervals(t.telemetry(), t.market(), t.units(), START, END, chunk="day")


@query("e2_unit_intervals", f"WITH {_UNIT_FACT} SELECT * FROM unit_fact")
def _unit_intervals(t: Tables):
    return unit_fact(t)


@query(
    "e2_unit_intervals_one_network",
    f"WITH {_UNIT_FACT} SELECT * FROM unit_fact WHERE network_id = 'NEM'",
)
def _one_network(t: Tables):
    return E.unit_intervals(t.telemetry(), t.market(), t.units(), START, END, networks=["NEM"], chunk="day")


@query(
    "e15_guard",
    """WITH s AS (SELECT network_id, min(interval) AS lo, max(interval) AS hi FROM x_telemetry GROUP BY 1)
        SELECT network_id, minutes, date_diff('minute', lo, hi) // minutes AS intervals, date_diff('minute', lo, hi) / minutes <= 1000 AS allowed
        FROM s, (VALUES (5::BIGINT), (30), (60), (1440)) AS step(minutes)""",
)
def _guard(t: Tables):
    """A request for the whole span of each network at several steps: how many intervals it has, and whether it may pass."""
    spans = t.telemetry().groupBy("network_id").agg(F.min("interval").alias("lo"), F.max("interval").alias("hi")).collect()

    def asked(network: str, lo: datetime, hi: datetime, minutes: int) -> tuple:
        step = timedelta(minutes=minutes)
        try:
            guard_intervals(lo, hi, step)
        except ValueError:
            return network, minutes, (hi - lo) // step, False
        return network, minutes, (hi - lo) // step, True

    rows = [asked(*s, minutes) for s in spans for minutes in (5, 30, 60, 1440)]
    return t.spark.createDataFrame(rows, "network_id string, minutes long, intervals long, allowed boolean")


@query(
    "e3_emissions",
    f"""SELECT event_id, CASE WHEN generated > 0 THEN coalesce({r4("emissions_factor_co2 * generated")}, 0) ELSE 0 END AS emissions,
            CASE WHEN generated > 0 THEN coalesce({r4("emissions_factor_co2")}, 0) ELSE 0 END AS emission_factor
        FROM x_signed JOIN x_units USING (unit_code)""",
)
def _emissions(t: Tables):
    rows = t.signed().join(t.units().select("unit_code", "emissions_factor_co2"), "unit_code")
    energy, factor = F.col("generated"), F.col("emissions_factor_co2")
    return rows.select(
        "event_id",
        E.emissions(energy, factor).alias("emissions"),
        E.emission_factor(energy, factor).alias("emission_factor"),
    )


@query(
    "e4_market_value",
    f"""WITH {_PRICED} SELECT event_id, CASE WHEN s.generated > 0 THEN {r4("s.generated * p.price")} ELSE 0 END AS market_value
        FROM x_signed s JOIN x_units u USING (unit_code)
            LEFT JOIN prices p ON p.interval = s.interval AND p.network_region = u.network_region""",
)
def _value(t: Tables):
    rows = t.signed().join(t.units().select("unit_code", "network_region"), "unit_code")
    prices = E.carried_prices(t.market(), START, END, chunk="day").select("interval", "network_region", "price")
    priced = rows.join(prices, ["interval", "network_region"], "left")
    return priced.select("event_id", E.market_value(F.col("generated"), F.col("price")).alias("market_value"))


_CURTAILED = f"""avg({r4("ss_solar_uigf - ss_solar_clearedmw")}) AS curtailment_solar_total,
            avg({r4("ss_wind_uigf - ss_wind_clearedmw")}) AS curtailment_wind_total"""

_MARKET_FACT = f"""act AS (SELECT * FROM x_telemetry WHERE NOT is_forecast),
    base AS (SELECT interval, network_id, network_region, avg(coalesce(price_dispatch, price)) AS pd, avg(price) AS pt,
            avg(demand) AS demand, avg(demand_total) AS demand_total, {_CURTAILED}
        FROM x_market GROUP BY 1, 2, 3),
    regions AS (SELECT DISTINCT network_id, network_region FROM base),
    steps AS (SELECT r.interval AS interval FROM {_EARLY}),
    gd AS (
        SELECT network_id, network_region, interval, demand, demand_total, curtailment_solar_total, curtailment_wind_total,
            last_value(pd IGNORE NULLS) OVER w AS pd, last_value(pt IGNORE NULLS) OVER w AS pt
        FROM (SELECT * FROM regions, steps) LEFT JOIN base USING (network_id, network_region, interval)
        WINDOW w AS (PARTITION BY network_id, network_region ORDER BY interval)),
    rt AS (SELECT interval, u.network_region, round(avg(generated), 9) AS rooftop FROM act JOIN x_units u USING (unit_code)
        WHERE fueltech_id = 'solar_rooftop' AND u.network_region IN (SELECT network_region FROM regions) GROUP BY 1, 2),
    rt_grid AS (
        SELECT network_region, interval, rooftop, max(CASE WHEN rooftop IS NOT NULL THEN interval END)
                OVER (PARTITION BY network_region) AS hi,
            last_value(rooftop IGNORE NULLS) OVER (PARTITION BY network_region ORDER BY interval) AS held,
            {line("rooftop", "network_region")} AS line
        FROM (SELECT network_region, interval FROM (SELECT DISTINCT network_region FROM rt), steps)
            LEFT JOIN rt USING (network_region, interval)),
    rd AS (SELECT 'NEM' AS network_id, network_region, interval,
            coalesce(line, CASE WHEN interval <= hi + INTERVAL 25 MINUTES THEN held END) AS rooftop_solar FROM rt_grid),
    gr AS (SELECT interval, u.network_id, u.network_region,
            round(sum(CASE WHEN fueltech_id IN ('bioenergy_biogas', 'bioenergy_biomass', 'hydro', 'solar_utility', 'wind',
                'battery_discharging', 'pumps') THEN greatest(generated, 0) ELSE 0 END), 6) AS renewable_generation
        FROM act JOIN x_units u USING (unit_code)
        WHERE u.network_id IN (SELECT network_id FROM regions) GROUP BY 1, 2, 3),
    rn AS (
        SELECT network_id, network_region, interval,
            {line("renewable_generation", "network_id, network_region")} AS renewable_generation
        FROM (SELECT network_id, network_region, interval
                FROM (SELECT DISTINCT network_id, network_region FROM gr), steps)
            LEFT JOIN gr USING (network_id, network_region, interval)),
    wt AS (SELECT interval, round(sum(generated), 6) AS total FROM act JOIN x_units u USING (unit_code)
        WHERE u.network_id = 'WEM' GROUP BY 1),
    wg AS (SELECT interval, 'WEM' AS network_id, {line("total", "")} AS total
        FROM (SELECT interval FROM steps WHERE EXISTS (SELECT 1 FROM wt)) LEFT JOIN wt USING (interval)),
    joined AS (
        SELECT interval, network_id, network_region,
            CASE WHEN network_id = 'WEM' THEN pd ELSE pt END AS price,
            CASE WHEN network_id = 'WEM' THEN coalesce(demand, total) ELSE demand END AS demand,
            CASE WHEN network_id = 'WEM' THEN coalesce(demand_total, total) ELSE demand_total END AS demand_total,
            coalesce(rooftop_solar, 0) AS rooftop_solar, coalesce(renewable_generation, 0) AS renewable_generation,
            0::DOUBLE AS storage_generation, curtailment_solar_total AS cs, curtailment_wind_total AS cw
        FROM gd FULL JOIN rd USING (interval, network_id, network_region)
            FULL JOIN rn USING (interval, network_id, network_region)
            LEFT JOIN wg USING (interval, network_id)),
    lagged AS (
        SELECT *, lag(demand) OVER w AS p_demand, lag(demand_total) OVER w AS p_demand_total,
            coalesce(lag(rooftop_solar) OVER w, 0) AS p_rooftop, coalesce(lag(renewable_generation) OVER w, 0) AS p_green,
            coalesce(lag(cs) OVER w, 0) AS p_cs, coalesce(lag(cw) OVER w, 0) AS p_cw,
            CASE network_id WHEN 'WEM' THEN 2 ELSE 12 END AS iph
        FROM joined WINDOW w AS (PARTITION BY network_id, network_region ORDER BY interval)),
    gross AS (
        SELECT * REPLACE (coalesce(cs, 0) AS cs, coalesce(cw, 0) AS cw),
            {r4("demand_total + rooftop_solar")} AS demand_gross, {r4("p_demand_total + p_rooftop")} AS p_demand_gross,
            {r4("renewable_generation + rooftop_solar")} AS generation_renewable, {r4("p_green + p_rooftop")} AS p_gr
        FROM lagged WHERE interval >= TIMESTAMP '2024-01-01'),
    energies AS (
        SELECT *, {r4("(demand + p_demand) / 2 / iph")} AS demand_energy,
            {r4("(demand_total + p_demand_total) / 2 / iph")} AS demand_total_energy,
            {r4("(demand_gross + p_demand_gross) / 2 / iph")} AS demand_gross_energy,
            {r4("(generation_renewable + p_gr) / 2 / iph")} AS generation_renewable_energy,
            {r4("(cs + p_cs) / 2 / iph")} AS ces, {r4("(cw + p_cw) / 2 / iph")} AS cew
        FROM gross),
    market_fact AS (
        SELECT interval, network_id, network_region, price, demand, demand_total, demand_gross, generation_renewable,
            demand_energy, demand_total_energy, demand_gross_energy, generation_renewable_energy,
            {r4("demand_energy * price")} AS demand_market_value,
            {r4("demand_total_energy * price")} AS demand_total_market_value,
            {r4("demand_gross_energy * price")} AS demand_gross_market_value,
            cs AS curtailment_solar_total, cw AS curtailment_wind_total, cs + cw AS curtailment_total,
            ces AS curtailment_energy_solar_total, cew AS curtailment_energy_wind_total,
            {r4("ces + cew")} AS curtailment_energy_total,
            generation_renewable AS generation_renewable_with_storage,
            generation_renewable_energy AS generation_renewable_with_storage_energy, 0 AS version
        FROM energies)"""


def market_fact(t: Tables, flows=None):
    return E.market_summary(t.telemetry(), t.market(), t.units(), START, END, flows, chunk="day")


@query(
    "e5_market_summary",
    f"""WITH {_MARKET_FACT} SELECT *, NULL::DOUBLE AS energy_imports, NULL::DOUBLE AS energy_exports,
            NULL::DOUBLE AS emissions_imports, NULL::DOUBLE AS emissions_exports, NULL::DOUBLE AS market_value_imports,
            NULL::DOUBLE AS market_value_exports FROM market_fact""",
)
def _market_summary(t: Tables):
    return market_fact(t)


@query(
    "e6_pick_price",
    """SELECT interval, network_region, CASE WHEN network_id = 'WEM' THEN coalesce(price_dispatch, price) ELSE price END AS price
        FROM x_market""",
)
def _pick_price(t: Tables):
    price = E.pick_price(F.col("network_id"), F.coalesce("price_dispatch", "price"), F.col("price"))
    return t.market().select("interval", "network_region", price.alias("price"))


@query(
    "e7_demand_proxy",
    """WITH gen AS (SELECT interval, round(sum(generated), 2) AS total FROM x_telemetry WHERE network_id = 'WEM' GROUP BY 1)
        SELECT m.interval, network_region, CASE WHEN network_id = 'WEM' THEN coalesce(demand, total) ELSE demand END AS demand
        FROM x_market m LEFT JOIN gen g ON g.interval = m.interval""",
)
def _proxy(t: Tables):
    gen = (
        t.telemetry()
        .filter(F.col("network_id") == "WEM")
        .groupBy("interval")
        .agg(F.round(F.sum("generated"), 2).alias("total"))
    )
    demand = E.demand_proxy(F.col("network_id"), F.col("demand"), F.col("total"))
    return t.market().join(gen, "interval", "left").select("interval", "network_region", demand.alias("demand"))


@query(
    "e8_renewable_and_storage",
    """SELECT interval, u.network_id, u.network_region,
            round(sum(CASE WHEN fueltech_id IN ('bioenergy_biogas', 'bioenergy_biomass', 'hydro', 'solar_utility', 'wind',
                'battery_discharging', 'pumps') THEN greatest(generated, 0) ELSE 0 END), 4) AS renewable_generation,
            0::DOUBLE AS storage_generation
        FROM (SELECT time_bucket(INTERVAL '5 minutes', interval) AS interval, unit_code, generated
            FROM x_signed WHERE NOT is_forecast) JOIN x_units u USING (unit_code) GROUP BY 1, 2, 3""",
)
def _renewable(t: Tables):
    out = E.renewable_and_storage(t.signed(), t.units())
    return out.withColumn("renewable_generation", F.round("renewable_generation", 4))


@query(
    "e9_curtailment",
    f"""SELECT interval, network_id, network_region, {_CURTAILED},
            coalesce(avg({r4("ss_solar_uigf - ss_solar_clearedmw")}), 0) + coalesce(avg({r4("ss_wind_uigf - ss_wind_clearedmw")}), 0)
                AS curtailment_total FROM x_market GROUP BY 1, 2, 3""",
)
def _curtailment(t: Tables):
    return E.curtailment(t.market())


@query(
    "e10_gross_and_renewable",
    f"""SELECT interval, network_region, {r4("demand_total + demand")} AS demand_gross,
            {r4("ss_solar_uigf + demand")} AS generation_renewable,
            {r4(f"{r4('ss_solar_uigf + demand')} + ss_wind_uigf")} AS generation_renewable_with_storage FROM x_market""",
)
def _gross(t: Tables):
    rows = t.market().select(
        "interval",
        "network_region",
        "demand_total",
        F.col("demand").alias("rooftop_solar"),
        F.col("ss_solar_uigf").alias("renewable_generation"),
        F.col("ss_wind_uigf").alias("storage_generation"),
    )
    return E.gross_and_renewable(rows).select(
        "interval", "network_region", "demand_gross", "generation_renewable", "generation_renewable_with_storage"
    )


@query(
    "e11_pair_energy",
    f"""SELECT interval, network_id, network_region,
            {r4("(demand + lag(demand) OVER w) / 2 / (CASE network_id WHEN 'WEM' THEN 2 ELSE 12 END)")} AS demand_energy
        FROM x_ms WINDOW w AS (PARTITION BY network_id, network_region ORDER BY interval)""",
)
def _pairs(t: Tables):
    from wattframe.functions.lookups import lookup
    from wattframe.operators.ordered import lag_row

    keys = ["network_id", "network_region"]
    rows = t.ms().select("interval", *keys, "demand")
    paired = lag_row(rows, keys, "interval", ["demand"], chunk="day")
    rate = lookup(F.col("network_id"), E.MARKET_INTERVALS_PER_HOUR, F.lit(12.0))
    return E.pair_energy(paired, {"demand": "demand_energy"}, rate).select("interval", *keys, "demand_energy")


@query(
    "e12_demand_value",
    f"""SELECT interval, network_region, {r4("demand_energy * price")} AS demand_market_value,
            {r4("demand_total_energy * price")} AS demand_total_market_value,
            {r4("demand_gross_energy * price")} AS demand_gross_market_value FROM x_ms""",
)
def _values(t: Tables):
    rows = t.ms().select("interval", "network_region", "price", "demand_energy", "demand_total_energy", "demand_gross_energy")
    return E.demand_value(rows).select(
        "interval",
        "network_region",
        *[f"{d}_market_value" for d in ("demand", "demand_total", "demand_gross")],
    )


@query(
    "e13_region_intensity",
    """SELECT interval, network_region, round(sum(energy), 4) AS energy, round(sum(emissions), 4) AS emissions,
            CASE WHEN sum(energy) > 0 THEN round(sum(emissions) / sum(energy), 6) ELSE 0 END AS emissions_intensity
        FROM x_ui WHERE network_id = 'NEM' AND generated > 0 AND fueltech_id <> 'battery_charging' GROUP BY 1, 2""",
)
def _intensity(t: Tables):
    out = E.region_intensity(t.ui())
    return out.withColumns(
        {
            "energy": F.round("energy", 4),
            "emissions": F.round("emissions", 4),
            "emissions_intensity": F.round("emissions_intensity", 6),
        }
    )


@query(
    "e14_region_factor",
    """WITH f AS (
            SELECT date_trunc('hour', interval)::TIMESTAMP AS interval, facility_code, network_region,
                coalesce(sum(generated), 0) AS power, coalesce(sum(generated) * max(emissions_factor_co2), 0) AS emissions
            FROM x_telemetry t JOIN x_units u USING (unit_code)
            WHERE NOT is_forecast AND NOT interconnector AND u.network_id = 'NEM' AND generated > 0 GROUP BY 1, 2, 3),
        s AS (SELECT interval, network_region, sum(power) AS power, sum(emissions) AS emissions FROM f GROUP BY 1, 2)
        SELECT interval, network_region, round(coalesce(power, 0), 4) AS generated, round(coalesce(emissions, 0), 4) AS emissions,
            CASE WHEN power > 0 THEN round(emissions / power, 4) ELSE 0 END AS emissions_factor
        FROM (SELECT n.network_region, r.interval AS interval FROM (SELECT DISTINCT network_region FROM s) n,
                range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) AS r(interval))
            LEFT JOIN s USING (network_region, interval)""",
)
def _factor(t: Tables):
    out = E.region_factor(t.telemetry(), t.units(), timedelta(hours=1), START, END)
    return out.withColumns({"generated": F.round("generated", 4), "emissions": F.round("emissions", 4)})


_EDGES = """act AS (SELECT * FROM x_telemetry WHERE NOT is_forecast),
    edges AS (SELECT interval, interconnector_region_from AS a, interconnector_region_to AS b,
            coalesce(sum(generated) / 12, 0) AS energy
        FROM (SELECT * FROM x_signed WHERE NOT is_forecast) JOIN x_units u USING (unit_code)
        WHERE interconnector AND u.network_id = 'NEM' GROUP BY 1, 2, 3)"""


def _without_act(ctes: str) -> str:
    """The chain without its first table, which another chain defines alike."""
    return ctes.split("WHERE NOT is_forecast),", 1)[1]


@query(
    "f8_market_summary_with_flows",
    f"""WITH {_UNIT_FACT}, {_without_act(_MARKET_FACT)}, {_without_act(_EDGES)}, turned AS (
            SELECT interval, CASE WHEN energy < 0 THEN b ELSE a END AS a, CASE WHEN energy < 0 THEN a ELSE b END AS b,
                abs(energy) AS energy FROM edges),
        i AS (SELECT interval, network_region, CASE WHEN sum(energy) > 0 THEN sum(emissions) / sum(energy) ELSE 0 END AS k
            FROM unit_fact WHERE network_id = 'NEM' AND generated > 0 AND fueltech_id <> 'battery_charging' GROUP BY 1, 2),
        carried AS (SELECT t.*, energy * coalesce(k, 0) AS emissions FROM turned t
            LEFT JOIN i ON i.interval = t.interval AND i.network_region = t.a),
        both_ends AS (SELECT interval, a AS network_region, 0 AS im, energy AS ex, 0 AS eim, emissions AS eex FROM carried
            UNION ALL SELECT interval, b, energy, 0, emissions, 0 FROM carried),
        f AS (SELECT interval, network_region, sum(im) AS im, sum(ex) AS ex, sum(eim) AS eim, sum(eex) AS eex FROM both_ends GROUP BY 1, 2)
        SELECT m.*, round(im, 4) AS energy_imports, round(ex, 4) AS energy_exports, round(eim, 4) AS emissions_imports,
            round(eex, 4) AS emissions_exports, CASE WHEN im IS NOT NULL THEN 0::DOUBLE END AS market_value_imports,
            CASE WHEN im IS NOT NULL THEN 0::DOUBLE END AS market_value_exports
        FROM market_fact m LEFT JOIN f ON f.interval = m.interval AND f.network_region = m.network_region""",
)
def _with_flows(t: Tables):
    signed = t.signed().filter(~F.col("is_forecast"))
    flows = flow_emissions(edge_energy(signed, t.units()), E.region_intensity(unit_fact(t)))
    out = market_fact(t, flows)
    return out.withColumns({c: F.round(c, 4) for c in E.FLOW_COLUMNS})


@query(
    "f8_attach_flows",
    f"""WITH {_EDGES}, turned AS (
            SELECT interval, CASE WHEN energy < 0 THEN b ELSE a END AS a, CASE WHEN energy < 0 THEN a ELSE b END AS b,
                abs(energy) AS energy FROM edges),
        i AS (SELECT interval, network_region, CASE WHEN sum(energy) > 0 THEN sum(emissions) / sum(energy) ELSE 0 END AS k
            FROM x_ui WHERE network_id = 'NEM' AND generated > 0 AND fueltech_id <> 'battery_charging' GROUP BY 1, 2),
        carried AS (SELECT t.*, energy * coalesce(k, 0) AS emissions FROM turned t
            LEFT JOIN i ON i.interval = t.interval AND i.network_region = t.a),
        ends AS (SELECT interval, a AS network_region, 0 AS im, energy AS ex, 0 AS eim, emissions AS eex FROM carried
            UNION ALL SELECT interval, b, energy, 0, emissions, 0 FROM carried),
        f AS (SELECT interval, network_region, sum(im) AS im, sum(ex) AS ex, sum(eim) AS eim, sum(eex) AS eex FROM ends GROUP BY 1, 2)
        SELECT m.interval, m.network_id, m.network_region, m.demand, round(im, 4) AS energy_imports, round(ex, 4) AS energy_exports,
            round(eim, 4) AS emissions_imports, round(eex, 4) AS emissions_exports,
            CASE WHEN im IS NOT NULL THEN 0::DOUBLE END AS market_value_imports,
            CASE WHEN im IS NOT NULL THEN 0::DOUBLE END AS market_value_exports
        FROM x_ms m LEFT JOIN f ON f.interval = m.interval AND f.network_region = m.network_region""",
)
def _attach(t: Tables):
    signed = t.signed().filter(~F.col("is_forecast"))
    flows = flow_emissions(edge_energy(signed, t.units()), E.region_intensity(t.ui()))
    rows = t.ms().select("interval", "network_id", "network_region", "demand")
    out = E.attach_flows(rows, flows)
    return out.withColumns({c: F.round(c, 4) for c in E.FLOW_COLUMNS})


@query(
    "w1_lag_per_region",
    """SELECT interval, network_region, demand, lag(demand) OVER w AS prev_demand, lag(price) OVER w AS prev_price FROM x_ms
        WINDOW w AS (PARTITION BY network_region ORDER BY interval)""",
)
def _lag(t: Tables):
    from wattframe.operators.ordered import lag_row

    rows = t.ms().select("interval", "network_region", "demand", "price")
    out = lag_row(rows, ["network_region"], "interval", ["demand", "price"], chunk="day")
    return out.select("interval", "network_region", "demand", "prev_demand", "prev_price")


@query(
    "w2_partition_bounds",
    """SELECT event_id, min(interval) OVER w AS lo, max(interval) OVER w AS hi FROM x_telemetry
        WINDOW w AS (PARTITION BY unit_code)""",
)
def _bounds(t: Tables):
    from wattframe.operators.ordered import bounds

    out = bounds(t.telemetry(), ["unit_code"], F.col("interval"), F.col("interval"))
    return out.select("event_id", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


