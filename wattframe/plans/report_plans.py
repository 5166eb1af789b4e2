"""Series, mixes, capacity, pollution and bundles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wattframe.functions.timebucket import NTZ, bucket
from wattframe.operators import flows as X
from wattframe.operators import history as H
from wattframe.operators import reports as P
from wattframe.operators import rollups as R
from wattframe.plans.catalog import query
from wattframe.plans.metric_plans import rounded
from wattframe.plans.sqltext import exact, line, r2, r4, r6
from wattframe.plans.tables import END, START, Tables
from wattframe.plans.time_plans import _DUCK_BUCKET

_NEM = "(network_id IN ('NEM', 'AEMO_ROOFTOP'))"
_WEM = "(network_id = 'WEM' OR (network_id = 'APVI' AND network_region = 'WEM'))"


def _rollups(t: Tables):
    fact = t.ui()
    return R.fueltech_interval(fact), R.fueltech_daily(fact)


def _power_sql(interval: str, where: str) -> str:
    return f"""SELECT {_DUCK_BUCKET[interval]} AS interval, fueltech_id AS fueltech_code,
            round(sum(generated), 4) AS fueltech_power, round(sum(emissions), 4) AS fueltech_emissions,
            {r4("sum(emissions) / nullif(sum(generated), 0)")} AS fueltech_emissions_intensity
        FROM x_ui WHERE {where} AND fueltech_id NOT IN ('solar_rooftop', 'battery') GROUP BY 1, 2"""


@query("a16_power_by_fueltech_5m", _power_sql("5m", f"{_NEM} AND network_region = 'QLD1'"))
def _power(t: Tables):
    return P.power_by_fueltech(*_rollups(t), "5m", START, END, region="QLD1")


@query("a16_power_by_fueltech_1d", _power_sql("1d", _NEM))
def _power_daily(t: Tables):
    return P.power_by_fueltech(*_rollups(t), "1d", START, END)


def _energy_sql(interval: str, where: str) -> str:
    return f"""SELECT {_DUCK_BUCKET[interval]} AS interval, fueltech_id AS fueltech_code,
            {r4("round(sum(energy), 6) / 1000")} AS fueltech_energy_gwh, round(sum(market_value), 2) AS fueltech_market_value_dollars,
            round(sum(emissions), 4) AS fueltech_emissions
        FROM x_ui WHERE {where} AND fueltech_id <> 'battery' GROUP BY 1, 2"""


@query("a17_energy_by_fueltech_1h", _energy_sql("1h", _NEM))
def _energy_hourly(t: Tables):
    return P.energy_by_fueltech(*_rollups(t), "1h", START, END)


@query("a17_energy_by_fueltech_1M_west", _energy_sql("1M", _WEM))
def _energy_monthly(t: Tables):
    return P.energy_by_fueltech(*_rollups(t), "1M", START, END, network="WEM")


@query(
    "a18_price_demand",
    f"""SELECT {_DUCK_BUCKET["30m"]} AS interval, network_id, network_region, {r6("avg(price)")} AS price,
            round(sum(demand), 6) AS demand, round(sum(demand_total), 6) AS demand_total,
            round(sum(curtailment_total), 6) AS curtailment_total,
            round(sum(curtailment_solar_total), 6) AS curtailment_solar_utility_total,
            round(sum(curtailment_wind_total), 6) AS curtailment_wind_total
        FROM x_ms WHERE network_id = 'NEM' AND network_region = 'NSW1' GROUP BY 1, 2, 3""",
)
def _price_demand(t: Tables):
    return rounded(P.price_demand(t.ms(), "30m", START, END, region="nsw1"))


def _demand_sql(bucket_sql: str, keys: str) -> str:
    return f"""SELECT {bucket_sql} AS interval, {keys}, {r4("round(sum(demand_total_energy), 6) / 1000")} AS demand_energy,
            round(sum(demand_total_market_value), 4) AS demand_market_value FROM x_ms WHERE network_id = 'NEM'"""


@query(
    "a19_demand_energy_1d",
    _demand_sql(_DUCK_BUCKET["1d"], "network_id, network_region") + " AND network_region = 'VIC1' GROUP BY 1, 2, 3",
)
def _demand_daily(t: Tables):
    return P.demand_energy(t.ms(), R.market_daily(t.ms()), "1d", START, END, region="VIC1")


@query("a19_demand_energy_1M", _demand_sql(_DUCK_BUCKET["1M"], "network_id") + " GROUP BY 1, 2")
def _demand_monthly(t: Tables):
    return P.demand_energy(t.ms(), R.market_daily(t.ms()), "1M", START, END)


@query("a19_demand_energy_7d", _demand_sql("date_trunc('week', interval)::TIMESTAMP", "network_id") + " GROUP BY 1, 2")
def _demand_weekly(t: Tables):
    return P.demand_energy(t.ms(), R.market_daily(t.ms()), "7d", START, END)


@query(
    "a20_curtailment_energy",
    f"""SELECT {_DUCK_BUCKET["1d"]} AS interval, network_id, 'NEM' AS network_region,
            {r4("round(sum(curtailment_energy_total), 6) / 1000")} AS curtailment_energy_total,
            {r4("round(sum(curtailment_energy_solar_total), 6) / 1000")} AS curtailment_energy_solar_total,
            {r4("round(sum(curtailment_energy_wind_total), 6) / 1000")} AS curtailment_energy_wind_total
        FROM x_ms WHERE network_id = 'NEM' GROUP BY 1, 2""",
)
def _curtailment(t: Tables):
    return P.curtailment_energy(t.ms(), "1d", START, END)


_A21_START, _A21_END = datetime(2024, 1, 1, 0, 50), datetime(2024, 1, 30, 23, 55)
_FIVE_SPAN = "range(TIMESTAMP '2024-01-01 00:30:00', TIMESTAMP '2024-01-30 23:30:00', INTERVAL 5 MINUTES) AS r(interval)"


@query(
    "a21_rooftop_combined",
    f"""WITH best AS (
            SELECT interval, t.network_id, u.network_region, max(CASE WHEN NOT is_forecast THEN generated END) AS ga,
                max(CASE WHEN is_forecast THEN generated END) AS gf, max(CASE WHEN NOT is_forecast THEN energy END) AS ea,
                max(CASE WHEN is_forecast THEN energy END) AS ef, bool_and(is_forecast) AS flag
            FROM x_telemetry t JOIN x_units u USING (unit_code)
            WHERE u.network_id = 'AEMO_ROOFTOP' AND interval BETWEEN TIMESTAMP '2024-01-01 00:30:00' AND TIMESTAMP '2024-01-30 23:30:00'
            GROUP BY 1, 2, 3),
        summed AS (SELECT interval, round(sum(coalesce(ga, gf)), 6) AS generated, round(sum(coalesce(ea, ef)), 6) AS energy,
            bool_or(flag) AS is_forecast FROM best GROUP BY 1),
        g AS (SELECT interval, generated, energy, is_forecast FROM (SELECT r.interval AS interval FROM {_FIVE_SPAN}
                UNION SELECT interval FROM summed) LEFT JOIN summed USING (interval)),
        lined AS (SELECT interval, is_forecast, {line("generated", "")} AS generated, {line("energy", "")} AS energy FROM g)
        SELECT 'solar_rooftop' AS fueltech_id, interval, generated, energy, is_forecast
        FROM lined WHERE interval >= TIMESTAMP '2024-01-01 00:50:00'""",
)
def _rooftop(t: Tables):
    return P.rooftop_combined(t.telemetry(), t.units(), _A21_START, _A21_END, chunk="day")


@query(
    "a22_rooftop_forecast",
    f"""WITH summed AS (
            SELECT interval, round(sum(generated), 6) AS generated, round(sum(energy), 6) AS energy
            FROM x_telemetry t JOIN x_units u USING (unit_code)
            WHERE u.network_id = 'AEMO_ROOFTOP' AND is_forecast
                AND interval BETWEEN TIMESTAMP '2024-01-01 00:30:00' AND TIMESTAMP '2024-01-30 23:30:00' GROUP BY 1),
        g AS (SELECT interval, generated, energy FROM (SELECT r.interval AS interval FROM {_FIVE_SPAN}
                WHERE EXISTS (SELECT 1 FROM summed) UNION SELECT interval FROM summed) LEFT JOIN summed USING (interval)),
        lined AS (SELECT interval, {line("generated", "")} AS generated, {line("energy", "")} AS energy FROM g)
        SELECT 'solar_rooftop' AS fueltech_id, interval, generated, energy
        FROM lined WHERE interval >= TIMESTAMP '2024-01-01 00:50:00'""",
)
def _forecast(t: Tables):
    return P.rooftop_forecast(t.telemetry(), t.units(), _A21_START, _A21_END, chunk="day")


def weather(t: Tables):
    n, v = F.col("event_id"), F.col("value")
    return t.read("events").select(
        F.concat(F.lit("W"), (F.col("user_id") % 8).cast("string")).alias("station_id"),
        F.col("ts").alias("observation_time"),
        F.when(n % 5 != 0, v).alias("temp_air"),
        F.when(n % 3 == 0, v - 5).alias("temp_min"),
        F.when(n % 4 == 0, v + 5).alias("temp_max"),
    )


_WEATHER = """obs AS (SELECT 'W' || (user_id % 8) AS station_id, ts AS observation_time,
        CASE WHEN event_id % 5 <> 0 THEN value END AS temp_air, CASE WHEN event_id % 3 = 0 THEN value - 5 END AS temp_min,
        CASE WHEN event_id % 4 = 0 THEN value + 5 END AS temp_max FROM events)"""


@query(
    "a23_weather_series",
    f"""WITH {_WEATHER}, per AS (
            SELECT time_bucket(INTERVAL '30 minutes', observation_time) AS interval, station_id, {r6("avg(temp_air)")} AS temp_air,
                coalesce(min(temp_min), min(temp_air)) AS temp_min, coalesce(max(temp_max), max(temp_air)) AS temp_max
            FROM obs GROUP BY 1, 2)
        SELECT interval, station_id, temp_air, temp_min, temp_max
        FROM (SELECT station_id, r.interval AS interval FROM (SELECT DISTINCT station_id FROM per),
                range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 30 MINUTES) AS r(interval))
            LEFT JOIN per USING (station_id, interval)""",
)
def _weather(t: Tables):
    return P.weather_series(weather(t), "30m", START, END).withColumn("temp_air", F.round("temp_air", 6))


def _mix_sql(at: str, grain: str, measure: str, scale: str, networks: str, demand_networks: str) -> str:
    return f"""WITH rows_ AS (
            SELECT {grain} AS tm, fueltech_group_id AS fueltech_group, renewable, {measure} AS v
            FROM x_telemetry t JOIN x_units u USING (unit_code)
            WHERE t.network_id IN ({networks}) AND dispatch_type = 'GENERATOR'
                AND fueltech_id NOT IN ('imports', 'exports', 'interconnector', 'battery_discharging')),
        total AS (SELECT tm, round(sum(v), 6) AS total FROM rows_ GROUP BY 1),
        tech AS (SELECT tm, fueltech_group, renewable, round(sum(v), 6) AS v FROM rows_ WHERE fueltech_group IS NOT NULL GROUP BY 1, 2, 3),
        demand AS (SELECT {grain} AS tm, round(sum(demand_total), 6) * {scale} AS d FROM x_market
            WHERE network_id IN ({demand_networks}) GROUP BY 1)
        SELECT tm AS {at}, fueltech_group, renewable, {r2("v")} AS {measure}, {r2("total")} AS generated_total,
            {r2("d")} AS demand_total, {r2("v / nullif(total, 0) * 100")} AS generated_proportion
        FROM tech JOIN total USING (tm) LEFT JOIN demand USING (tm)"""


@query(
    "a24_daily_mix",
    _mix_sql("trading_day", _DUCK_BUCKET["1d"], "energy", "1", "'NEM', 'AEMO_ROOFTOP'", "'NEM'"),
)
def _daily_mix(t: Tables):
    return P.daily_mix(t.telemetry(), t.market(), t.units(), START, END)


@query(
    "a25_time_of_day_mix",
    _mix_sql("interval", _DUCK_BUCKET["5m"], "generated", "(1.0::DOUBLE / 12)", "'NEM', 'AEMO_ROOFTOP'", "'NEM', 'AEMO_ROOFTOP'"),
)
def _tod(t: Tables):
    return P.time_of_day_mix(t.telemetry(), t.market(), t.units(), START, END)


@query(
    "a26_fold_other",
    """WITH e AS (SELECT network_region, fueltech_id || '_' || year(interval) AS fueltech_id, round(sum(energy), 4) AS energy
            FROM x_daily GROUP BY ALL),
        s AS (SELECT *, energy / sum(energy) OVER (PARTITION BY network_region) * 100 AS share FROM e)
        SELECT network_region, CASE WHEN share > 5 THEN fueltech_id ELSE 'Other' END AS fueltech_id,
            round(sum(energy), 4) AS energy, round(sum(share), 4) AS share FROM s GROUP BY 1, 2""",
)
def _fold(t: Tables):
    per = (
        t.daily()
        .withColumn("fueltech_id", F.concat_ws("_", "fueltech_id", F.year("interval")))
        .groupBy("network_region", "fueltech_id")
        .agg(F.round(F.sum("energy"), 4).alias("energy"))
    )
    whole = per.groupBy("network_region").agg(F.sum("energy").alias("whole"))
    shares = per.join(whole, "network_region").withColumn("share", F.col("energy") / F.col("whole") * 100).drop("whole")
    return rounded(P.fold_other(shares, ["network_region"], "fueltech_id", "share", ["energy"], 5.0), 4)


_MONDAY = datetime(2024, 1, 15)
_WEEKLY = """w AS (SELECT *, interval >= TIMESTAMP '2024-01-15' AS now FROM x_ui
        WHERE interval >= TIMESTAMP '2024-01-08' AND interval < TIMESTAMP '2024-01-22' AND network_id IN ('NEM', 'AEMO_ROOFTOP')
            AND fueltech_group_id NOT IN ('battery', 'battery_charging', 'pumps'))"""


@query(
    "a27_weekly_mix",
    f"""WITH {_WEEKLY}, p AS (SELECT fueltech_group_id, round(sum(energy) FILTER (now), 6) / 1000 AS e,
            round(sum(market_value) FILTER (now), 6) AS v, round(sum(energy) FILTER (NOT now), 6) / 1000 AS e0,
            round(sum(market_value) FILTER (NOT now), 6) AS v0 FROM w GROUP BY 1 HAVING count(*) FILTER (now) > 0),
        q AS (SELECT *, sum(e) OVER () AS total FROM p)
        SELECT fueltech_group_id, {r2("e")} AS energy_gwh, {r2("v")} AS market_value,
            CASE WHEN total > 0 THEN {r2("e / total * 100")} ELSE 0 END AS demand_proportion,
            CASE WHEN e0 > 0 THEN {exact("(e - e0) / e0 * 100", 1)} END AS wow_change,
            CASE WHEN v0 > 0 THEN {exact("(v - v0) / v0 * 100", 1)} END AS mv_wow_change FROM q""",
)
def _weekly(t: Tables):
    return P.weekly_mix(R.unit_daily(t.ui()), _MONDAY)


_WEEKLY_PRICE = """wp AS (SELECT network_region, round(sum(demand_energy) FILTER (interval >= TIMESTAMP '2024-01-15'), 4) AS demand_energy,
            round(sum(price) FILTER (interval >= TIMESTAMP '2024-01-15')
                / nullif(count(price) FILTER (interval >= TIMESTAMP '2024-01-15'), 0), 6) AS price,
            round(sum(price) FILTER (interval < TIMESTAMP '2024-01-15')
                / nullif(count(price) FILTER (interval < TIMESTAMP '2024-01-15'), 0), 6) AS price_before
        FROM x_ms WHERE network_id = 'NEM' AND interval >= TIMESTAMP '2024-01-08' AND interval < TIMESTAMP '2024-01-22' GROUP BY 1)"""


@query("a28_weekly_price", f"WITH {_WEEKLY_PRICE} SELECT * FROM wp")
def _weekly_price(t: Tables):
    return P.weekly_price(R.market_daily(t.ms()), _MONDAY)


@query(
    "a28_weekly_headline",
    f"""WITH {_WEEKLY}, {_WEEKLY_PRICE}, e AS (
            SELECT sum(energy) FILTER (now) AS a, sum(energy) FILTER (NOT now) AS a0, sum(energy) FILTER (now AND renewable) AS g,
                sum(energy) FILTER (NOT now AND renewable) AS g0 FROM w),
        p AS (SELECT avg(price) AS p, avg(price_before) AS p0 FROM wp)
        SELECT round(CASE WHEN a0 > 0 THEN (a - a0) / a0 * 100 END, 1) AS total_energy_wow,
            round(CASE WHEN g0 / a0 * 100 > 0 THEN g / a * 100 - g0 / a0 * 100 END, 1) AS renewable_wow,
            round(CASE WHEN p0 > 0 THEN (p - p0) / p0 * 100 END, 1) AS avg_price_wow FROM e, p""",
)
def _headline(t: Tables):
    return P.weekly_headline(R.unit_daily(t.ui()), R.market_daily(t.ms()), _MONDAY)


# --- capacity -------------------------------------------------------------------------------

_CAPACITY = """months AS (SELECT unnest(generate_series(TIMESTAMP '2010-01-01', TIMESTAMP '2020-06-01', INTERVAL 1 MONTH)) AS month_start),
    capacity AS (
        SELECT month_start, network_id, network_region, fueltech_id, sum(coalesce(capacity_maximum, capacity_registered)) AS total_capacity
        FROM months, x_units
        WHERE commencement_date IS NOT NULL AND fueltech_id NOT IN ('battery', 'battery_charging', 'solar_rooftop')
            AND ((network_id = 'WEM' AND network_region = 'WEM') OR (network_id = 'NEM' AND network_region <> 'WEM'))
            AND month_start >= date_trunc('month', commencement_date)
            AND month_start <= date_trunc('month', coalesce(closure_date, TIMESTAMP '2024-01-31'))
        GROUP BY 1, 2, 3, 4)"""


def _capacity(t: Tables):
    return P.capacity_history(t.units(), datetime(2010, 1, 1), datetime(2020, 6, 15), END)


@query("a29_capacity_history", f"WITH {_CAPACITY} SELECT * FROM capacity")
def _capacity_history(t: Tables):
    return _capacity(t)


@query(
    "a31_capacity_series",
    f"""WITH {_CAPACITY} SELECT concat_ws('.', 'capacity', lower(network_id), lower(network_region), fueltech_id) AS id,
            network_id, network_region, fueltech_id, min(month_start) OVER w AS start, max(month_start) OVER w AS last,
            row_number() OVER (PARTITION BY network_id, network_region, fueltech_id ORDER BY month_start) - 1 AS position,
            round(total_capacity, 4) AS value
        FROM capacity WINDOW w AS (PARTITION BY network_id, network_region, fueltech_id) QUALIFY max(total_capacity) OVER w <> 0""",
)
def _capacity_series(t: Tables):
    series = P.capacity_series(_capacity(t))
    points = series.select("id", "network_id", "network_region", "fueltech_id", "start", "last", F.posexplode("data").alias("position", "value"))
    return points.withColumn("value", F.round("value", 4))


@query(
    "a30_rooftop_capacity_history",
    """WITH named AS (SELECT DISTINCT unit_id, 'C' || (unit_id % 40) AS unit_code FROM x_history WHERE unit_id % 40 < 4),
        per AS (SELECT unit_code, date_trunc('month', changed_at)::TIMESTAMP AS month_start, max(capacity_registered) AS capacity
            FROM x_history JOIN named USING (unit_id)
            WHERE changed_at >= TIMESTAMP '1996-01-01' AND changed_at < TIMESTAMP '2000-07-01' GROUP BY 1, 2),
        filled AS (SELECT unit_code, month_start,
            last_value(capacity IGNORE NULLS) OVER (PARTITION BY unit_code ORDER BY month_start) AS capacity
            FROM (SELECT unit_code, unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2000-06-01', INTERVAL 1 MONTH)) AS month_start
                FROM (SELECT DISTINCT unit_code FROM named)) LEFT JOIN per USING (unit_code, month_start))
        SELECT month_start, CASE unit_code WHEN 'C3' THEN 'WEM' ELSE 'NEM' END AS network_id,
            CASE unit_code WHEN 'C0' THEN 'NSW1' WHEN 'C1' THEN 'VIC1' WHEN 'C2' THEN 'VIC1' ELSE 'WEM' END AS network_region,
            'solar_rooftop' AS fueltech_id, sum(coalesce(capacity, 0)) AS total_capacity FROM filled GROUP BY 1, 2, 3""",
)
def _rooftop_capacity(t: Tables):
    code = F.concat(F.lit("C"), (F.col("unit_id") % 40).cast("string")).alias("unit_code")
    units = t.history().select("unit_id", code).distinct()
    regions = {"C0": "NSW1", "C1": "VIC1", "C2": "VIC1", "C3": "WEM"}
    return P.rooftop_capacity_history(t.history(), units, datetime(1996, 1, 10), datetime(2000, 6, 10), regions)


@query(
    "j4_live_months",
    """SELECT m.month_start, count(*) AS units FROM x_units,
            (SELECT unnest(generate_series(TIMESTAMP '2010-01-01', TIMESTAMP '2024-01-01', INTERVAL 1 MONTH)) AS month_start) m
        WHERE m.month_start >= date_trunc('month', commencement_date)
            AND m.month_start <= date_trunc('month', coalesce(closure_date, TIMESTAMP '2024-01-31')) GROUP BY 1""",
)
def _live(t: Tables):
    rows = H.live_months(t.units(), datetime(2010, 1, 1), END, END)
    return rows.groupBy("month_start").agg(F.count(F.lit(1)).alias("units"))


# --- attribute history ------------------------------------------------------------------------


@query(
    "j6_value_at",
    """WITH h AS (SELECT unit_id, changed_at, arg_max(capacity_registered, change_id) AS v FROM x_history
            WHERE capacity_registered IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT l_suppkey AS unit_id, l_orderkey, l_linenumber, l_shipdate::TIMESTAMP AS at FROM lineitem)
        SELECT p.*, h.v AS capacity_registered_at FROM p ASOF LEFT JOIN h ON p.unit_id = h.unit_id AND p.at >= h.changed_at""",
)
def _value_at(t: Tables):
    probes = t.read("lineitem").select(
        F.col("l_suppkey").alias("unit_id"), "l_orderkey", "l_linenumber", F.col("l_shipdate").cast(NTZ).alias("at")
    )
    return H.value_at(probes, t.history(), "unit_id", "at", "capacity_registered", tiebreak="change_id")


@query(
    "q14_current_values",
    """SELECT unit_id, arg_max(capacity_registered, changed_at::VARCHAR || lpad(change_id::VARCHAR, 12, '0'))
                FILTER (capacity_registered IS NOT NULL) AS capacity_registered,
            arg_max(emissions_factor_co2, changed_at::VARCHAR || lpad(change_id::VARCHAR, 12, '0'))
                FILTER (emissions_factor_co2 IS NOT NULL) AS emissions_factor_co2 FROM x_history GROUP BY 1""",
)
def _current(t: Tables):
    columns = ("capacity_registered", "emissions_factor_co2")
    return H.current_values(t.history(), columns=columns, order=("changed_at", "change_id"))


@query(
    "q14_capture_changes",
    """SELECT uid AS unit_id, TIMESTAMP '2024-02-01' AS changed_at, CASE WHEN uid % 3 = 0 THEN capacity_registered + 10 END AS capacity_registered,
            CASE WHEN uid % 5 = 0 AND emissions_factor_co2 IS DISTINCT FROM 0.5 THEN 0.5::DOUBLE END AS emissions_factor_co2
        FROM x_units WHERE uid % 3 = 0 OR (uid % 5 = 0 AND emissions_factor_co2 IS DISTINCT FROM 0.5)""",
)
def _capture(t: Tables):
    columns = ("capacity_registered", "emissions_factor_co2")
    current = t.units().select(F.col("uid").alias("unit_id"), *columns)
    incoming = current.select(
        "unit_id",
        F.when(F.col("unit_id") % 3 == 0, F.col("capacity_registered") + 10)
        .otherwise(F.col("capacity_registered"))
        .alias("capacity_registered"),
        F.when(F.col("unit_id") % 5 == 0, F.lit(0.5)).otherwise(F.col("emissions_factor_co2")).alias("emissions_factor_co2"),
    )
    return H.capture_changes(current, incoming, datetime(2024, 2, 1), columns=columns)


@query(
    "w4_max_generation",
    """SELECT unit_code, round(generated, 4) AS max_generation, interval AS max_generation_interval FROM (
            SELECT *, row_number() OVER (PARTITION BY unit_code ORDER BY generated DESC, interval DESC) AS rn
            FROM x_telemetry WHERE NOT is_forecast AND generated > 0) WHERE rn = 1""",
)
def _max(t: Tables):
    return H.max_generation(t.telemetry())


@query(
    "w6_update_max",
    """WITH best AS (SELECT unit_code, round(generated, 4) AS g, interval AS tm FROM (
            SELECT *, row_number() OVER (PARTITION BY unit_code ORDER BY generated DESC, interval DESC) AS rn
            FROM x_telemetry WHERE NOT is_forecast AND generated > 0 AND interval >= TIMESTAMP '2024-01-24') WHERE rn = 1)
        SELECT u.unit_code, CASE WHEN g > capacity_registered THEN g ELSE capacity_registered END AS max_generation,
            CASE WHEN g > capacity_registered THEN tm ELSE commencement_date END AS max_generation_interval
        FROM x_units u LEFT JOIN best USING (unit_code)""",
)
def _update_max(t: Tables):
    stored = t.units().select(
        "unit_code",
        F.col("capacity_registered").alias("max_generation"),
        F.col("commencement_date").alias("max_generation_interval"),
    )
    return H.update_max(stored, H.max_generation(t.telemetry(), datetime(2024, 1, 24)))


# --- exports -----------------------------------------------------------------------------------


def _wide_sql() -> str:
    energies = ",\n".join(
        f"coalesce({r2(f'{t}_e * -1' if t in ('battery_charging', 'pumps') else f'{t}_e')}, 0) AS {t}_energy" for t in P.WIDE_ENERGY
    )
    outs = ",\n".join(f"coalesce({r2(f'{t}_m')}, 0) AS {t}_emissions" for t in P.WIDE_EMISSIONS)
    sums = ", ".join(f"round(sum(energy) FILTER (fueltech_id = '{t}'), 6) AS {t}_e" for t in P.WIDE_ENERGY)
    sums_m = ", ".join(f"round(sum(emissions) FILTER (fueltech_id = '{t}'), 6) AS {t}_m" for t in P.WIDE_EMISSIONS)
    half = "time_bucket(INTERVAL '30 minutes', interval)"
    return f"""WITH fa AS (SELECT {half} AS interval, network_region, {sums}, {sums_m}, round(sum(energy), 6) AS e, round(sum(emissions), 6) AS m
            FROM x_ui WHERE network_id IN ('NEM', 'AEMO_ROOFTOP') OR (network_id IN ('WEM', 'APVI') AND network_region = 'WEM')
            GROUP BY 1, 2),
        p AS (SELECT {half} AS interval, network_region, {r2(r6("avg(price)"))} AS price, {r2(r6("avg(demand)"))} AS demand FROM x_market GROUP BY 1, 2),
        f AS (SELECT {half} AS interval, network_region, round(sum(energy_imports), 6) AS ei, round(sum(energy_exports), 6) AS ee,
            round(sum(emissions_imports), 6) AS mi, round(sum(emissions_exports), 6) AS me FROM x_ms GROUP BY 1, 2)
        SELECT interval, network_region, coalesce(price, 0) AS price, coalesce(demand, 0) AS demand,
            coalesce({r2("ei")}, 0) AS imports_energy, coalesce({r2("-ee")}, 0) AS exports_energy,
            coalesce({r2("mi")}, 0) AS imports_emissions, coalesce({r2("-me")}, 0) AS exports_emissions,
            {energies}, {outs},
            CASE WHEN coalesce(e, 0) <> 0 THEN {r4("(coalesce(m, 0) + (coalesce(mi, 0) + coalesce(me, 0))) / e")} ELSE 0 END AS emissions_intensity
        FROM (SELECT network_region, r.interval AS interval FROM (SELECT DISTINCT network_region FROM fa),
                generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:30:00', INTERVAL 30 MINUTES) AS r(interval))
            LEFT JOIN fa USING (network_region, interval) LEFT JOIN p USING (network_region, interval)
            LEFT JOIN f USING (network_region, interval)"""


@query("a32_wide_export", _wide_sql())
def _wide(t: Tables):
    return P.wide_export(t.ui(), t.market(), t.ms(), START, END)


def stats(t: Tables):
    return t.read("orders").select(
        F.col("o_orderdate").cast(NTZ).alias("stat_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "cpi").otherwise("other").alias("stat_type"),
        F.when(F.col("o_orderstatus") == "F", "au").otherwise("nz").alias("country"),
        F.col("o_totalprice").alias("value"),
    )


@query(
    "a33_country_stat",
    """SELECT o_orderdate::TIMESTAMP AS stat_date, o_totalprice AS value, 'cpi' AS stat_type FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""",
)
def _country(t: Tables):
    return P.country_stat(stats(t), "cpi")


@query(
    "a34_data_range",
    """WITH seen AS (SELECT unit_code, min(interval) AS first_at FROM x_telemetry GROUP BY 1)
        SELECT min(s.first_at) AS start, max(t.interval) AS last
        FROM x_telemetry t JOIN x_units u USING (unit_code) JOIN seen s USING (unit_code)
        WHERE t.interval >= TIMESTAMP '2024-01-24' AND NOT is_forecast AND u.network_id = 'NEM' AND NOT interconnector
            AND fueltech_id NOT IN ('imports', 'exports', 'solar_rooftop')""",
)
def _range(t: Tables):
    seen = t.telemetry().groupBy("unit_code").agg(F.min("interval").alias("data_first_seen"))
    return P.data_range(t.telemetry(), t.units().join(seen, "unit_code"), END)


# --- pollution ------------------------------------------------------------------------------------


def _reports(t: Tables):
    from wattframe.plans.tables import pick

    places = ("Air Total", "Water Point", "Land Fugitive", "Air Fugitive", "Water Total", "Land")
    return t.read("lineitem").select(
        F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("npi_facility_id"),
        F.concat(F.lit("S"), (F.col("l_partkey") % 6).cast("string")).alias("name"),
        F.year("l_shipdate").alias("report_year"),
        pick(places, F.col("l_linenumber") % 6).alias("destination"),
        F.col("l_quantity").alias("quantity_kg"),
        (F.col("l_returnflag") == "A").alias("direct_measurement"),
        (F.col("l_linestatus") == "O").alias("engineering_calc"),
        (F.col("l_discount") > 0.05).alias("emission_factors"),
    )


def _substances(t: Tables):
    k = (F.col("p_partkey") % 6).alias("k")
    return (
        t.read("part")
        .select(k)
        .distinct()
        .select(
            F.concat(F.lit("s"), F.col("k").cast("string")).alias("code"),
            F.concat(F.lit("S"), F.col("k").cast("string")).alias("npi_name"),
            F.when(F.col("k") < 3, "air_pollutant").otherwise("heavy_metal").alias("category"),
            (F.col("k") != 4).alias("enabled"),
        )
    )


def _sites(t: Tables):
    n = F.col("s_suppkey")
    return t.read("supplier").select(
        F.concat(F.lit("F"), n.cast("string")).alias("facility_code"),
        F.when(n % 5 != 0, F.concat(F.lit("N"), n.cast("string"))).alias("npi_id"),
        (n % 7 != 0).alias("approved"),
    )


_POLLUTION = """subst AS (SELECT DISTINCT 's' || (p_partkey % 6) AS code, 'S' || (p_partkey % 6) AS npi_name,
            CASE WHEN p_partkey % 6 < 3 THEN 'air_pollutant' ELSE 'heavy_metal' END AS category, p_partkey % 6 <> 4 AS enabled FROM part),
    imported AS (
        SELECT 'N' || l_suppkey AS npi_facility_id, 's' || (l_partkey % 6) AS substance_code, year(l_shipdate) AS report_year,
            CASE l_linenumber % 6 WHEN 0 THEN 'air' WHEN 4 THEN 'water' ELSE 'land' END AS pollution_category,
            'total' AS pollution_subcategory, l_quantity AS pollution_value, 'kg' AS pollution_unit,
            CASE WHEN l_returnflag = 'A' THEN 'measured' WHEN l_linestatus = 'O' THEN 'calculated'
                WHEN l_discount > 0.05::DOUBLE THEN 'emission_factors' ELSE 'estimated' END AS data_quality
        FROM lineitem WHERE l_partkey % 6 <> 4 AND l_linenumber % 6 IN (0, 4, 5)),
    pollution AS (SELECT npi_facility_id, substance_code, report_year, pollution_category, sum(pollution_value) AS pollution_value,
            min(data_quality) AS data_quality FROM imported GROUP BY 1, 2, 3, 4),
    sites AS (SELECT 'F' || s_suppkey AS facility_code, CASE WHEN s_suppkey % 5 <> 0 THEN 'N' || s_suppkey END AS npi_id,
            s_suppkey % 7 <> 0 AS approved FROM supplier)"""


def _pollution(t: Tables):
    rows = P.pollution_import(_reports(t), _substances(t))
    return rows.groupBy("npi_facility_id", "substance_code", "report_year", "pollution_category").agg(
        F.sum("pollution_value").alias("pollution_value"), F.min("data_quality").alias("data_quality")
    )


@query("a37_pollution_import", f"WITH {_POLLUTION} SELECT * FROM imported")
def _import(t: Tables):
    return P.pollution_import(_reports(t), _substances(t))


@query(
    "a36_pollution_series",
    f"""WITH {_POLLUTION}, j AS (SELECT substance_code, category, facility_code, make_timestamp(report_year, 7, 1, 0, 0, 0) AS ts,
            pollution_value, data_quality FROM pollution JOIN sites ON npi_id = npi_facility_id JOIN subst ON code = substance_code
            WHERE approved AND enabled AND category = 'air_pollutant' AND report_year BETWEEN 1996 AND 2000),
        q AS (SELECT substance_code, facility_code, data_quality FROM (SELECT *, row_number() OVER (
                PARTITION BY substance_code, facility_code ORDER BY n DESC, data_quality) AS rn
            FROM (SELECT substance_code, facility_code, data_quality, count(*) AS n FROM j GROUP BY 1, 2, 3)) WHERE rn = 1)
        SELECT substance_code, category, facility_code, min(ts) OVER w AS date_start, max(ts) OVER w AS date_end, q.data_quality,
            row_number() OVER (w ORDER BY ts, pollution_value) - 1 AS position, ts, pollution_value AS value
        FROM j JOIN q USING (substance_code, facility_code) WINDOW w AS (PARTITION BY substance_code, category, facility_code)""",
)
def _pollution_series(t: Tables):
    series = P.pollution_series(_pollution(t), _substances(t), _sites(t), first_year=1996, last_year=2000)
    columns = ["substance_code", "category", "facility_code", "date_start", "date_end", "data_quality"]
    points = series.select(*columns, F.posexplode("data").alias("position", "_point"))
    return points.select(*columns, "position", "_point.ts", "_point.value")


@query(
    "a38_facility_pollution",
    f"""WITH {_POLLUTION} SELECT facility_code, report_year AS year, substance_code, npi_name AS substance_name, category,
            pollution_category, pollution_value AS value_kg, data_quality
        FROM pollution JOIN sites ON npi_id = npi_facility_id JOIN subst ON code = substance_code""",
)
def _facility_pollution(t: Tables):
    return P.facility_pollution(_pollution(t), _substances(t), _sites(t))


# --- nested series and bundles ------------------------------------------------------------------------


@query(
    "x8_to_series",
    """WITH d AS (SELECT date_trunc('day', interval)::TIMESTAMP AS interval, network_region, fueltech_id,
                round(sum(generated), 4) AS power, round(sum(energy), 4) AS energy FROM x_ui GROUP BY 1, 2, 3),
        l AS (SELECT interval, network_region, fueltech_id, 'power' AS metric, power AS value FROM d
            UNION ALL SELECT interval, network_region, fueltech_id, 'energy', energy FROM d),
        s AS (SELECT metric, network_region, fueltech_id, min(interval) AS lo, max(interval) AS hi FROM l GROUP BY 1, 2, 3),
        e AS (SELECT *, min(lo) OVER (PARTITION BY metric) AS date_start, max(hi) OVER (PARTITION BY metric) AS date_end FROM s),
        p AS (SELECT *, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM e)
        SELECT 'NEM' AS network, p.metric, p.metric || '_' || p.network_region || '|' || p.fueltech_id AS name, p.network_region, p.fueltech_id,
            '1d' AS interval, date_start, date_end, '+10:00' AS "offset", date_diff('day', lo, ts) AS position, ts, value
        FROM p LEFT JOIN l ON l.metric = p.metric AND l.network_region = p.network_region AND l.fueltech_id = p.fueltech_id AND l.interval = p.ts""",
)
def _series(t: Tables):
    keys = ["network_region", "fueltech_id"]
    daily = (
        t.ui()
        .groupBy(bucket("interval", "1d").alias("interval"), *keys)
        .agg(F.round(F.sum("generated"), 4).alias("power"), F.round(F.sum("energy"), 4).alias("energy"))
    )
    out = P.to_series(daily, ["power", "energy"], keys, "1d")
    points = out.select(*[c for c in out.columns if c != "data"], F.posexplode("data").alias("position", "_point"))
    return points.select("*", "_point.ts", "_point.value").drop("_point")


_SETS = """a AS (SELECT network_region || '.energy' AS series_id, interval, round(sum(energy), 4) AS value FROM x_daily
            WHERE network_region IN ('NSW1', 'VIC1') GROUP BY 1, 2),
    b AS (SELECT network_region || '.energy' AS series_id, interval, round(sum(energy) * 2, 4) AS value FROM x_daily
            WHERE network_region IN ('VIC1', 'SA1') GROUP BY 1, 2)"""


def _sets(t: Tables):
    def one(regions, scale):
        return (
            t.daily()
            .filter(F.col("network_region").isin(*regions))
            .groupBy(F.concat("network_region", F.lit(".energy")).alias("series_id"), "interval")
            .agg(F.round(F.sum("energy") * scale, 4).alias("value"))
        )

    return one(("NSW1", "VIC1"), 1), one(("VIC1", "SA1"), 2)


@query(
    "x10_append_series",
    f"WITH {_SETS} SELECT * FROM a UNION ALL SELECT * FROM b WHERE series_id NOT IN (SELECT series_id FROM a)",
)
def _append(t: Tables):
    return P.append_series(*_sets(t))


@query(
    "x10_get_series",
    f"""WITH {_SETS}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE series_id NOT IN (SELECT series_id FROM a))
        SELECT * FROM u WHERE series_id = 'SA1.energy'""",
)
def _get(t: Tables):
    return P.get_series(P.append_series(*_sets(t)), "SA1.energy")


_POINTS = f"SELECT series_id, interval, {r4('round(value, 9)')} AS value FROM {{}}"


def _points(df):
    """Every point of every series."""
    return df.select("series_id", "interval", F.round(F.round("value", 9), 4).alias("value"))


def _edges(t: Tables):
    return X.edge_power(t.signed(), t.units(), START, END)


def _power_set(t: Tables, region: str):
    fine, daily = _rollups(t)
    return P.power_bundle(
        fine, daily, t.ms(), t.telemetry(), t.units(), weather(t), START, END, region=region, stations=["W1"], chunk="day"
    )


def power_set_sql(region: str) -> str:
    """The series of the power bundle of an eastern region as a chain of CTEs ending in pw_set."""
    pre = f"au.nem.{region.lower()}."
    span = "interval BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"
    grid_ = "range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)"

    def rows(series: str, table: str, value: str) -> str:
        return f"SELECT '{pre}{series}' AS series_id, interval, {value} AS value FROM pw_{table}"

    def lined(name: str) -> str:
        return f"""pw_{name}_lined AS (SELECT interval, {line("generated", "")} AS generated FROM (
            SELECT interval, generated FROM (SELECT r.interval AS interval FROM {grid_} WHERE EXISTS (SELECT 1 FROM pw_{name})
                UNION SELECT interval FROM pw_{name}) LEFT JOIN pw_{name} USING (interval)))"""

    parts = [
        f"SELECT '{pre}' || fueltech_code || '.{s}' AS series_id, interval, {v} AS value FROM pw_techs"
        for s, v in (("power", "fueltech_power"), ("emissions", "fueltech_emissions"), ("emissions_factor", "fueltech_emissions_intensity"))
    ]
    parts += [rows("solar_rooftop.power", "roof_lined", "generated"), rows("solar_rooftop.power_forecast", "ahead_lined", "generated")]
    parts += [
        rows(series, "market", value)
        for series, value in (
            ("price", "price"),
            ("demand", "demand"),
            ("demand_total", "demand_total"),
            ("curtailment", "curtailment_total"),
            ("curtailment_solar_utility", "curtailment_solar_total"),
            ("curtailment_wind", "curtailment_wind_total"),
        )
    ]
    for way, e, m in (("imports", "ei", "mi"), ("exports", "ee", "me")):
        parts += [
            rows(f"{way}.power", "flows", f"{e} * 12"),
            rows(f"{way}.emissions", "flows", m),
            rows(f"{way}.emissions_factor", "flows", f"CASE WHEN {e} > 0 THEN {m} / {e} ELSE 0 END"),
        ]
    parts.append(rows("weather.w1.temperature", "weather", "temp_air"))
    own = f"u.network_id = 'AEMO_ROOFTOP' AND u.network_region = '{region}' AND {span}"
    return f"""{_WEATHER}, pw_techs AS ({_power_sql("5m", f"{_NEM} AND network_region = '{region}'")}),
    pw_best AS (SELECT interval, max(CASE WHEN NOT is_forecast THEN generated END) AS ga, max(CASE WHEN is_forecast THEN generated END) AS gf
        FROM x_telemetry t JOIN x_units u USING (unit_code) WHERE {own} GROUP BY 1),
    pw_roof AS (SELECT interval, round(coalesce(ga, gf), 6) AS generated FROM pw_best),
    {lined("roof")},
    pw_ahead AS (SELECT interval, round(sum(generated), 6) AS generated FROM x_telemetry t JOIN x_units u USING (unit_code)
        WHERE is_forecast AND {own} GROUP BY 1),
    {lined("ahead")},
    pw_market AS (SELECT * FROM x_ms WHERE network_id = 'NEM' AND network_region = '{region}' AND {span}),
    pw_flows AS (SELECT interval, coalesce(energy_imports, 0) AS ei, coalesce(energy_exports, 0) AS ee,
        coalesce(emissions_imports, 0) AS mi, coalesce(emissions_exports, 0) AS me FROM pw_market),
    pw_seen AS (SELECT time_bucket(INTERVAL '30 minutes', observation_time) AS interval, avg(temp_air) AS temp_air FROM obs
        WHERE station_id = 'W1' GROUP BY 1),
    pw_weather AS (SELECT r.interval AS interval, temp_air FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 30 MINUTES)
        AS r(interval) LEFT JOIN pw_seen USING (interval)),
    pw_set AS ({" UNION ALL ".join(parts)})"""


@query("a39_power_bundle", f"WITH {power_set_sql('NSW1')} {_POINTS.format('pw_set')}")
def _power_bundle(t: Tables):
    return _points(_power_set(t, "NSW1"))


def _energy_set(t: Tables, region: str | None, interval: str, network: str = "NEM"):
    fine, daily = _rollups(t)
    return P.energy_bundle(
        fine, daily, t.ms(), R.market_daily(t.ms()), weather(t), START, END, network, region, interval, ["W1"]
    )


def energy_set_sql(name: str, region: str, bucket_name: str, network: str = "NEM", with_weather: bool = True) -> str:
    """The series of one energy bundle as a chain of CTEs ending in `name`."""
    at, pre = _DUCK_BUCKET[bucket_name], f"au.{network.lower()}.{region.lower()}."
    east = network == "NEM"
    own = _NEM if east else _WEM

    def rows(series: str, table: str, value: str) -> str:
        return f"SELECT '{pre}{series}' AS series_id, interval, {value} AS value FROM {name}_{table}"

    parts = [
        f"SELECT '{pre}' || fueltech_id || '.{s}' AS series_id, interval, {v} AS value FROM {name}_techs"
        for s, v in (("energy", "e"), ("market_value", "v"), ("emissions", "m"))
    ]
    parts += [rows("demand.energy", "days", "de"), rows("demand.market_value", "days", "dv")]
    if east:
        parts += [
            rows("curtailment.energy", "days", "ct"),
            rows("curtailment_solar_utility.energy", "days", "cs"),
            rows("curtailment_wind.energy", "days", "cw"),
            rows("imports.energy", "days", "fi / 1000"),
            rows("exports.energy", "days", "fe / 1000"),
            rows("imports.emissions", "days", "mi"),
            rows("exports.emissions", "days", "me"),
            rows("imports.emissions_factor", "days", "CASE WHEN fi > 0 THEN mi / fi ELSE 0 END"),
            rows("exports.emissions_factor", "days", "CASE WHEN fe > 0 THEN me / fe ELSE 0 END"),
        ]
    if with_weather:
        parts += [rows(f"weather.w1.temperature_{s}", "wg", c) for s, c in (("mean", "t0"), ("min", "t1"), ("max", "t2"))]
    return f"""{name}_techs AS (
        SELECT {at} AS interval, fueltech_id, {r4("round(sum(energy), 6) / 1000")} AS e,
            round(sum(market_value), 2) AS v, round(sum(emissions), 4) AS m FROM x_ui
        WHERE {own} AND network_region = '{region}' AND fueltech_id <> 'battery' GROUP BY 1, 2),
    {name}_days AS (SELECT {at} AS interval, {r4("round(sum(demand_total_energy), 6) / 1000")} AS de,
            round(sum(demand_total_market_value), 4) AS dv, {r4("round(sum(curtailment_energy_total), 6) / 1000")} AS ct,
            {r4("round(sum(curtailment_energy_solar_total), 6) / 1000")} AS cs,
            {r4("round(sum(curtailment_energy_wind_total), 6) / 1000")} AS cw,
            sum(energy_imports) AS fi, sum(energy_exports) AS fe, sum(emissions_imports) AS mi, sum(emissions_exports) AS me
        FROM x_ms WHERE network_id = '{network}' AND network_region = '{region}' GROUP BY 1),
    {name}_wx AS (SELECT time_bucket(INTERVAL '1 day', observation_time) AS interval, avg(temp_air) AS t0,
            coalesce(min(temp_min), min(temp_air)) AS t1, coalesce(max(temp_max), max(temp_air)) AS t2
        FROM obs WHERE station_id = 'W1' GROUP BY 1),
    {name}_wg AS (SELECT r.interval AS interval, t0, t1, t2 FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)
            AS r(interval) LEFT JOIN {name}_wx USING (interval)),
    {name} AS ({" UNION ALL ".join(parts)})"""


_ENERGY_SET = f"{_WEATHER}, {energy_set_sql('energy_set', 'QLD1', '1d')}"
_CPI = """SELECT 'au.cpi' AS series_id, o_orderdate::TIMESTAMP AS interval, o_totalprice AS value FROM orders
            WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"""
ALL_REGIONS = {"NSW1": "NEM", "QLD1": "NEM", "SA1": "NEM", "TAS1": "NEM", "VIC1": "NEM", "WEM": "WEM"}
_MONTHLY_SETS = ", ".join(energy_set_sql(f"set_{r.lower()}", r, "1M", n, False) for r, n in ALL_REGIONS.items())


@query("a40_energy_bundle", f"WITH {_ENERGY_SET} {_POINTS.format('energy_set')}")
def _energy_bundle(t: Tables):
    return _points(_energy_set(t, "QLD1", "1d"))


@query(
    "a41_monthly_bundle",
    f"""WITH {_WEATHER}, {_MONTHLY_SETS}, every AS ({_CPI}
            {" ".join(f"UNION ALL SELECT * FROM set_{r.lower()}" for r in ALL_REGIONS)}) {_POINTS.format("every")}""",
)
def _monthly_bundle(t: Tables):
    fine, daily = _rollups(t)
    out = P.monthly_bundle(fine, daily, t.ms(), R.market_daily(t.ms()), stats(t), START, END, ALL_REGIONS)
    return _points(out)


@query(
    "a42_daily_bundle",
    f"""WITH {_ENERGY_SET}, full_set AS (SELECT * FROM energy_set UNION ALL {_CPI})
        {_POINTS.format("full_set")}""",
)
def _daily_bundle(t: Tables):
    fine, daily = _rollups(t)
    out = P.daily_bundle(
        fine, daily, t.ms(), R.market_daily(t.ms()), weather(t), stats(t), START, END, "QLD1", stations=["W1"]
    )
    return _points(out)


_EDGE_SET = """ep AS (SELECT interval, interconnector_region_from || '->' || interconnector_region_to AS flow,
            round(sum(generated), 2) AS power FROM x_signed JOIN x_units USING (unit_code) WHERE interconnector GROUP BY 1, 2),
    eg AS (SELECT flow, r.interval AS interval, power FROM (SELECT DISTINCT flow FROM ep) CROSS JOIN
            range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)
        LEFT JOIN ep USING (flow, interval))"""


@query(
    "a43_flow_bundle_7d",
    f"""WITH {_EDGE_SET}, fs AS (SELECT 'au.nem.flows.' || flow AS series_id, interval, power AS value FROM eg
            WHERE interval >= TIMESTAMP '2024-01-24') {_POINTS.format("fs")}""",
)
def _flow_bundle(t: Tables):
    return _points(P.flow_bundle(_edges(t), END, 7))


@query(
    "a43_flow_bundle_30d",
    f"""WITH {_EDGE_SET}, fs AS (SELECT 'au.nem.flows.' || flow AS series_id, interval, power AS value FROM eg)
        {_POINTS.format("fs")}""",
)
def _flow_bundle_30(t: Tables):
    return _points(P.flow_bundle(_edges(t), END, 30))


@query(
    "a44_map_feed",
    f"""WITH {_WEATHER}, {_EDGE_SET}, {energy_set_sql("set_vic", "VIC1", "1d")}, {energy_set_sql("set_wem", "WEM", "1d", "WEM")},
        turned AS (SELECT CASE flow WHEN 'VIC1->NSW1' THEN 'NSW1->VIC1' WHEN 'VIC1->SA1' THEN 'SA1->VIC1' ELSE flow END AS flow, interval,
            CASE WHEN flow IN ('VIC1->NSW1', 'VIC1->SA1') THEN CASE WHEN power <> 0 THEN -power END ELSE power END AS power FROM eg),
        every AS (SELECT 'au.nem.flows.' || flow AS series_id, interval, power AS value FROM turned WHERE interval >= TIMESTAMP '2024-01-30'
            UNION ALL SELECT * FROM set_vic UNION ALL SELECT * FROM set_wem) {_POINTS.format("every")}""",
)
def _map(t: Tables):
    return _points(P.map_feed(_edges(t), [_energy_set(t, "VIC1", "1d"), _energy_set(t, "WEM", "1d", "WEM")], END))


@query(
    "a45_station_series",
    f"""WITH s AS (SELECT {_DUCK_BUCKET["1d"]} AS interval, facility_code, unit_code, round(sum(energy), 6) AS energy,
            round(sum(emissions), 6) AS emissions, round(sum(market_value), 6) AS market_value
        FROM x_ui WHERE facility_code IN ('F1', 'F2', 'F3') AND network_id IN ('NEM', 'AEMO_ROOFTOP') GROUP BY 1, 2, 3)
        SELECT concat_ws('.', facility_code, unit_code, 'energy') AS series_id, interval, energy AS value FROM s
        UNION ALL SELECT concat_ws('.', facility_code, unit_code, 'emissions'), interval, emissions FROM s
        UNION ALL SELECT concat_ws('.', facility_code, unit_code, 'market_value'), interval, market_value FROM s""",
)
def _station(t: Tables):
    return P.station_series(t.ui(), ["F1", "F2", "F3"], ["energy", "emissions", "market_value"], "1d", START, END)


