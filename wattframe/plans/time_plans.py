"""Buckets, grids, gap filling and versions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattframe.functions.timebucket import NTZ, bucket, season_name, season_start, step_lit, to_market_time
from wattframe.operators import gapfill as G
from wattframe.operators import versioning as V
from wattframe.plans.catalog import query
from wattframe.plans.tables import END, START, Tables

FIVE = timedelta(minutes=5)
HOUR = timedelta(hours=1)

_DUCK_BUCKET = {
    "5m": "time_bucket(INTERVAL '5 minutes', interval)",
    "15m": "time_bucket(INTERVAL '15 minutes', interval)",
    "30m": "time_bucket(INTERVAL '30 minutes', interval)",
    "1h": "date_trunc('hour', interval)",
    "1d": "date_trunc('day', interval)::TIMESTAMP",
    "7d": "date_trunc('week', interval + INTERVAL 1 DAY)::TIMESTAMP - INTERVAL 1 DAY",
    "1M": "date_trunc('month', interval)::TIMESTAMP",
    "3M": "date_trunc('quarter', interval)::TIMESTAMP",
    "season": "(date_trunc('quarter', interval + INTERVAL 1 MONTH) - INTERVAL 1 MONTH)::TIMESTAMP",
    "1y": "date_trunc('year', interval)::TIMESTAMP",
    "fy": "date_trunc('year', interval + INTERVAL 6 MONTH)::TIMESTAMP",
}


def _register_bucket(name: str, interval: str) -> None:
    long = interval in ("7d", "1M", "3M", "season", "1y", "fy", "1d")
    table = "x_daily" if long else "x_telemetry"
    value = "energy" if long else "generated"

    @query(
        f"t1_bucket_{name}",
        f"""SELECT {_DUCK_BUCKET[interval]} AS bucket, count(*) AS points, round(sum({value}), 4) AS total
            FROM {table} GROUP BY 1""",
    )
    def _(t: Tables):
        df = t.daily() if long else t.telemetry()
        return df.groupBy(bucket("interval", interval).alias("bucket")).agg(
            F.count(F.lit(1)).alias("points"), F.round(F.sum(value), 4).alias("total")
        )


for _name, _interval in {
    "5_minutes": "5m",
    "hour": "1h",
    "day": "1d",
    "sunday_week": "7d",
    "month": "1M",
    "quarter": "3M",
    "year": "1y",
    "season": "season",
    "financial_year": "fy",
    "15_minutes": "15m",
    "30_minutes": "30m",
}.items():
    _register_bucket(_name, _interval)


@query(
    "t2_season_bucket_compat",
    """SELECT make_timestamp(year(interval),
                CASE WHEN month(interval) = 12 OR month(interval) <= 2 THEN 10 WHEN month(interval) <= 5 THEN 1
                     WHEN month(interval) <= 8 THEN 4 ELSE 7 END, 1, 0, 0, 0) AS season,
            sum(interval_count)::BIGINT AS points FROM x_daily GROUP BY 1""",
)
def _season_compat(t: Tables):
    return t.daily().groupBy(season_start("interval", compat=True).alias("season")).agg(
        F.sum("interval_count").alias("points")
    )


@query(
    "t4_season_name",
    """SELECT CASE WHEN month(interval) IN (12, 1, 2) THEN 'summer' WHEN month(interval) <= 5 THEN 'autumn'
                   WHEN month(interval) <= 8 THEN 'winter' ELSE 'spring' END AS season,
            round(sum(energy), 4) AS energy FROM x_daily GROUP BY 1""",
)
def _season_name(t: Tables):
    return t.daily().groupBy(season_name("interval").alias("season")).agg(F.round(F.sum("energy"), 4).alias("energy"))


@query(
    "n16_market_time",
    """SELECT event_id, ts + INTERVAL 2 HOURS AS interval FROM events""",
)
def _market_time(t: Tables):
    return t.read("events").select("event_id", to_market_time(F.col("ts").cast(NTZ), 480).alias("interval"))


# --- grids -----------------------------------------------------------------------

_HOURLY = """hourly AS (
        SELECT unit_code, date_trunc('hour', interval)::TIMESTAMP AS interval, round(avg(generated), 4) AS power
        FROM x_telemetry GROUP BY 1, 2),
    grid AS (
        SELECT unit_code, interval FROM (SELECT DISTINCT unit_code FROM hourly),
            range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) AS r(interval)),
    filled AS (SELECT unit_code, interval, power FROM grid LEFT JOIN hourly USING (unit_code, interval))"""


def _hourly(t: Tables):
    return (
        t.telemetry()
        .groupBy("unit_code", bucket("interval", "1h").alias("interval"))
        .agg(F.round(F.avg("generated"), 4).alias("power"))
    )


def _filled(t: Tables):
    return G.gapfill(_hourly(t), ["unit_code"], "interval", HOUR, START, END)


@query("g1_gapfill", f"WITH {_HOURLY} SELECT unit_code, interval, power FROM filled")
def _gapfill(t: Tables):
    return _filled(t)


@query(
    "g2_locf",
    f"""WITH {_HOURLY} SELECT unit_code, interval,
            last_value(power IGNORE NULLS) OVER (PARTITION BY unit_code ORDER BY interval) AS power FROM filled""",
)
def _locf(t: Tables):
    return G.locf(_filled(t), ["unit_code"], "interval", ["power"], chunk="day")


_PRICES = """prices AS (
        SELECT network_region, date_trunc('hour', interval)::TIMESTAMP AS interval, round(avg(price), 4) AS price
        FROM x_market GROUP BY 1, 2),
    grid AS (
        SELECT network_region, interval FROM (SELECT DISTINCT network_region FROM prices),
            range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) AS r(interval)),
    filled AS (
        SELECT network_region, interval, price, p.interval IS NOT NULL AS seen
        FROM grid LEFT JOIN prices p USING (network_region, interval))"""


def _prices(t: Tables):
    hourly = (
        t.market()
        .groupBy("network_region", bucket("interval", "1h").alias("interval"))
        .agg(F.round(F.avg("price"), 4).alias("price"))
    )
    return G.gapfill(hourly, ["network_region"], "interval", HOUR, START, END, present="seen")


@query(
    "g2_locf_created_gaps_only",
    """WITH filled AS (
            SELECT r.interval AS interval, n.network_region, p.price, p.interval IS NOT NULL AS seen
            FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)
            CROSS JOIN (SELECT DISTINCT network_region FROM x_market) n
            LEFT JOIN x_market p ON p.interval = r.interval AND p.network_region = n.network_region)
       SELECT network_region, interval, CASE WHEN seen THEN price ELSE held.x END AS price
       FROM (SELECT *, last_value(CASE WHEN seen THEN {'x': price} END IGNORE NULLS)
                OVER (PARTITION BY network_region ORDER BY interval) AS held FROM filled)""",
)
def _locf_plain(t: Tables):
    prices = t.market().select("network_region", "interval", "price")
    full = G.gapfill(prices, ["network_region"], "interval", FIVE, START, END, present="seen")
    return G.locf(full, ["network_region"], "interval", ["price"], False, "seen", chunk="day").drop("seen")


@query(
    "g3_price_carry",
    """WITH filled AS (
            SELECT r.interval AS interval, n.network_region, p.price
            FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)
            CROSS JOIN (SELECT DISTINCT network_region FROM x_market) n
            LEFT JOIN x_market p ON p.interval = r.interval AND p.network_region = n.network_region)
       SELECT network_region, interval,
            last_value(price IGNORE NULLS) OVER (PARTITION BY network_region ORDER BY interval) AS price FROM filled""",
)
def _price_carry(t: Tables):
    prices = t.market().select("network_region", "interval", "price")
    full = G.gapfill(prices, ["network_region"], "interval", FIVE, START, END)
    return G.locf(full, ["network_region"], "interval", ["price"], chunk="day")


_LINE = """lined AS (
        SELECT unit_code, interval, power,
            last_value(CASE WHEN power IS NOT NULL THEN {'t': interval, 'v': power} END IGNORE NULLS) OVER w AS p,
            first_value(CASE WHEN power IS NOT NULL THEN {'t': interval, 'v': power} END IGNORE NULLS)
                OVER (PARTITION BY unit_code ORDER BY interval ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n,
            last_value(power IGNORE NULLS) OVER w AS held,
            max(CASE WHEN power IS NOT NULL THEN interval END) OVER (PARTITION BY unit_code) AS hi
        FROM filled WINDOW w AS (PARTITION BY unit_code ORDER BY interval)),
    drawn AS (
        SELECT unit_code, interval, held, hi, coalesce(power,
            p.v + (n.v - p.v) * (epoch(interval) - epoch(p.t)) / nullif(epoch(n.t) - epoch(p.t), 0)) AS power
        FROM lined)"""


@query("g4_interpolate", f"WITH {_HOURLY}, {_LINE} SELECT unit_code, interval, power FROM drawn")
def _interpolate(t: Tables):
    return G.interpolate(_filled(t), ["unit_code"], "interval", ["power"], chunk="day")


@query(
    "g5_interpolate_with_tail",
    f"""WITH {_HOURLY}, {_LINE} SELECT unit_code, interval,
            coalesce(power, CASE WHEN interval <= hi + INTERVAL 5 HOURS THEN held END) AS power FROM drawn""",
)
def _tail(t: Tables):
    return G.interpolate_with_tail(_filled(t), ["unit_code"], "interval", "power", timedelta(hours=5), chunk="day")


@query(
    "g6_locf_bounded",
    """WITH half AS (
            SELECT t.unit_code, t.interval, round(sum(generated), 4) AS generated
            FROM x_telemetry t JOIN x_units u USING (unit_code)
            WHERE u.fueltech_id = 'solar_rooftop' AND NOT is_forecast AND interval <= TIMESTAMP '2024-01-31'
            GROUP BY 1, 2),
        ends AS (SELECT unit_code, min(interval) AS lo, max(interval) AS hi FROM half GROUP BY 1),
        grid AS (
            SELECT unit_code, r.interval FROM ends,
                range(TIMESTAMP '2023-12-31 23:25:00', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTES) AS r(interval)
            WHERE r.interval >= lo AND r.interval <= hi + INTERVAL 25 MINUTES)
        SELECT unit_code, interval,
            last_value(generated IGNORE NULLS) OVER (PARTITION BY unit_code ORDER BY interval) AS generated
        FROM grid LEFT JOIN half USING (unit_code, interval)""",
)
def _bounded(t: Tables):
    rooftop = t.units().filter(F.col("fueltech_id") == "solar_rooftop").select("unit_code")
    half = (
        t.telemetry()
        .filter(~F.col("is_forecast"))
        .join(rooftop, "unit_code", "left_semi")
        .groupBy("unit_code", "interval")
        .agg(F.round(F.sum("generated"), 4).alias("generated"))
    )
    return G.locf_bounded(half, ["unit_code"], "interval", ["generated"], FIVE, START, END, chunk="day")


@query(
    "g7_rescale_energy",
    """SELECT event_id, round(energy / (12 / (60 / CASE WHEN network_id = 'AEMO_ROOFTOP' THEN 30.0::DOUBLE
            ELSE 5.0::DOUBLE END)), 4) AS energy FROM x_telemetry""",
)
def _rescale(t: Tables):
    minutes = F.when(F.col("network_id") == "AEMO_ROOFTOP", 30.0).otherwise(5.0)
    return t.telemetry().select("event_id", F.round(G.rescale_energy(F.col("energy"), minutes), 4).alias("energy"))


@query(
    "g8_snapped_window",
    """WITH half AS (
            SELECT time_bucket(INTERVAL '30 minutes', interval) AS interval, round(sum(generated), 4) AS power
            FROM x_telemetry
            WHERE network_id = 'AEMO_ROOFTOP' AND interval BETWEEN TIMESTAMP '2024-01-02 00:30:00' AND TIMESTAMP '2024-01-29 23:30:00'
            GROUP BY 1),
        grid AS (SELECT r.interval AS interval, power FROM range(TIMESTAMP '2024-01-02 00:30:00',
                TIMESTAMP '2024-01-29 23:30:00', INTERVAL 5 MINUTES) AS r(interval) LEFT JOIN half USING (interval)
            UNION SELECT interval, power FROM half),
        lined AS (SELECT interval, power,
            last_value(CASE WHEN power IS NOT NULL THEN {'t': interval, 'v': power} END IGNORE NULLS)
                OVER (ORDER BY interval) AS p,
            first_value(CASE WHEN power IS NOT NULL THEN {'t': interval, 'v': power} END IGNORE NULLS)
                OVER (ORDER BY interval ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM grid)
        SELECT interval, coalesce(power, p.v + (n.v - p.v) * (epoch(interval) - epoch(p.t))
            / nullif(epoch(n.t) - epoch(p.t), 0)) AS power
        FROM lined WHERE interval >= TIMESTAMP '2024-01-02 00:50:00'""",
)
def _snapped(t: Tables):
    from wattframe.functions.timebucket import floor_minutes, snap_window, ts_lit

    asked = datetime(2024, 1, 2, 0, 50), datetime(2024, 1, 29, 23, 45)
    lo, hi = snap_window(*asked)
    half = (
        t.telemetry()
        .filter((F.col("network_id") == "AEMO_ROOFTOP") & F.col("interval").between(ts_lit(lo), ts_lit(hi)))
        .groupBy(F.lit("rooftop").alias("k"), floor_minutes("interval", 30).alias("interval"))
        .agg(F.round(F.sum("generated"), 4).alias("power"))
    )
    full = G.gapfill(half, ["k"], "interval", FIVE, lo, hi)
    out = G.interpolate(full, ["k"], "interval", ["power"], chunk="day")
    return out.filter(F.col("interval") >= ts_lit(asked[0])).select("interval", "power")


_UNIT_DAYS = """days AS (
        SELECT unit_code, date_trunc('day', interval)::TIMESTAMP AS interval, round(sum(energy), 4) AS energy
        FROM x_telemetry WHERE NOT is_forecast GROUP BY 1, 2)"""


def _unit_days(t: Tables):
    return (
        t.telemetry()
        .filter(~F.col("is_forecast"))
        .groupBy("unit_code", bucket("interval", "1d").alias("interval"))
        .agg(F.round(F.sum("energy"), 4).alias("energy"))
    )


@query(
    "g9_fill_interior",
    f"""WITH {_UNIT_DAYS}, ends AS (SELECT unit_code, min(interval) AS lo, max(interval) AS hi FROM days GROUP BY 1)
        SELECT unit_code, interval, energy
        FROM (SELECT unit_code, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS interval FROM ends)
            LEFT JOIN days USING (unit_code, interval)""",
)
def _interior(t: Tables):
    return G.fill_interior(_unit_days(t), ["unit_code"], "interval", "1d")


@query(
    "g9_fill_interior_months",
    """WITH months AS (
            SELECT network_region, fueltech_id, date_trunc('month', interval)::TIMESTAMP AS interval,
                round(sum(energy), 4) AS energy FROM x_daily WHERE energy > 100 GROUP BY 1, 2, 3),
        ends AS (SELECT network_region, fueltech_id, min(interval) AS lo, max(interval) AS hi FROM months GROUP BY 1, 2)
        SELECT network_region, fueltech_id, interval, energy
        FROM (SELECT network_region, fueltech_id, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS interval FROM ends)
            LEFT JOIN months USING (network_region, fueltech_id, interval)""",
)
def _interior_months(t: Tables):
    months = (
        t.daily()
        .filter(F.col("energy") > 100)
        .groupBy("network_region", "fueltech_id", bucket("interval", "1M").alias("interval"))
        .agg(F.round(F.sum("energy"), 4).alias("energy"))
    )
    return G.fill_interior(months, ["network_region", "fueltech_id"], "interval", "1M")


@query(
    "g10_dense_series",
    f"""WITH {_UNIT_DAYS}, ends AS (SELECT unit_code, min(interval) AS lo, max(interval) AS hi FROM days GROUP BY 1),
        full_days AS (
            SELECT unit_code, interval, energy
            FROM (SELECT unit_code, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS interval FROM ends)
                LEFT JOIN days USING (unit_code, interval))
        SELECT unit_code, min(interval) OVER w AS start, max(interval) OVER w AS last, '1d' AS interval,
            row_number() OVER (PARTITION BY unit_code ORDER BY interval) - 1 AS position, energy AS value
        FROM full_days WINDOW w AS (PARTITION BY unit_code)""",
)
def _dense(t: Tables):
    series = G.dense_series(_unit_days(t), ["unit_code"], "interval", "energy", "1d")
    return series.select("unit_code", "start", "last", "interval", F.posexplode("data").alias("position", "value"))


@query(
    "g11_drop_empty_series",
    f"""WITH {_UNIT_DAYS}, capped AS (SELECT unit_code, interval, CASE WHEN energy > 25 THEN energy ELSE 0 END AS energy FROM days)
        SELECT * FROM capped WHERE unit_code IN (SELECT unit_code FROM capped WHERE energy <> 0)""",
)
def _drop_empty(t: Tables):
    capped = _unit_days(t).withColumn("energy", F.when(F.col("energy") > 25, F.col("energy")).otherwise(0.0))
    return G.drop_empty_series(capped, ["unit_code"], "energy")


@query(
    "g12_cast_trailing_nulls",
    f"""WITH {_HOURLY}, ends AS (SELECT unit_code, max(interval) AS hi FROM filled WHERE power IS NOT NULL GROUP BY 1)
        SELECT unit_code, interval, CASE WHEN hi IS NULL OR interval > hi THEN 0 ELSE power END AS power
        FROM filled LEFT JOIN ends USING (unit_code)""",
)
def _trailing(t: Tables):
    return G.cast_trailing_nulls(_filled(t), ["unit_code"], "interval", "power")


@query(
    "g13_trim_nulls",
    f"""WITH {_HOURLY}, ends AS (
            SELECT unit_code, min(interval) AS lo, max(interval) AS hi FROM filled WHERE power IS NOT NULL GROUP BY 1)
        SELECT unit_code, interval, power FROM filled JOIN ends USING (unit_code) WHERE interval BETWEEN lo AND hi""",
)
def _trim(t: Tables):
    return G.trim_nulls(_filled(t), ["unit_code"], "interval", "power")


@query(
    "g14_missing_intervals",
    """WITH log AS (SELECT DISTINCT network_id AS source, time_bucket(INTERVAL '30 minutes', interval) AS interval
            FROM x_telemetry WHERE NOT is_forecast)
        SELECT source, r.interval AS interval FROM (SELECT DISTINCT source FROM log),
            generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:30:00', INTERVAL 30 MINUTES) AS r(interval)
        WHERE (source, r.interval) NOT IN (SELECT source, interval FROM log)""",
)
def _missing(t: Tables):
    from wattframe.functions.timebucket import floor_minutes

    log = (
        t.telemetry()
        .filter(~F.col("is_forecast"))
        .select(F.col("network_id").alias("source"), floor_minutes("interval", 30).alias("interval"))
        .distinct()
    )
    return G.missing_intervals(
        log, "source", "interval", timedelta(minutes=30), datetime(2024, 1, 1, 0, 25), datetime(2024, 1, 30, 23, 55)
    )


@query(
    "g15_pad_combinations",
    """WITH cap AS (
            SELECT network_id, network_region, fueltech_id, date_trunc('month', commencement_date)::TIMESTAMP AS month,
                sum(capacity_registered) AS capacity FROM x_units WHERE commencement_date IS NOT NULL GROUP BY ALL)
        SELECT p.network_id, p.network_region, m.month, f.fueltech_id, coalesce(c.capacity, 0) AS capacity
        FROM (SELECT DISTINCT network_id, network_region FROM cap) p, (SELECT DISTINCT month FROM cap) m,
            (SELECT DISTINCT fueltech_id FROM cap) f
        LEFT JOIN cap c ON c.network_id = p.network_id AND c.network_region = p.network_region
            AND c.month = m.month AND c.fueltech_id = f.fueltech_id""",
)
def _pad(t: Tables):
    cap = (
        t.units()
        .filter(F.col("commencement_date").isNotNull())
        .groupBy("network_id", "network_region", "fueltech_id", bucket("commencement_date", "1M").alias("month"))
        .agg(F.sum("capacity_registered").alias("capacity"))
    )
    return G.pad_combinations(cap, ["month", "fueltech_id"], ["network_id", "network_region"], "capacity")


@query(
    "g16_validate_length",
    f"""WITH {_UNIT_DAYS} SELECT unit_code, count(*) AS points, 30::BIGINT AS expected FROM days GROUP BY 1 HAVING count(*) <> 30""",
)
def _length(t: Tables):
    day = timedelta(days=1)
    return G.validate_length(_unit_days(t), ["unit_code"], "interval", day, START, END - day)


@query(
    "g17_cap_to_settled",
    """SELECT network_region, count(*) AS points FROM x_ms
        WHERE interval < (SELECT max(interval) FROM x_ms WHERE interval > TIMESTAMP '2024-01-24') GROUP BY 1""",
)
def _settled(t: Tables):
    capped = G.cap_to_settled(t.ms(), "interval", END, END)
    return capped.groupBy("network_region").agg(F.count(F.lit(1)).alias("points"))


# --- versions ----------------------------------------------------------------------


def _versions(t: Tables):
    return t.telemetry().select(
        "unit_code", bucket("interval", "1h").alias("interval"), "generated", F.col("event_id").alias("version")
    )


_VERSIONS = "SELECT unit_code, date_trunc('hour', interval)::TIMESTAMP AS interval, generated, event_id AS version FROM x_telemetry"
_RANKED = f"""SELECT unit_code, interval, generated, version FROM (
        SELECT *, row_number() OVER (PARTITION BY unit_code, interval ORDER BY version {{}}) AS rn FROM ({_VERSIONS})) WHERE rn = 1"""


@query("d1_latest_version", _RANKED.format("DESC"))
def _latest(t: Tables):
    return V.latest_version(_versions(t), ["unit_code", "interval"])


@query("d2_dedupe_last", _RANKED.format("DESC"))
def _last(t: Tables):
    return V.dedupe_last(_versions(t), ["unit_code", "interval"], "version")


@query("d3_dedupe_first", _RANKED.format("ASC"))
def _first(t: Tables):
    return V.dedupe_first(_versions(t), ["unit_code", "interval"], "version")


@query(
    "d4_completeness_version",
    """SELECT network_region, date_trunc('day', interval)::TIMESTAMP AS day, round(sum(energy), 4) AS energy,
            count(DISTINCT interval) * 1000000000 + max(version) AS version FROM x_ui GROUP BY 1, 2""",
)
def _completeness(t: Tables):
    return (
        t.ui()
        .groupBy("network_region", bucket("interval", "1d").alias("day"))
        .agg(F.round(F.sum("energy"), 4).alias("energy"), V.completeness_version("interval", "version").alias("version"))
    )


@query(
    "d5_distinct_on",
    """SELECT DISTINCT ON (unit_id) unit_id, changed_at, change_id, capacity_registered FROM x_history
        ORDER BY unit_id, changed_at DESC, change_id DESC""",
)
def _distinct_on(t: Tables):
    h = t.history().drop("emissions_factor_co2")
    return V.distinct_on(h, ["unit_id"], ["changed_at", "change_id"])


@query(
    "d6_latest_per_id",
    """SELECT t.event_id, t.user_id, t.value FROM events t JOIN (
            SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) m
        ON t.user_id = m.user_id AND t.event_id = m.event_id""",
)
def _latest_id(t: Tables):
    return V.latest_per_id(t.read("events").select("event_id", "user_id", "value"), "user_id", "event_id")


# --- keyed writes --------------------------------------------------------------------

_TARGET = """target AS (
        SELECT unit_code, interval, max(generated) AS generated, max(energy_storage) AS energy_storage
        FROM x_telemetry WHERE event_id % 2 = 0 GROUP BY 1, 2),
    raw AS (SELECT unit_code, interval, event_id, CASE WHEN event_id % 3 <> 0 THEN generated + 1000 END AS generated
        FROM x_telemetry WHERE event_id % 4 <> 0),
    updates AS (SELECT unit_code, interval, generated FROM (
        SELECT *, row_number() OVER (PARTITION BY unit_code, interval ORDER BY event_id DESC) AS rn FROM raw) WHERE rn = 1)"""


def _target(t: Tables):
    return (
        t.telemetry()
        .filter(F.col("event_id") % 2 == 0)
        .groupBy("unit_code", "interval")
        .agg(F.max("generated").alias("generated"), F.max("energy_storage").alias("energy_storage"))
    )


def _updates(t: Tables):
    value = F.when(F.col("event_id") % 3 != 0, F.col("generated") + 1000)
    return (
        t.telemetry()
        .filter(F.col("event_id") % 4 != 0)
        .select("unit_code", "interval", "event_id", value.alias("generated"))
    )


_KEYS = ["unit_code", "interval"]


@query(
    "s17_upsert_replace",
    f"""WITH {_TARGET} SELECT unit_code, interval,
            CASE WHEN u.unit_code IS NOT NULL THEN u.generated ELSE t.generated END AS generated, energy_storage
        FROM target t FULL JOIN updates u USING (unit_code, interval)""",
)
def _replace(t: Tables):
    return V.upsert(_target(t), _updates(t), _KEYS, ["generated"], order="event_id")


@query(
    "s18_merge_sparse",
    f"""WITH {_TARGET} SELECT unit_code, interval, coalesce(u.generated, t.generated) AS generated, energy_storage
        FROM target t FULL JOIN updates u USING (unit_code, interval)""",
)
def _merge(t: Tables):
    return V.merge_sparse(_target(t), _updates(t), _KEYS, ["generated"], order="event_id")


@query(
    "s19_upsert_fill_nulls",
    f"""WITH {_TARGET}, holey AS (SELECT unit_code, interval, CASE WHEN generated > 40 THEN generated END AS generated,
            energy_storage FROM target)
        SELECT unit_code, interval, coalesce(t.generated, u.generated) AS generated, energy_storage
        FROM holey t FULL JOIN updates u USING (unit_code, interval)""",
)
def _fill(t: Tables):
    holey = _target(t).withColumn("generated", F.when(F.col("generated") > 40, F.col("generated")))
    return V.upsert(holey, _updates(t), _KEYS, ["generated"], order="event_id", mode="fill_nulls")


@query(
    "s20_insert_if_absent",
    f"""WITH {_TARGET} SELECT unit_code, interval, generated, energy_storage FROM target
        UNION ALL SELECT unit_code, interval, generated, NULL FROM updates
            WHERE (unit_code, interval) NOT IN (SELECT unit_code, interval FROM target)""",
)
def _ignore(t: Tables):
    return V.upsert(_target(t), _updates(t), _KEYS, ["generated"], order="event_id", mode="ignore")
