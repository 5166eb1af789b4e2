"""Monitors and metadata checks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattframe.functions.timebucket import bucket
from wattframe.operators import quality as Q
from wattframe.operators.ingest import build_unit_map, split_bidirectional
from wattframe.plans.catalog import query
from wattframe.plans.ingest_plans import _GROUPED, _MAP, _grouped
from wattframe.plans.tables import END, START, Tables


@query(
    "q1_frozen_telemetry",
    """WITH dense AS (SELECT t.* REPLACE (t.interval - to_hours((extract(hour FROM t.interval) % 24)::BIGINT) + INTERVAL 22 HOURS
                + to_hours((extract(hour FROM t.interval) % 4)::BIGINT) AS interval, t.generated + 200 AS generated) FROM x_telemetry t),
        f AS (SELECT unit_code, network_region, date_trunc('day', interval - INTERVAL 3 HOURS)::TIMESTAMP AS night, capacity_registered,
            count(*) AS intervals, min(generated) AS min_mw, max(generated) AS max_mw
        FROM (SELECT * EXCLUDE network_id, network_id AS net FROM dense) d JOIN x_units USING (unit_code)
        WHERE net = 'NEM' AND NOT is_forecast AND fueltech_id = 'solar_utility' AND capacity_registered > 0
            AND (hour(interval) >= 22 OR hour(interval) < 3) AND generated > 0.1 * capacity_registered GROUP BY 1, 2, 3, 4
        HAVING count(*) >= 6)
        SELECT *, abs(max_mw - min_mw) < 0.01 AS is_constant FROM f""",
)
def _frozen(t: Tables):
    """Readings moved into the night, so that there is something to find."""
    hour = F.hour("interval")
    into_night = bucket("interval", "1d") + F.make_dt_interval(F.lit(0), F.lit(22) + hour % 4, F.minute("interval"))
    rows = t.telemetry().withColumn("interval", into_night).withColumn("generated", F.col("generated") + 200)
    return Q.frozen_telemetry(rows, t.units(), START)


@query(
    "q2_dropped_codes",
    """WITH u AS (SELECT unit_code, CASE WHEN uid % 9 = 0 THEN NULL ELSE fueltech_id END AS fueltech_id, facility_code
            FROM x_units WHERE uid % 7 <> 0),
        s AS (SELECT network_id, unit_code AS code, coalesce(sum(energy), 0) AS energy_mwh, count(*) AS intervals FROM x_telemetry
            WHERE NOT is_forecast GROUP BY 1, 2 HAVING abs(coalesce(sum(energy), 0)) > 1)
        SELECT network_id, code, CASE WHEN u.unit_code IS NULL THEN 'no units row' ELSE 'unit has no fueltech or station' END AS reason,
            round(energy_mwh, 4) AS energy_mwh, intervals FROM s LEFT JOIN u ON u.unit_code = code
        WHERE (u.unit_code IS NULL OR u.fueltech_id IS NULL) AND code NOT IN ('U7', 'U9')""",
)
def _dropped(t: Tables):
    units = t.units().filter(F.col("uid") % 7 != 0)
    units = units.withColumn("fueltech_id", F.when(F.col("uid") % 9 != 0, F.col("fueltech_id")))
    out = Q.dropped_codes(t.telemetry(), units, START, known=("U7", "U9"))
    return out.withColumn("energy_mwh", F.round("energy_mwh", 4))


_DATED = """dated AS (SELECT * REPLACE (CASE WHEN uid % 6 = 0 THEN commencement_date - INTERVAL 3000 DAYS
            WHEN uid % 20 = 0 THEN NULL ELSE closure_date END AS closure_date) FROM x_units)"""


@query(
    "q3_unit_date_issues",
    f"""WITH {_DATED}, r AS (SELECT * FROM dated WHERE fueltech_id NOT IN ('solar_rooftop', 'imports', 'exports', 'interconnector')),
        i AS (SELECT 'operating_missing_commencement' AS issue, * FROM r WHERE status_id = 'operating' AND commencement_date IS NULL
            UNION ALL SELECT 'retired_missing_closure', * FROM r WHERE status_id = 'retired' AND closure_date IS NULL
            UNION ALL SELECT 'closure_before_commencement', * FROM r WHERE closure_date < commencement_date
            UNION ALL SELECT 'operating_with_closure', * FROM r WHERE status_id = 'operating' AND closure_date IS NOT NULL)
        SELECT issue, unit_code, fueltech_id, status_id, commencement_date, closure_date FROM i""",
)
def _dates(t: Tables):
    uid = F.col("uid")
    early = F.col("commencement_date") - F.make_dt_interval(F.lit(3000))
    closure = F.when(uid % 6 == 0, early).when(uid % 20 == 0, F.lit(None)).otherwise(F.col("closure_date"))
    return Q.unit_date_issues(t.units().withColumn("closure_date", closure))


@query(
    "q4_split_lag",
    f"""WITH {_GROUPED}, {_MAP}, rows_ AS (
            SELECT unit_code, generated FROM x_signed WHERE NOT is_forecast
            UNION ALL SELECT CASE WHEN generated < 0 THEN charge_unit ELSE discharge_unit END, abs(generated) FROM x_signed
                JOIN umap ON unit_code = unit WHERE NOT is_forecast AND event_id % 4 <> 0),
        c AS (SELECT unit_code, count(*) AS n, count(*) FILTER (generated < 0) AS neg, count(*) FILTER (generated >= 0) AS pos FROM rows_ GROUP BY 1)
        SELECT unit, b.neg AS neg_rows, coalesce(x.n, 0) AS charge_rows, b.pos AS pos_rows, coalesce(y.n, 0) AS discharge_rows
        FROM umap JOIN c b ON b.unit_code = unit LEFT JOIN c x ON x.unit_code = charge_unit LEFT JOIN c y ON y.unit_code = discharge_unit
        WHERE (b.neg > 0 AND b.neg - coalesce(x.n, 0) > 2) OR (b.pos > 0 AND b.pos - coalesce(y.n, 0) > 2)""",
)
def _lag(t: Tables):
    unit_map = build_unit_map(_grouped(t), manual={})
    signed = t.signed()
    copies = split_bidirectional(signed.filter(F.col("event_id") % 4 != 0), unit_map).join(
        unit_map.select(F.explode(F.array("charge_unit", "discharge_unit")).alias("unit_code")).distinct(), "unit_code", "left_semi"
    )
    own = unit_map.select(F.explode(F.array("charge_unit", "discharge_unit")).alias("unit_code")).distinct()
    rows = signed.join(own, "unit_code", "left_anti").unionByName(copies)
    fed = signed.filter(F.col("event_id") % 4 == 0).join(own, "unit_code", "left_semi")
    return Q.split_lag(rows.unionByName(fed), unit_map, START)


@query(
    "q5_seen_range",
    """SELECT unit_code, min(interval) AS data_first_seen, max(interval) AS data_last_seen FROM x_telemetry WHERE NOT is_forecast GROUP BY 1""",
)
def _seen(t: Tables):
    return Q.seen_range(t.telemetry())


@query(
    "q5_with_seen_range",
    """WITH s AS (SELECT unit_code, max(interval) AS l FROM x_telemetry WHERE NOT is_forecast GROUP BY 1)
        SELECT u.unit_code, commencement_date AS data_first_seen, l AS data_last_seen FROM x_units u LEFT JOIN s USING (unit_code)""",
)
def _with_seen(t: Tables):
    units = t.units().select("unit_code", F.col("commencement_date").alias("data_first_seen"))
    return Q.with_seen_range(units, t.telemetry(), keep_first=True)


@query(
    "q6_new_codes",
    """SELECT t.unit_code, t.network_id, round(abs(sum(generated)), 2) AS generated FROM x_telemetry t
        WHERE interval > TIMESTAMP '2024-01-10' AND unit_code NOT IN (SELECT unit_code FROM x_units WHERE uid % 3 <> 0)
            AND NOT (network_id = 'NEM' AND (unit_code LIKE 'U1%' OR unit_code LIKE '%5' OR unit_code = 'U3')) GROUP BY 1, 2""",
)
def _new(t: Tables):
    known = t.units().filter(F.col("uid") % 3 != 0)
    return Q.new_codes(t.telemetry(), known, datetime(2024, 1, 10), r"^U1|5$", ("U3",))


@query(
    "q7_feed_gap",
    """WITH s AS (SELECT unit_code, max(interval) AS l FROM x_telemetry WHERE NOT is_forecast GROUP BY 1),
        m AS (SELECT max(l) AS last_seen FROM s JOIN x_units USING (unit_code)
            WHERE status_id = 'operating' AND network_id = 'NEM' AND dispatch_type = 'GENERATOR')
        SELECT last_seen, (epoch(TIMESTAMP '2024-01-31 00:20:00') - epoch(last_seen)) / 60 AS gap_minutes,
            (epoch(TIMESTAMP '2024-01-31 00:20:00') - epoch(last_seen)) / 60 > 30 AS has_gap FROM m""",
)
def _gap(t: Tables):
    return Q.feed_gap(Q.with_seen_range(t.units(), t.telemetry()), END + timedelta(minutes=20))


_MAXED = """maxed AS (SELECT u.*, m.g AS max_generation, uid % 8 <> 0 AS approved FROM x_units u LEFT JOIN (
        SELECT unit_code, round(max(generated), 4) AS g FROM x_telemetry WHERE NOT is_forecast AND generated > 0 GROUP BY 1) m USING (unit_code)),
    effective AS (SELECT * REPLACE (CASE WHEN status_id = 'operating' AND max_generation / coalesce(capacity_maximum, capacity_registered) <= 0.9
        THEN 'commissioning' ELSE status_id END AS status_id) FROM maxed)"""


def _maxed(t: Tables):
    from wattframe.operators.history import max_generation

    best = max_generation(t.telemetry()).drop("max_generation_interval")
    return t.units().join(best, "unit_code", "left").withColumn("approved", F.col("uid") % 8 != 0)


@query("q8_effective_status", f"WITH {_MAXED} SELECT unit_code, status_id FROM effective")
def _status(t: Tables):
    parts = ("status_id", "max_generation", "capacity_maximum", "capacity_registered")
    return _maxed(t).select("unit_code", Q.effective_status(*[F.col(c) for c in parts]).alias("status_id"))


@query(
    "q9_list_facilities",
    f"""WITH {_MAXED}, u AS (SELECT * FROM effective WHERE approved AND NOT interconnector AND fueltech_id <> 'solar_rooftop'
            AND status_id IN ('operating', 'commissioning') AND fueltech_group_id IN ('coal', 'gas', 'wind'))
        SELECT f.facility_code, f.network_id, f.network_region, count(*) AS units, min(u.unit_code) AS first_unit, sum(capacity_registered) AS capacity
        FROM x_facilities f JOIN u ON u.facility_code = f.facility_code WHERE f.network_id = 'NEM' GROUP BY 1, 2, 3""",
)
def _list(t: Tables):
    listed = Q.list_facilities(
        t.facilities(), _maxed(t), status=["operating", "commissioning"], groups=["coal", "gas", "wind"], networks=["NEM"]
    )
    return listed.select(
        "facility_code",
        "network_id",
        "network_region",
        F.size("units").cast("long").alias("units"),
        F.col("units")[0]["unit_code"].alias("first_unit"),
        F.aggregate("units", F.lit(0.0), lambda a, u: a + u["capacity_registered"]).alias("capacity"),
    )


@query(
    "q10_completeness",
    """SELECT facility_code, unit_code, fueltech_id, status_id, (network_region = 'NSW1')::VARCHAR AS has_description, 'true' AS has_capacity,
            (capacity_maximum IS NOT NULL)::VARCHAR AS has_capacity_max, (emissions_factor_co2 IS NOT NULL)::VARCHAR AS has_emissions_intensity,
            (commencement_date IS NOT NULL)::VARCHAR AS has_commencement_date,
            CASE WHEN fueltech_id IN ('battery', 'battery_charging', 'battery_discharging') THEN 'false' ELSE 'NA' END AS has_storage_capacity,
            CASE WHEN status_id = 'retired' THEN (closure_date IS NOT NULL)::VARCHAR ELSE 'NA' END AS has_closure_date
        FROM (SELECT u.* EXCLUDE (network_region), f.network_region FROM x_units u JOIN x_facilities f USING (facility_code))""",
)
def _complete(t: Tables):
    sites = t.facilities().select(
        "facility_code", F.when(F.col("network_region") == "NSW1", "text").otherwise("").alias("description")
    )
    return Q.completeness(sites, t.units())


@query(
    "q11_duplicate_codes",
    """SELECT p_name AS code, count(*) AS records FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def _duplicates(t: Tables):
    return Q.duplicate_codes(t.read("part").select(F.col("p_name").alias("code")), "code")


@query(
    "q12_orphans",
    "SELECT facility_code, network_id, network_region FROM x_facilities WHERE length(facility_code) % 2 = 0 AND facility_code NOT LIKE '%3'",
)
def _orphans(t: Tables):
    code = F.col("facility_code")
    known = t.facilities().filter((F.length(code) % 2 != 0) | code.like("%3")).select(F.lower(code).alias("facility_code"))
    return Q.orphans(t.facilities(), known)


@query(
    "q13_export_sanity",
    """WITH u AS (SELECT * REPLACE (CASE WHEN uid % 5 = 0 THEN 'GENERATOR' ELSE dispatch_type END AS dispatch_type,
                CASE WHEN uid % 31 = 0 THEN NULL ELSE status_id END AS status_id) FROM x_units),
        e AS (SELECT * FROM u WHERE NOT (fueltech_id = 'battery' AND coalesce(status_id = 'operating', false)))
        SELECT facility_code, NULL AS unit_code, 'no units' AS issue FROM x_facilities WHERE facility_code NOT IN (SELECT facility_code FROM e)
        UNION ALL SELECT facility_code, unit_code, 'missing status_id' FROM e WHERE status_id IS NULL
        UNION ALL SELECT facility_code, unit_code, 'wrong dispatch type' FROM e
            WHERE (fueltech_id = 'battery_discharging' AND dispatch_type <> 'GENERATOR') OR (fueltech_id = 'battery_charging' AND dispatch_type <> 'LOAD')""",
)
def _sanity(t: Tables):
    uid = F.col("uid")
    units = (
        t.units()
        .withColumn("dispatch_type", F.when(uid % 5 == 0, "GENERATOR").otherwise(F.col("dispatch_type")))
        .withColumn("status_id", F.when(uid % 31 != 0, F.col("status_id")))
    )
    return Q.export_sanity(t.facilities(), units)


@query(
    "q15_changed_since",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'",
)
def _changed(t: Tables):
    return Q.changed_since(t.read("events").select("event_id", "ts"), "ts", datetime(2024, 1, 30, 12))


_RAW = """raw AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '0AB' || (c_custkey // 3) WHEN 1 THEN 'AB' || (c_custkey // 6)
            ELSE '01' || c_custkey END AS code FROM customer)"""


@query(
    "q16_resolve_codes",
    f"""WITH {_RAW}, s AS (SELECT *, CASE WHEN regexp_matches(code, '^0[A-Za-z]') THEN code[2:] ELSE code END AS st FROM raw)
        SELECT c_custkey, code, CASE WHEN st <> code AND st IN (SELECT code FROM raw) THEN code ELSE st END AS operational_code,
            code AS display_code FROM s""",
)
def _resolve(t: Tables):
    n = F.col("c_custkey")
    third, sixth = F.floor(n / 3).cast("string"), F.floor(n / 6).cast("string")
    code = (
        F.when(n % 3 == 0, F.concat(F.lit("0AB"), third))
        .when(n % 3 == 1, F.concat(F.lit("AB"), sixth))
        .otherwise(F.concat(F.lit("01"), n.cast("string")))
    )
    return Q.resolve_codes(t.read("customer").select("c_custkey", code.alias("code")))


@query(
    "q16_unique_units",
    f"""WITH {_RAW} SELECT code, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY c_custkey) AS rn FROM raw) WHERE rn = 1""",
)
def _unique(t: Tables):
    n = F.col("c_custkey")
    third, sixth = F.floor(n / 3).cast("string"), F.floor(n / 6).cast("string")
    code = (
        F.when(n % 3 == 0, F.concat(F.lit("0AB"), third))
        .when(n % 3 == 1, F.concat(F.lit("AB"), sixth))
        .otherwise(F.concat(F.lit("01"), n.cast("string")))
    )
    return Q.unique_units(t.read("customer").select("c_custkey", code.alias("code")), ["c_custkey"], "code")


@query(
    "x5_date_series",
    """SELECT network_region, r.day::TIMESTAMP AS day FROM (SELECT network_region, min(date_trunc('month', interval)) AS lo,
                max(date_trunc('month', interval)) AS hi FROM x_daily GROUP BY 1), generate_series(lo, hi, INTERVAL 1 MONTH) AS r(day)""",
)
def _dates_series(t: Tables):
    from wattframe.functions.timebucket import date_series

    ends = t.daily().groupBy("network_region").agg(
        F.min(bucket("interval", "1M")).alias("lo"), F.max(bucket("interval", "1M")).alias("hi")
    )
    return ends.select("network_region", F.explode(date_series("lo", "hi", "1M")).alias("day"))


@query(
    "x6_last_complete",
    """SELECT network_id, count(*) AS points, max(interval) AS last FROM x_ms WHERE network_id = 'NEM'
            AND interval < TIMESTAMP '2024-01-30 10:00:00' GROUP BY 1
        UNION ALL SELECT network_id, count(*), max(interval) FROM x_ms WHERE network_id = 'WEM' AND interval < TIMESTAMP '2024-01-30 08:00:00' GROUP BY 1""",
)
def _last_complete(t: Tables):
    from wattframe.functions.timebucket import last_complete, ts_lit

    now = datetime(2024, 1, 30, 0, 3)
    parts = []
    for network in ("NEM", "WEM"):
        rows = t.ms().filter((F.col("network_id") == network) & (F.col("interval") < ts_lit(last_complete(now, network))))
        parts.append(rows.groupBy("network_id").agg(F.count(F.lit(1)).alias("points"), F.max("interval").alias("last")))
    return parts[0].unionByName(parts[1])


@query(
    "x12_resolved_range",
    """SELECT network_region, count(*) AS points FROM x_ms
        WHERE interval BETWEEN TIMESTAMP '2024-01-22 23:55:00' AND TIMESTAMP '2024-01-29 23:55:00' GROUP BY 1""",
)
def _range(t: Tables):
    from wattframe.functions.timebucket import resolve_range, ts_lit

    lo, hi = resolve_range(START, datetime(2024, 1, 29, 23, 55, 20), "5m", period="7d")
    rows = t.ms().filter(F.col("interval").between(ts_lit(lo), ts_lit(hi)))
    return rows.groupBy("network_region").agg(F.count(F.lit(1)).alias("points"))
