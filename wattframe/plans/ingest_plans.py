"""Feed rows to telemetry and market rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wattframe.functions import clean as C
from wattframe.functions.lookups import NETWORKS
from wattframe.functions.timebucket import floor_minutes
from wattframe.operators import ingest as I
from wattframe.plans.catalog import query
from wattframe.plans.tables import REGIONS, Tables


def _scada(t: Tables):
    """Events as unit report rows; some power readings are unreadable."""
    power = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value").cast("string"))
    return t.read("events").select(
        floor_minutes("ts", 30).alias("settlementdate"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("duid"),
        power.alias("scadavalue"),
        "event_id",
    )


@query(
    "n1_to_telemetry",
    """SELECT interval, 'NEM' AS network_id, unit_code, generated, generated / 12.0::DOUBLE AS energy,
            NULL::DOUBLE AS energy_storage, false AS is_forecast, 0 AS energy_quality_flag
        FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS interval, 'U' || user_id AS unit_code,
                CASE WHEN event_id % 11 = 0 THEN 0 ELSE value END AS generated,
                row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '30 minutes', ts) ORDER BY event_id DESC) AS rn
            FROM events) WHERE rn = 1""",
)
def _telemetry(t: Tables):
    return I.to_telemetry(_scada(t), order="event_id")


_MAP = """umap AS (
        SELECT unit, coalesce(charge, unit || 'L') AS charge_unit,
            CASE WHEN nc = 0 THEN unit || 'G' ELSE coalesce(discharge, unit || 'G') END AS discharge_unit
        FROM (SELECT facility_code,
                min(CASE WHEN fueltech_id = 'battery' THEN unit_code END) AS unit,
                min(CASE WHEN fueltech_id = 'battery_charging' THEN unit_code END) AS charge,
                min(CASE WHEN fueltech_id = 'battery_discharging' THEN unit_code END) AS discharge,
                count(*) FILTER (fueltech_id = 'battery_charging') AS nc,
                count(*) FILTER (fueltech_id = 'battery_discharging') AS nd
            FROM grouped GROUP BY 1)
        WHERE unit IS NOT NULL AND (nc = 0 OR nd = 0 OR (nc = 1 AND nd = 1)))"""
# Wider stations, so that two-way units meet charge and discharge units.
_GROUPED = "grouped AS (SELECT * REPLACE ('S' || (uid // 14) AS facility_code) FROM x_units)"


def _grouped(t: Tables):
    return t.units().withColumn("facility_code", F.concat(F.lit("S"), F.floor(F.col("uid") / 14).cast("string")))


@query("n3_unit_map", f"WITH {_GROUPED}, {_MAP} SELECT unit, charge_unit, discharge_unit FROM umap")
def _unit_map(t: Tables):
    return I.build_unit_map(_grouped(t), manual={})


@query(
    "n2_split_bidirectional",
    f"""WITH {_GROUPED}, {_MAP}
        SELECT event_id, interval, unit_code, generated, energy FROM x_signed
        UNION ALL SELECT event_id, interval, CASE WHEN generated < 0 THEN charge_unit ELSE discharge_unit END,
            abs(generated), abs(energy) FROM x_signed JOIN umap ON unit_code = unit""",
)
def _split(t: Tables):
    out = I.split_bidirectional(t.signed(), I.build_unit_map(_grouped(t), manual={}))
    return out.select("event_id", "interval", "unit_code", "generated", "energy")


@query(
    "n4_alias_copies",
    """SELECT event_id, unit_code, generated FROM x_telemetry
        UNION ALL SELECT event_id, CASE unit_code WHEN 'U1' THEN 'U1G1' WHEN 'U2' THEN 'U2L1' END, generated
            FROM x_telemetry WHERE unit_code IN ('U1', 'U2')""",
)
def _aliases(t: Tables):
    rows = t.telemetry().select("event_id", "unit_code", "generated")
    return I.alias_copies(rows, {"U1": "U1G1", "U2": "U2L1"})


def _regional(t: Tables):
    """Events as regional report rows; region SNOWY1 is not a known one."""
    from wattframe.plans.tables import pick

    region = pick((*REGIONS, "SNOWY1"), F.col("user_id") % 6)
    return t.read("events").select(
        floor_minutes("ts", 5).alias("settlementdate"),
        region.alias("regionid"),
        F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")).alias("rrp"),
        F.round(F.col("value") - 50, 2).alias("netinterchange"),
        F.round(F.col("value") * 10, 2).alias("totaldemand"),
        F.round(F.col("value") * 11, 2).alias("demand_and_nonschedgen"),
        F.col("value").alias("ss_solar_uigf"),
        F.round(F.col("value") * 0.5, 4).alias("ss_solar_clearedmw"),
        F.round(F.col("value") * 0.75, 4).alias("ss_wind_uigf"),
        F.round(F.col("value") * 0.25, 4).alias("ss_wind_clearedmw"),
        "event_id",
        "event_type",
        F.col("value").alias("power"),
    )


_REGIONAL = """regional AS (
        SELECT time_bucket(INTERVAL '5 minutes', ts) AS settlementdate,
            (['NSW1', 'QLD1', 'SA1', 'TAS1', 'VIC1', 'SNOWY1'])[1 + user_id % 6] AS regionid,
            CASE WHEN event_id % 5 <> 0 THEN value END AS rrp, value, event_id, event_type FROM events),
    first_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY settlementdate, regionid ORDER BY event_id) AS rn
            FROM regional) WHERE rn = 1),
    first_price AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY settlementdate, regionid ORDER BY event_id) AS rn
            FROM regional WHERE rrp IS NOT NULL) WHERE rn = 1)"""


@query(
    "n5_remap_region_codes",
    """WITH r AS (SELECT event_id, (['NSW1', 'QLD1', 'SA1', 'TAS1', 'VIC1', 'SNOWY1'])[1 + user_id % 6] AS unit_code FROM events)
        SELECT event_id, 'ROOFTOP_NEM_' || rtrim(unit_code, '1') AS unit_code FROM r WHERE unit_code <> 'SNOWY1'""",
)
def _remap(t: Tables):
    rows = _regional(t).select("event_id", F.col("regionid").alias("unit_code"))
    return I.remap_region_codes(rows, "ROOFTOP_NEM_", NETWORKS["AEMO_ROOFTOP"].regions)


@query(
    "n6_price_feed",
    f"""WITH {_REGIONAL} SELECT settlementdate AS interval, 'NEM' AS network_id, regionid AS network_region,
            false AS is_forecast, rrp AS price_dispatch FROM first_price""",
)
def _price(t: Tables):
    return I.price_feed(_regional(t), "price_dispatch", "event_id")


@query(
    "n7_region_summary_demand",
    f"""WITH {_REGIONAL} SELECT settlementdate AS interval, 'NEM' AS network_id, regionid AS network_region,
            false AS is_forecast, round(value - 50, 2) AS net_interchange, round(value * 10, 2) AS demand,
            round(value * 11, 2) AS demand_total FROM first_row""",
)
def _demand(t: Tables):
    return I.region_summary(_regional(t), "event_id")[0]


@query(
    "n7_region_summary_curtailment",
    f"""WITH {_REGIONAL} SELECT settlementdate + INTERVAL 5 MINUTES AS interval, 'NEM' AS network_id,
            regionid AS network_region, false AS is_forecast, value AS ss_solar_uigf,
            round(value * 0.5::DOUBLE, 4) AS ss_solar_clearedmw, round(value * 0.75::DOUBLE, 4) AS ss_wind_uigf,
            round(value * 0.25::DOUBLE, 4) AS ss_wind_clearedmw FROM first_row""",
)
def _curtailed(t: Tables):
    return I.region_summary(_regional(t), "event_id")[1]


@query(
    "n8_interconnector_feed",
    """SELECT interval, 'NEM' AS network_id, unit_code, generated, false AS is_forecast FROM (
            SELECT time_bucket(INTERVAL '5 minutes', ts) AS interval, 'U' || user_id AS unit_code, value AS generated,
                row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '5 minutes', ts) ORDER BY event_id) AS rn
            FROM events) WHERE rn = 1""",
)
def _flows(t: Tables):
    rows = t.read("events").select(
        floor_minutes("ts", 5).alias("settlementdate"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("interconnectorid"),
        F.col("value").alias("meteredmwflow"),
        "event_id",
    )
    return I.interconnector_feed(rows, "event_id")


@query(
    "n9_process_tables",
    f"""WITH {_REGIONAL}
        SELECT 'dispatch_price' AS feed, count(*) AS points, round(sum(rrp), 2) AS total FROM first_price
        UNION ALL SELECT 'trading_regionsum', count(*), round(sum(round(value - 50, 2)), 2) FROM first_row
        UNION ALL SELECT 'rooftop_actual', count(*), round(sum(value), 2) FROM (
            SELECT *, row_number() OVER (PARTITION BY settlementdate, regionid ORDER BY event_id DESC) AS back FROM regional
            WHERE regionid <> 'SNOWY1') WHERE back = 1""",
)
def _process(t: Tables):
    rows = _regional(t)
    feeds = I.process_tables(
        {
            "dispatch_price": rows,
            "trading_regionsum": rows,
            "rooftop_actual": rows.withColumnRenamed("settlementdate", "interval_datetime"),
            "unknown_table": rows,
        },
        "event_id",
    )
    value = {"dispatch_price": "price_dispatch", "trading_regionsum": "net_interchange_trading", "rooftop_actual": "generated"}
    out = None
    for name, df in feeds.items():
        part = df.agg(
            F.lit(name).alias("feed"), F.count(F.lit(1)).alias("points"), F.round(F.sum(value[name]), 2).alias("total")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _texts(t: Tables):
    """Odd spellings made from the event rows."""
    n = F.col("event_id")
    return t.read("events").select("event_id", "value", "user_id", (n % 7).alias("k"))


@query(
    "n10_clean_code",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'UNIT-' || user_id END AS code
        FROM events""",
)
def _codes(t: Tables):
    uid = F.col("user_id").cast("string")
    raw = (
        F.when(F.col("k") == 1, F.lit(""))
        .when(F.col("k") == 2, F.lit(" - "))
        .when(F.col("k") == 3, F.concat(F.lit(" unit-"), uid, F.lit("é ")))
        .when(F.col("k") == 4, F.concat(F.lit("Unit-"), uid, F.lit("_x000D_")))
        .when(F.col("k") > 4, F.concat(F.lit("unit-"), uid))
    )
    return _texts(t).select("event_id", C.clean_code(raw).alias("code"))


@query(
    "n11_clean_capacity",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN value WHEN 2 THEN value WHEN 3 THEN value
            WHEN 4 THEN value WHEN 5 THEN NULL ELSE -value END AS capacity FROM events""",
)
def _capacity(t: Tables):
    v = F.col("value").cast("string")
    raw = (
        F.when(F.col("k") == 0, F.lit("-"))
        .when(F.col("k") == 1, F.concat(F.lit("12-"), v))
        .when(F.col("k") == 2, F.concat(F.lit("3/"), v))
        .when(F.col("k") == 3, F.concat(F.lit(" "), v, F.lit(" ")))
        .when(F.col("k") == 4, F.replace(v, F.lit("."), F.lit(",")))
        .when(F.col("k") == 5, F.lit(""))
        .otherwise(F.concat(F.lit("-"), v))
    )
    return _texts(t).select("event_id", C.clean_capacity(raw).alias("capacity"))


@query(
    "n12_clean_text",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS number, 'some ' || event_type AS squeezed,
            'Some ' || upper(event_type[1]) || event_type[2:] AS titled, 'Some' || upper(event_type[1]) || event_type[2:] AS camel
        FROM events""",
)
def _text(t: Tables):
    raw = F.concat(F.lit("  some   "), F.col("event_type"), F.lit(" "))
    number = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return t.read("events").select(
        "event_id",
        C.clean_float(number).alias("number"),
        C.squeeze(raw).alias("squeezed"),
        C.title(C.squeeze(raw)).alias("titled"),
        C.camel(F.concat(F.lit("some_"), F.col("event_type"))).alias("camel"),
    )


@query(
    "n13_forecast_flag",
    "SELECT event_id, event_id % 3 = 0 AND event_id % 2 = 0 AS is_forecast FROM events",
)
def _forecast(t: Tables):
    generation = F.when(F.col("event_id") % 3 != 0, F.lit(0.0))
    other = F.when(F.col("event_id") % 2 != 0, F.col("value"))
    return t.read("events").select("event_id", I.forecast_flag(generation, other).alias("is_forecast"))


@query(
    "n14_relabel_region",
    f"""WITH {_REGIONAL} SELECT CASE regionid WHEN 'SNOWY1' THEN 'NSW1' ELSE regionid END AS regionid, count(*) AS points
        FROM regional GROUP BY 1""",
)
def _relabel(t: Tables):
    return I.relabel_region(_regional(t), "regionid").groupBy("regionid").agg(F.count(F.lit(1)).alias("points"))


@query(
    "n15_clamp_sum",
    """SELECT interval, fueltech_id, CASE WHEN fueltech_id IN ('battery', 'battery_charging', 'battery_discharging', 'pumps')
            THEN round(sum(generated), 4) ELSE greatest(round(sum(generated), 4), 0) END AS generated
        FROM x_signed JOIN x_units USING (unit_code) GROUP BY 1, 2""",
)
def _clamp(t: Tables):
    units = t.units().select("unit_code", "fueltech_id")
    rows = t.signed().join(units, "unit_code")
    return rows.groupBy("interval", "fueltech_id").agg(
        I.clamp_sum(F.col("generated"), F.col("fueltech_id")).alias("generated")
    )


@query(
    "n17_history_cutoffs",
    """SELECT fueltech_id, count(*) AS points, min(interval) AS first_day FROM x_daily
        WHERE NOT (fueltech_id = 'wind' AND interval < TIMESTAMP '1998-07-01')
            AND NOT (fueltech_id = 'solar_utility' AND interval < TIMESTAMP '1999-08-01') GROUP BY 1""",
)
def _cutoffs(t: Tables):
    cutoffs = {"wind": datetime(1998, 7, 1), "solar_utility": datetime(1999, 8, 1)}
    kept = I.drop_before(t.daily(), "interval", "fueltech_id", cutoffs)
    return kept.groupBy("fueltech_id").agg(F.count(F.lit(1)).alias("points"), F.min("interval").alias("first_day"))


@query(
    "n18_expand_network",
    """SELECT network_id, count(*) AS points FROM x_ui WHERE network_id IN ('NEM', 'AEMO_ROOFTOP') GROUP BY 1""",
)
def _expand(t: Tables):
    return I.expand_network(t.ui(), "NEM").groupBy("network_id").agg(F.count(F.lit(1)).alias("points"))


# --- interval files ------------------------------------------------------------------------


@query(
    "s5_detect_cadence",
    """WITH stamps AS (SELECT DISTINCT unit_code, time_bucket(INTERVAL '5 minutes', interval) AS interval FROM x_telemetry),
        gaps AS (SELECT unit_code, interval, date_diff('minute', lag(interval) OVER w, interval) AS gap FROM stamps
            WINDOW w AS (PARTITION BY unit_code ORDER BY interval)),
        counted AS (SELECT unit_code, gap, count(*) AS n, min(interval) AS first FROM gaps WHERE gap > 0 GROUP BY 1, 2),
        top AS (SELECT unit_code, gap FROM (SELECT *, row_number() OVER (PARTITION BY unit_code ORDER BY n DESC, first) AS rn
            FROM counted) WHERE rn = 1)
        SELECT unit_code, CASE WHEN gap IN (5, 30) THEN gap ELSE 30 END AS interval_minutes
        FROM (SELECT DISTINCT unit_code FROM stamps) LEFT JOIN top USING (unit_code)""",
)
def _cadence(t: Tables):
    rows = t.telemetry().select("unit_code", floor_minutes("interval", 5).alias("interval"))
    return I.detect_cadence(rows, "interval", ["unit_code"])


@query(
    "s6_derive_power_energy",
    """SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN value END,
                CASE WHEN event_id % 2 = 0 THEN value * 2 END + CASE WHEN event_id % 3 = 0 THEN value * 3 END,
                CASE WHEN event_id % 3 = 0 THEN value * 3 END, CASE WHEN event_id % 2 = 0 THEN value * 2 END,
                CASE WHEN event_id % 7 = 0 THEN value / 4 END * 2) AS generated,
            coalesce(CASE WHEN event_id % 7 = 0 THEN value / 4 END, CASE WHEN event_id % 5 = 0 THEN value END / 2) AS energy
        FROM events""",
)
def _derive(t: Tables):
    n, v = F.col("event_id"), F.col("value")
    rows = t.read("events").select(
        "event_id",
        F.when(n % 5 == 0, v).alias("power"),
        F.when(n % 2 == 0, v * 2).alias("generated_scheduled"),
        F.when(n % 3 == 0, v * 3).alias("generated_non_scheduled"),
        F.when(n % 7 == 0, v / 4).alias("eoi_quantity"),
        F.lit(30).alias("interval_minutes"),
    )
    return I.derive_power_energy(rows).select("event_id", "generated", "energy")


@query(
    "s7_unpivot_intervals",
    """WITH wide AS (SELECT event_id // 50 AS file, event_id, 'U' || user_id AS facility_code, value,
            last_value(CASE WHEN event_id % 10 = 0 THEN date_trunc('minute', ts) END IGNORE NULLS)
                OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS as_at FROM events),
        n AS (SELECT unnest(range(1, 49)) AS n)
        SELECT file, facility_code, as_at::TIMESTAMP - to_minutes((5 * (n - 1))::BIGINT) AS interval,
            CASE WHEN n % 4 = 0 THEN 0 ELSE value + n END AS power,
            (CASE WHEN n % 4 = 0 THEN 0 ELSE value + n END) / 12 AS energy FROM wide, n""",
)
def _unpivot(t: Tables):
    n, v = F.col("event_id"), F.col("value")
    stamp = F.date_format(F.date_trunc("minute", F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    wide = t.read("events").select(
        F.floor(n / 50).alias("file"),
        "event_id",
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("facility_code"),
        *[
            (F.lit("") if i % 4 == 0 else (v + i).cast("string")).alias(f"I{i:02d}")
            for i in range(1, 49)
        ],
        F.when(n % 10 == 0, stamp).alias("as_at"),
    )
    return I.unpivot_intervals(wide, "event_id", ["file"])


# --- scalar functions ------------------------------------------------------------------------

_EXACT = "::DECIMAL(38, 12)"


@query(
    "x1_rounding",
    f"""SELECT event_id, round(value{_EXACT}, 1)::DOUBLE AS r1, abs(value - 50) AS a, greatest(value - 50, 0) AS g,
            value / nullif(event_id % 3, 0) AS d, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 0) AS c FROM events""",
)
def _rounding(t: Tables):
    v, n = F.col("value"), F.col("event_id")
    return t.read("events").select(
        "event_id",
        F.round(v, 1).alias("r1"),
        F.abs(v - 50).alias("a"),
        F.greatest(v - 50, F.lit(0.0)).alias("g"),
        (v / F.nullif(n % 3, F.lit(0))).alias("d"),
        F.coalesce(F.when(n % 2 == 0, v), F.lit(0.0)).alias("c"),
    )


@query(
    "x2_sigfig",
    """SELECT event_id, CASE WHEN v = 0 THEN 0 WHEN abs(v) >= 1000 THEN sign(v) * floor(abs(v))
            ELSE sign(v) * round_even((abs(v) * pow(10.0::DOUBLE, 2 - floor(log10(abs(v))))), 0)
                / pow(10.0::DOUBLE, 2 - floor(log10(abs(v)))) END AS v
        FROM (SELECT event_id, (value - 40) * 7 AS v FROM events)""",
)
def _sigfig(t: Tables):
    return t.read("events").select("event_id", C.sigfig((F.col("value") - 40) * 7, 3).alias("v"))


@query(
    "x3_parse_sizes",
    """SELECT event_id, floor((user_id + 1) * (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576
            ELSE 1073741824 END))::BIGINT AS bytes,
            (user_id + 1) * (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 1440 ELSE 43200 END) AS minutes FROM events""",
)
def _sizes(t: Tables):
    n = F.col("event_id") % 4
    count = (F.col("user_id") + 1).cast("string")
    size = F.concat(count, F.element_at(F.array(*[F.lit(x) for x in ("", "K", "M", "G")]), (n + 1).cast("int")))
    span = F.concat(count, F.element_at(F.array(*[F.lit(x) for x in ("m", "h", "d", "M")]), (n + 1).cast("int")))
    return t.read("events").select("event_id", C.parse_size(size).alias("bytes"), C.parse_interval(span).alias("minutes"))


@query(
    "x4_convert_units",
    """SELECT event_id, value / 12 AS mwh, value * 0.001::DOUBLE AS gw, value * 12 AS mw FROM events""",
)
def _convert(t: Tables):
    return t.read("events").select(
        "event_id",
        C.convert("value", "MW", "MWh").alias("mwh"),
        C.convert("value", "MW", "GW").alias("gw"),
        C.convert("value", "MWh", "MW").alias("mw"),
    )


@query(
    "x7_series_key",
    """SELECT concat_ws('|', network_region, fueltech_id) AS key, count(*) AS points FROM x_daily GROUP BY 1
        UNION ALL SELECT 'total', count(*) FROM x_daily""",
)
def _key(t: Tables):
    daily = t.daily()
    points = F.count(F.lit(1)).alias("points")
    each = daily.groupBy(C.series_key(["network_region", "fueltech_id"]).alias("key")).agg(points)
    return each.unionByName(daily.groupBy(C.series_key([]).alias("key")).agg(points))


@query(
    "x9_bool_label",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events""",
)
def _bool(t: Tables):
    n = F.col("event_id") % 3
    word = F.when(n == 0, "True").when(n == 1, "false").otherwise("wind")
    return t.read("events").select("event_id", C.bool_label(word).alias("flag"))


@query(
    "s15_parse_timestamps",
    """SELECT event_id, CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 8 IN (1, 3) THEN date_trunc('minute', ts)::TIMESTAMP
            WHEN event_id % 8 = 5 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts)::TIMESTAMP END AS at FROM events""",
)
def _parse(t: Tables):
    n, ts = F.col("event_id") % 8, F.col("ts")
    text = (
        F.when(n == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 1, F.date_format(ts, "d/MM/yy H:mm"))
        .when(n == 2, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(n == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .when(n == 4, F.date_format(ts, "d/M/yyyy  h:mm:ss a"))
        .when(n == 5, F.date_format(ts, "yyyyMMdd"))
        .when(n == 6, F.date_format(ts, "yyyyMMddHHmmss"))
        .otherwise("not a date")
    )
    return t.read("events").select("event_id", C.parse_ts(text).alias("at"))
