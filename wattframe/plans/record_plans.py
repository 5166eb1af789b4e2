"""Record detection over the derived facts and the long daily history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattframe.functions.timebucket import bucket
from wattframe.operators import records as Q
from wattframe.operators import rollups as R
from wattframe.operators.ordered import running_extremes
from wattframe.plans.catalog import query
from wattframe.plans.sqltext import r2
from wattframe.plans.tables import END, Tables
from wattframe.plans.time_plans import _DUCK_BUCKET
from wattframe.session import stage

# The synthetic feed is sparse, so completeness is judged leniently.
LENIENT = {**Q.THRESHOLDS, "day": 20, "month": 300, "quarter": 400, "year": 500}


@query(
    "w3_running_extremes",
    """SELECT interval, network_region, fueltech_id, max(energy) OVER w AS high, min(energy) OVER w AS low FROM x_daily
        WINDOW w AS (PARTITION BY network_region, fueltech_id ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _running(t: Tables):
    keys = ["network_region", "fueltech_id"]
    rows = t.daily().select("interval", *keys, "energy")
    rows = running_extremes(rows, keys, "interval", {"high": (F.col("energy"), "max"), "low": (F.col("energy"), "min")})
    return rows.select("interval", *keys, "high", "low")


def _series(t: Tables, period: str):
    return (
        t.daily()
        .groupBy("network_region", "fueltech_id", bucket("interval", Q.PERIOD_BUCKET[period]).alias("interval"))
        .agg(F.round(F.sum("energy"), 2).alias("value"), F.sum("interval_count").alias("interval_count"))
    )


def _detect_sql(period: str, floor: float, threshold: int) -> str:
    return f"""WITH base AS (
            SELECT network_region, fueltech_id, {_DUCK_BUCKET[Q.PERIOD_BUCKET[period]]} AS interval, round(sum(energy), 2) AS v,
                sum(interval_count)::BIGINT AS interval_count FROM x_daily GROUP BY 1, 2, 3),
        hi AS (SELECT * FROM (SELECT network_region, fueltech_id, interval, interval_count, round(v, 0) AS value,
                max(round(v, 0)) OVER (PARTITION BY network_region, fueltech_id ORDER BY interval
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
            FROM base WHERE round(v, 0) > {floor}) WHERE prev IS NULL OR value > prev),
        lo AS (SELECT * FROM (SELECT network_region, fueltech_id, interval, interval_count, v AS value,
                min(v) OVER (PARTITION BY network_region, fueltech_id ORDER BY interval
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
            FROM base WHERE v > 0 AND interval_count >= {threshold}) WHERE prev IS NULL OR value < prev),
        hits AS (SELECT *, 'high' AS aggregate FROM hi UNION ALL SELECT *, 'low' FROM lo)
        SELECT network_region, fueltech_id, interval, interval_count, aggregate, value,
            CASE WHEN abs((value - prev) / nullif(prev, 0) * 100) < 9999 AND abs((value - prev) / nullif(prev, 0) * 100) > 0.01
                THEN {r2("(value - prev) / nullif(prev, 0) * 100")} END AS pct_change FROM hits"""


for _period, _floor, _count in (
    ("day", 50.0, 3),
    ("week", 100.0, 10),
    ("month", 100.0, 40),
    ("quarter", 100.0, 100),
    ("season", 100.0, 100),
    ("year", 100.0, 400),
    ("financial_year", 100.0, 400),
):

    def _register(period=_period, floor=_floor, count=_count):
        @query(f"r1_detect_records_{period}", _detect_sql(period, floor, count))
        def _(t: Tables):
            return Q.detect_records(
                _series(t, period), ["network_region", "fueltech_id"], "interval", "value", "interval_count", floor, count
            ).drop("previous_interval")

    _register()


def base(t: Tables):
    fact = t.ui()
    return Q.record_base(R.fueltech_interval(fact), R.renewable_interval(fact), t.ms())


_NEM = "network_id IN ('NEM', 'AEMO_ROOFTOP')"
_GREEN = "fueltech_id NOT IN ('pumps', 'battery', 'battery_charging', 'battery_discharging')"
_TECHS = "('battery_charging', 'battery_discharging', 'bioenergy', 'coal', 'distillate', 'gas', 'hydro', 'pumps', 'solar', 'wind')"


def _grouping_sql(name: str, region: str, tech: str, where: str, clamp: bool) -> str:
    g = (lambda c: f"greatest({c}, 0)") if clamp else (lambda c: c)
    return f"""SELECT interval, '{name}' AS grouping, {region} AS network_region, {tech} AS fueltech_id,
            sum({g("generated")}) AS generated, sum({g("energy")}) AS energy, sum(emissions) AS emissions
        FROM x_ui WHERE {_NEM} AND {where} GROUP BY 1, 2, 3, 4"""


_N = "NULL::VARCHAR"
_R = "network_region"
_F = "fueltech_group_id"
_C = "CASE WHEN renewable THEN 'renewables' ELSE 'fossils' END"
_GENERATION = " UNION ALL ".join(
    [
        _grouping_sql("network", _N, _N, "true", False),
        _grouping_sql("region", _R, _N, "true", False),
        _grouping_sql("fueltech", _N, _F, f"{_F} IN {_TECHS}", False),
        _grouping_sql("region_fueltech", _R, _F, f"{_F} IN {_TECHS}", False),
        _grouping_sql("renewable", _N, _C, _GREEN, True),
        _grouping_sql("region_renewable", _R, _C, _GREEN, True),
    ]
)


def _market_sql(name: str, region: str) -> str:
    return f"""SELECT interval, '{name}' AS grouping, {region} AS network_region, avg(price) AS price, avg(demand) AS demand,
            sum(demand_energy) AS demand_energy, sum(generation_renewable) AS gr, sum(demand_gross) AS dg
        FROM x_ms WHERE network_id = 'NEM' GROUP BY 1, 2, 3"""


def _span(sums: str, table: str, keys: str) -> str:
    parts = []
    for p in ("day", "month", "quarter", "year"):
        parts.append(
            f"SELECT '{p}' AS period, {_DUCK_BUCKET[Q.PERIOD_BUCKET[p]]} AS interval, {keys}, {sums}, count(*) AS n FROM {table} GROUP BY 1, 2, {keys}"
        )
    return " UNION ALL ".join(parts)


_SHARE = (
    "CASE WHEN dg > 0 AND gr / nullif(dg, 0) * 100 <= 200 THEN "
    + r2("round(gr / nullif(dg, 0) * 100, 9)")
    + " ELSE -1 END"
)
_BASE = f"""gen AS ({_GENERATION}),
    mkt AS ({_market_sql("network", _N)} UNION ALL {_market_sql("region", _R)}),
    gspan AS ({_span("sum(energy) AS energy, sum(emissions) AS emissions", "gen", "grouping, network_region, fueltech_id")}),
    mspan AS ({_span("sum(demand_energy) AS demand_energy, sum(gr) AS gr, sum(dg) AS dg", "mkt", "grouping, network_region")}),
    base AS (
        SELECT interval, grouping, network_region, fueltech_id, 'interval' AS period, 1 AS interval_count, 'power' AS metric, generated AS value FROM gen
        UNION ALL SELECT interval, grouping, network_region, fueltech_id, period, n, 'energy', energy FROM gspan
        UNION ALL SELECT interval, grouping, network_region, fueltech_id, period, n, 'emissions', emissions FROM gspan
        UNION ALL SELECT interval, grouping, network_region, NULL, 'interval', 1, 'price', price FROM mkt
        UNION ALL SELECT interval, grouping, network_region, NULL, 'interval', 1, 'demand', demand FROM mkt
        UNION ALL SELECT interval, grouping, network_region, NULL, 'interval', 1, 'renewable_proportion', {_SHARE} FROM mkt
        UNION ALL SELECT interval, grouping, network_region, NULL, period, 1, 'demand', demand_energy FROM mspan
        UNION ALL SELECT interval, grouping, network_region, NULL, period, 10000000000, 'renewable_proportion', {_SHARE} FROM mspan)"""


@query(
    "r3_record_base",
    f"""WITH {_BASE} SELECT interval, grouping, network_region, fueltech_id, period, interval_count, metric,
            round(value, 4) AS value FROM base""",
)
def _base(t: Tables):
    return base(t).withColumn("value", F.round("value", 4))


def stored(t: Tables):
    """The records as a stored table, for queries that read it more than once."""
    return stage(found(t))


def found(t: Tables):
    """All records of the derived facts; sums are steadied so reruns agree."""
    steady = base(t).withColumn("value", F.round("value", 6))
    return Q.find_records(steady, END, chunk="day", completeness=LENIENT)


_FOUND = f"""{_BASE},
    ok AS (SELECT * REPLACE (round(value, 6) AS value),
            CASE metric WHEN 'energy' THEN 1000 WHEN 'emissions' THEN 1000 WHEN 'renewable_proportion' THEN 0 ELSE 100 END AS floor,
            CASE period WHEN 'interval' THEN 1 WHEN 'day' THEN 20 WHEN 'month' THEN 300 WHEN 'quarter' THEN 400 ELSE 500 END AS need,
            CASE WHEN metric = 'renewable_proportion' THEN {r2("round(value, 6)")} ELSE round(CAST(round(value, 6) AS DECIMAL(30, 6)), 0)::DOUBLE END AS rounded
        FROM base WHERE value IS NOT NULL AND (period = 'interval' OR (period = 'day' AND interval < TIMESTAMP '2024-01-31'))),
    hi AS (SELECT * FROM (SELECT *, max(rounded) OVER (PARTITION BY metric, period, grouping, network_region, fueltech_id
                ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
            FROM ok WHERE round(rounded, 0) > floor) WHERE prev IS NULL OR rounded > prev),
    lo AS (SELECT * FROM (SELECT *, min(value) OVER (PARTITION BY metric, period, grouping, network_region, fueltech_id
                ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
            FROM ok WHERE interval_count >= need AND (value > 0 OR metric = 'price')) WHERE prev IS NULL OR value < prev),
    hits AS (SELECT interval, network_region, fueltech_id, period, metric, 'high' AS aggregate, rounded AS value, prev FROM hi
        UNION ALL SELECT interval, network_region, fueltech_id, period, metric, 'low', value, prev FROM lo),
    named AS (SELECT interval, network_region, CASE WHEN metric = 'demand' THEN 'demand' ELSE fueltech_id END AS fueltech_id, period,
            CASE WHEN metric = 'demand' AND period = 'interval' THEN 'power' WHEN metric = 'demand' THEN 'energy' ELSE metric END AS metric,
            aggregate, value, (value - prev) / nullif(prev, 0) * 100 AS change FROM hits),
    found AS (SELECT lower(concat_ws('.', 'au', 'NEM', network_region, fueltech_id,
                CASE WHEN metric = 'renewable_proportion' THEN 'renewables.proportion' ELSE metric END, period, aggregate)) AS record_id,
            interval, aggregate, metric, period, round(value, 4) AS value,
            CASE WHEN abs(change) < 9999 AND abs(change) > 0.01 THEN {r2("change")} END AS pct_change, network_region, fueltech_id
        FROM named)"""


@query(
    "r1_find_records",
    f"""WITH {_FOUND} SELECT *, lag(sha256(record_id || '|' || strftime(interval, '%Y-%m-%d %H:%M:%S')))
            OVER (PARTITION BY record_id ORDER BY interval) AS previous_instance_id,
            sha256(record_id || '|' || strftime(interval, '%Y-%m-%d %H:%M:%S')) AS instance_id FROM found""",
)
def _find(t: Tables):
    return found(t).drop("significance", "description", "value_unit", "network_id")


@query(
    "r2_completeness_thresholds",
    """SELECT interval, network_region, interval_count, interval_count >= 4 AS complete FROM (
            SELECT interval, network_region, sum(interval_count)::BIGINT AS interval_count FROM x_daily GROUP BY 1, 2)""",
)
def _complete(t: Tables):
    from wattframe.functions.lookups import lookup

    counts = t.daily().groupBy("interval", "network_region").agg(F.sum("interval_count").alias("interval_count"))
    need = lookup(F.lit("day"), {**Q.thresholds(), "day": 4})
    return counts.withColumn("complete", F.col("interval_count") >= need)


@query(
    "r4_bounded_proportion",
    f"""WITH s AS (SELECT interval, sum(generation_renewable) AS gr, sum(demand_gross) AS dg FROM x_ms GROUP BY 1)
        SELECT interval, CASE WHEN dg - 30 > 0 AND gr / nullif(dg - 30, 0) * 100 <= 200 THEN {r2("gr / nullif(dg - 30, 0) * 100")}
            ELSE -1 END AS proportion FROM s""",
)
def _bounded(t: Tables):
    sums = t.ms().groupBy("interval").agg(F.sum("generation_renewable").alias("gr"), F.sum("demand_gross").alias("dg"))
    return sums.select("interval", Q.bounded_proportion(F.col("gr"), F.col("dg") - 30).alias("proportion"))


@query(
    "r5_apply_cutoffs",
    """SELECT interval, CASE fueltech_id WHEN 'wind' THEN 'wind' WHEN 'solar_utility' THEN 'solar' ELSE 'coal' END AS fueltech_id, energy
        FROM x_daily WHERE NOT (fueltech_id = 'wind' AND interval < TIMESTAMP '1998-07-01')
            AND NOT (fueltech_id = 'solar_utility' AND interval < TIMESTAMP '2000-10-26')""",
)
def _cut(t: Tables):
    name = F.when(F.col("fueltech_id") == "wind", "wind").when(F.col("fueltech_id") == "solar_utility", "solar")
    rows = t.daily().select("interval", name.otherwise("coal").alias("fueltech_id"), "energy")
    return Q.apply_cutoffs(rows, {"wind": "1998-07-01", "solar": "2000-10-26"})


@query(
    "r6_trim_incomplete",
    """SELECT 'month' AS period, count(*) AS points, max(interval) AS last FROM x_daily WHERE interval < TIMESTAMP '2001-05-01'
        UNION ALL SELECT 'quarter', count(*), max(interval) FROM x_daily WHERE interval < TIMESTAMP '2001-04-01'
        UNION ALL SELECT 'year', count(*), max(interval) FROM x_daily WHERE interval < TIMESTAMP '2001-01-01'
        UNION ALL SELECT 'week', count(*), max(interval) FROM x_daily WHERE interval < TIMESTAMP '2001-05-13'""",
)
def _trimmed(t: Tables):
    out = None
    for period in ("month", "quarter", "year", "week"):
        rows = Q.trim_incomplete(t.daily(), "interval", period, datetime(2001, 5, 17, 10))
        part = rows.agg(F.lit(period).alias("period"), F.count(F.lit(1)).alias("points"), F.max("interval").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "r7_pct_change",
    f"""WITH p AS (SELECT event_id, value - 20 AS v, (value + 1) / 3 - 15 AS prev FROM events)
        SELECT event_id, CASE WHEN abs((v - prev) / nullif(prev, 0) * 100) < 9999 AND abs((v - prev) / nullif(prev, 0) * 100) > 0.01
                THEN {r2("(v - prev) / nullif(prev, 0) * 100")} END AS plain,
            CASE WHEN abs((v - prev) / nullif(abs(prev), 0) * 100) < 9999 AND abs((v - prev) / nullif(abs(prev), 0) * 100) > 0.01
                THEN {r2("(v - prev) / nullif(abs(prev), 0) * 100")} END AS sized FROM p""",
)
def _pct(t: Tables):
    v, prev = F.col("value") - 20, (F.col("value") + 1) / 3 - 15
    return t.read("events").select(
        "event_id", Q.pct_change(v, prev).alias("plain"), Q.pct_change(v, prev, relative_to_size=True).alias("sized")
    )


@query(
    "r8_record_id",
    """SELECT interval, lower(concat_ws('.', 'au', 'NEM', CASE WHEN energy > 30 THEN network_region END, fueltech_id,
                CASE WHEN interval_count % 2 = 0 THEN 'renewables.proportion' ELSE 'energy' END,
                CASE WHEN interval_count % 3 = 0 THEN (CASE WHEN month(interval) IN (12, 1, 2) THEN 'summer' WHEN month(interval) <= 5
                    THEN 'autumn' WHEN month(interval) <= 8 THEN 'winter' ELSE 'spring' END) ELSE 'day' END, 'high')) AS record_id
        FROM x_daily""",
)
def _rid(t: Tables):
    n = F.col("interval_count")
    rid = Q.record_id(
        F.lit("au"),
        F.lit("NEM"),
        F.when(F.col("energy") > 30, F.col("network_region")),
        F.col("fueltech_id"),
        F.when(n % 2 == 0, "renewable_proportion").otherwise("energy"),
        F.when(n % 3 == 0, "season").otherwise("day"),
        F.lit("high"),
        F.col("interval"),
    )
    return t.daily().select("interval", rid.alias("record_id"))


@query(
    "r9_chain",
    f"""WITH {_FOUND} SELECT record_id, interval, lag(interval) OVER (PARTITION BY record_id ORDER BY interval) IS NOT NULL AS linked FROM found""",
)
def _chain(t: Tables):
    linked = Q.chain(found(t).drop("previous_instance_id"), chunk="day")
    return linked.select("record_id", "interval", F.col("previous_instance_id").isNotNull().alias("linked"))


@query(
    "r10_is_new",
    """WITH p AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT event_id, coalesce(ts > pt AND value <> 0 AND CASE WHEN event_id % 2 = 0 THEN
                CASE WHEN event_id % 3 = 0 THEN round_even(value, 2) > round_even(pv, 2) ELSE round_even(value, 0) > round_even(pv, 0) END
            ELSE CASE WHEN event_id % 3 = 0 THEN round_even(value, 2) < round_even(pv, 2) ELSE round_even(value, 0) < round_even(pv, 0) END
            END, false) AS is_new FROM p""",
)
def _new(t: Tables):
    from wattframe.operators.ordered import lag_row

    rows = t.read("events").select("event_id", "user_id", "ts", "value")
    rows = lag_row(rows, ["user_id"], "ts", ["ts", "value"], chunk="day")
    n = F.col("event_id")
    new = Q.is_new(
        F.when(n % 2 == 0, "high").otherwise("low"),
        F.when(n % 3 == 0, "renewable_proportion").otherwise("power"),
        F.col("ts"),
        F.col("value"),
        F.col("prev_ts"),
        F.col("prev_value"),
    )
    return rows.select("event_id", new.alias("is_new"))


@query(
    "r11_debounce",
    f"""WITH RECURSIVE {_FOUND},
        kept(record_id, interval) AS (
            SELECT record_id, min(interval) FROM found WHERE period = 'interval' GROUP BY 1
            UNION ALL
            SELECT k.record_id, (SELECT min(f.interval) FROM found f WHERE f.record_id = k.record_id
                AND f.interval >= k.interval + INTERVAL 50 MINUTES) FROM kept k WHERE k.interval IS NOT NULL)
        SELECT record_id, interval, period, aggregate, value FROM found WHERE period <> 'interval'
        UNION ALL SELECT record_id, interval, period, aggregate, value FROM found JOIN kept USING (record_id, interval)
            WHERE period = 'interval'""",
)
def _debounced(t: Tables):
    return Q.debounce(stored(t)).select("record_id", "interval", "period", "aggregate", "value")


@query(
    "r11_debounce_spaced",
    """WITH RECURSIVE pts AS (
            SELECT 'u' || (user_id % 20) AS record_id, time_bucket(INTERVAL '5 minutes', ts) AS interval FROM events GROUP BY 1, 2),
        kept(record_id, interval) AS (
            SELECT record_id, min(interval) FROM pts GROUP BY 1
            UNION ALL
            SELECT k.record_id, (SELECT min(p.interval) FROM pts p
                WHERE p.record_id = k.record_id AND p.interval >= k.interval + INTERVAL 50 MINUTES)
            FROM kept k WHERE k.interval IS NOT NULL)
        SELECT record_id, interval FROM kept WHERE interval IS NOT NULL""",
)
def _spaced(t: Tables):
    rows = (
        t.read("events")
        .select(
            F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("record_id"),
            bucket("ts", "5m").alias("interval"),
            F.lit("interval").alias("period"),
        )
        .distinct()
    )
    return Q.debounce(rows).select("record_id", "interval")


# The day before the clock is the one period that has both ended and data; the interval opens at the clock.
_CHECK = f"""{_FOUND},
    state AS (SELECT record_id, max(interval) AS pi, arg_max(value, interval) AS pv FROM found WHERE interval < TIMESTAMP '2024-01-26' GROUP BY 1),
    due AS (SELECT *, round(value, 6) AS raw, CASE WHEN metric = 'renewable_proportion' THEN 2 ELSE 0 END AS digits,
            CASE metric WHEN 'energy' THEN 1000 WHEN 'emissions' THEN 1000 WHEN 'renewable_proportion' THEN 0 WHEN 'price' THEN 0 ELSE 100 END AS floor
        FROM base WHERE value IS NOT NULL AND ((period = 'interval' AND interval >= TIMESTAMP '2024-01-30 12:00:00'
                AND interval < TIMESTAMP '2024-01-30 12:05:00')
            OR (period = 'day' AND interval = TIMESTAMP '2024-01-29'))),
    turned AS (SELECT *, CASE digits WHEN 2 THEN round_even(raw, 2) ELSE round_even(raw, 0) END AS rounded FROM due),
    sides AS (SELECT *, 'high' AS aggregate FROM turned WHERE rounded > floor
        UNION ALL SELECT *, 'low' FROM turned WHERE interval_count >= 1 AND (raw > 0 OR metric = 'price')),
    shaped AS (SELECT interval, network_region, period, aggregate, raw, rounded,
            CASE WHEN metric = 'demand' THEN 'demand' ELSE fueltech_id END AS fueltech_id,
            CASE WHEN metric = 'demand' AND period = 'interval' THEN 'power' WHEN metric = 'demand' THEN 'energy' ELSE metric END AS metric FROM sides),
    marked AS (SELECT *, lower(concat_ws('.', 'au', 'NEM', network_region, fueltech_id,
            CASE WHEN metric = 'renewable_proportion' THEN 'renewables.proportion' ELSE metric END, period, aggregate)) AS record_id FROM shaped),
    faced AS (SELECT m.*, pi, pv, CASE WHEN metric = 'renewable_proportion' THEN round_even(rounded, 2) ELSE round_even(rounded, 0) END AS n,
            CASE WHEN metric = 'renewable_proportion' THEN round_even(pv, 2) ELSE round_even(pv, 0) END AS b
        FROM marked m LEFT JOIN state USING (record_id))"""


@query(
    "r12_check_period",
    f"""WITH {_CHECK}
        SELECT record_id, interval, aggregate, metric, period, round(rounded, 4) AS value,
            sha256(record_id || '|' || strftime(pi, '%Y-%m-%d %H:%M:%S')) AS previous_instance_id,
            CASE WHEN abs((raw - pv) / nullif(abs(pv), 0) * 100) < 9999 AND abs((raw - pv) / nullif(abs(pv), 0) * 100) > 0.01
                THEN {r2("(raw - pv) / nullif(abs(pv), 0) * 100")} END AS pct_change
        FROM faced WHERE pi IS NULL OR (interval > pi AND rounded <> 0 AND CASE WHEN aggregate = 'high' THEN n > b ELSE n < b END
            AND (period <> 'interval' OR epoch(interval) - epoch(pi) >= 3000))""",
)
def _check(t: Tables):
    all_found = stored(t)
    now = datetime(2024, 1, 30, 12)
    state = Q.current_state(all_found.filter(F.col("interval") < F.lit("2024-01-26").cast("timestamp_ntz")))
    lenient = {k: 1 for k in Q.THRESHOLDS}
    steady = base(t).withColumn("value", F.round("value", 6))
    new = Q.check_period(steady, state, now, completeness=lenient)
    return new.select("record_id", "interval", "aggregate", "metric", "period", "value", "previous_instance_id", "pct_change")


@query(
    "r13_current_state",
    f"""WITH {_FOUND} SELECT record_id, interval, value FROM (
            SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY interval DESC) AS rn FROM found) WHERE rn = 1""",
)
def _state(t: Tables):
    return Q.current_state(found(t)).select("record_id", "interval", "value")


@query(
    "r14_completed_days",
    """SELECT DISTINCT date_trunc('day', interval)::TIMESTAMP AS day, date_trunc('day', interval) = '2024-01-29' AS is_last FROM x_ms""",
)
def _days(t: Tables):
    start, _ = Q.completed_periods(datetime(2024, 1, 30, 9))["day"]
    day = bucket("interval", "1d")
    return t.ms().select(day.alias("day"), (day == F.lit(start).cast("timestamp_ntz")).alias("is_last")).distinct()


def _cases(t: Tables):
    """Attribute mixes of records taken from the line items."""
    from wattframe.plans.tables import pick

    n = F.col("l_orderkey")
    techs = ("solar", "wind", "coal", "gas", "renewables", "fossils", "battery_charging", "battery_discharging", "demand", "hydro")
    return t.read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(n % 4 == 0, "WEM").otherwise("NEM").alias("network_id"),
        F.when(n % 3 == 0, "NSW1").alias("network_region"),
        F.when(n % 11 != 0, pick(techs, F.col("l_partkey") % 10)).alias("fueltech_id"),
        pick(("power", "energy", "emissions", "price", "renewable_proportion"), F.col("l_suppkey") % 5).alias("metric"),
        pick(("interval", "day", "month", "quarter", "season", "year", "financial_year", "7d"), F.col("l_partkey") % 8).alias("period"),
        F.when(F.col("l_linenumber") % 2 == 0, "high").otherwise("low").alias("aggregate"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("interval"),
    )


_CASES = """cases AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN 'WEM' ELSE 'NEM' END AS network_id,
            CASE WHEN l_orderkey % 3 = 0 THEN 'NSW1' END AS network_region,
            CASE WHEN l_orderkey % 11 <> 0 THEN (['solar', 'wind', 'coal', 'gas', 'renewables', 'fossils', 'battery_charging',
                'battery_discharging', 'demand', 'hydro'])[1 + l_partkey % 10] END AS fueltech_id,
            (['power', 'energy', 'emissions', 'price', 'renewable_proportion'])[1 + l_suppkey % 5] AS metric,
            (['interval', 'day', 'month', 'quarter', 'season', 'year', 'financial_year', '7d'])[1 + l_partkey % 8] AS period,
            CASE WHEN l_linenumber % 2 = 0 THEN 'high' ELSE 'low' END AS aggregate, l_shipdate::TIMESTAMP AS interval FROM lineitem)"""


def score_sql(source: str) -> str:
    """`source` with the columns a record is scored by, and its significance."""
    return f"""SELECT * EXCLUDE (hi, top, total), (CASE
            WHEN fueltech_id = 'battery_charging' THEN CASE WHEN hi THEN top - 2 ELSE 1 END
            WHEN metric IN ('power', 'energy') AND period IN ('interval', 'day', 'quarter', 'year') AND hi
                AND fueltech_id IN ('solar', 'wind', 'renewables', 'battery_discharging') THEN top
            WHEN metric IN ('power', 'energy') AND period IN ('interval', 'day', 'quarter', 'year') AND NOT hi
                AND fueltech_id IN ('fossils', 'coal', 'gas') THEN top
            WHEN fueltech_id = 'demand' AND period IN ('interval', 'day') AND hi THEN top
            WHEN metric = 'renewable_proportion' AND period IN ('interval', 'day', '7d') THEN CASE WHEN hi THEN top ELSE top - 5 END
            WHEN fueltech_id = 'renewables' AND metric = 'emissions' THEN 0
            WHEN NOT hi AND fueltech_id IN ('distillate', 'solar', 'battery_discharging', 'hydro', 'pumps') THEN 1
            WHEN metric = 'price' THEN 1 ELSE round_even(total, 0) END)::INT AS significance
        FROM (SELECT *, aggregate = 'high' AS hi, CASE WHEN network_region IS NULL THEN 10 ELSE 9 END AS top,
            round((CASE period WHEN 'interval' THEN 1 WHEN 'day' THEN 9 WHEN 'month' THEN 9 WHEN 'quarter' THEN 5 WHEN 'season' THEN 5
                WHEN 'year' THEN 10 WHEN 'financial_year' THEN 4 ELSE 2 END) * 0.3
            + (CASE metric WHEN 'power' THEN 1 WHEN 'energy' THEN 9 WHEN 'emissions' THEN 9 WHEN 'price' THEN 6 ELSE 10 END) * 0.25
            + (CASE network_id WHEN 'NEM' THEN 10 ELSE 5 END) * 0.1 + (CASE WHEN network_region IS NULL THEN 10 ELSE 5 END) * 0.15
            + (CASE WHEN fueltech_id IS NULL THEN 0 WHEN fueltech_id IN ('solar', 'wind', 'hydro', 'bioenergy', 'pumps', 'battery_charging',
                'battery_discharging') THEN CASE WHEN aggregate = 'high' THEN 10 ELSE 3 END ELSE 5 END) * 0.1
            + (CASE WHEN aggregate = 'high' THEN 10 ELSE 5 END) * 0.1, 6)::DOUBLE AS total FROM {source})"""


@query(
    "r15_significance",
    f"""WITH {_CASES} SELECT l_orderkey, l_linenumber, significance FROM ({score_sql("cases")})""",
)
def _significance(t: Tables):
    parts = [F.col(c) for c in ("network_id", "network_region", "fueltech_id", "metric", "period", "aggregate")]
    return _cases(t).select("l_orderkey", "l_linenumber", Q.significance(*parts).alias("significance"))


@query(
    "r16_describe",
    f"""WITH {_CASES} SELECT l_orderkey, l_linenumber, concat_ws(' ', CASE period WHEN 'interval' THEN 'Interval' WHEN 'day' THEN 'Daily'
                WHEN 'month' THEN 'Monthly' WHEN 'quarter' THEN 'Quarterly' WHEN 'year' THEN 'Annual'
                WHEN 'financial_year' THEN 'Financial year' WHEN '7d' THEN '7d' ELSE CASE WHEN month(interval) IN (12, 1, 2) THEN 'Summer'
                    WHEN month(interval) <= 5 THEN 'Autumn' WHEN month(interval) <= 8 THEN 'Winter' ELSE 'Spring' END END,
            CASE fueltech_id WHEN 'battery_charging' THEN 'Battery (charging)' WHEN 'battery_discharging' THEN 'Battery (discharging)'
                ELSE upper(fueltech_id[1]) || fueltech_id[2:] END,
            CASE metric WHEN 'power' THEN 'Generation' WHEN 'renewable_proportion' THEN 'Renewable_proportion'
                ELSE upper(metric[1]) || metric[2:] END, aggregate, 'record for', network_id,
            CASE WHEN network_region IS NOT NULL THEN 'in New South Wales' END) AS description FROM cases""",
)
def _describe(t: Tables):
    parts = [F.col(c) for c in ("network_id", "network_region", "fueltech_id", "metric", "period", "aggregate", "interval")]
    return _cases(t).select("l_orderkey", "l_linenumber", Q.describe(*parts).alias("description"))


@query(
    "r17_search",
    f"""WITH {_FOUND} SELECT record_id, interval, value FROM found WHERE interval BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'
            AND aggregate = 'high' AND network_region IN ('NSW1', 'VIC1') AND metric IN ('power', 'energy') AND record_id LIKE 'au.nem.%.interval.%'""",
)
def _search(t: Tables):
    rows = Q.search(
        found(t),
        start=datetime(2024, 1, 2),
        end=datetime(2024, 1, 20),
        aggregate="high",
        regions=["NSW1", "VIC1"],
        metrics=["power", "energy"],
        pattern="AU.NEM.*.interval.*",
    )
    return rows.select("record_id", "interval", "value")


@query(
    "r17_search_network_wide",
    f"WITH {_FOUND} SELECT record_id, interval, value FROM found WHERE network_region IS NULL AND fueltech_id IN ('wind', 'solar')",
)
def _search_wide(t: Tables):
    return Q.search(found(t), fueltechs=["wind", "solar"]).select("record_id", "interval", "value")


@query(
    "w5_page",
    """SELECT event_id, ts, value, (SELECT count(*) FROM events) AS total FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 100""",
)
def _page(t: Tables):
    rows = t.read("events").select("event_id", "ts", "value")
    return Q.page(rows, [F.col("value").desc(), F.col("event_id")], 50, 3)


@query("w5_page_after", "SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 100")
def _page_after(t: Tables):
    """The third page, each found by the last key of the one before."""
    rows, order = t.read("events").select("event_id", "ts", "value"), [("value", False), ("event_id", True)]
    key = None
    for _ in range(2):
        last = Q.page_after(rows, order, 50, key).agg(F.min("value"), F.max_by("event_id", F.struct(-F.col("value"), "event_id"))).first()
        key = tuple(last)
    return Q.page_after(rows, order, 50, key)


@query(
    "r18_history",
    f"""WITH {_FOUND} SELECT record_id, interval, value FROM found WHERE record_id = 'au.nem.power.interval.high'
            AND interval < TIMESTAMP '2024-01-20' ORDER BY interval DESC LIMIT 40""",
)
def _history(t: Tables):
    return Q.history(found(t), "au.nem.power.interval.high", datetime(2024, 1, 20), n=40).select("record_id", "interval", "value")


@query(
    "r19_reconcile",
    f"WITH {_FOUND} SELECT record_id, interval, value FROM found",
)
def _reconcile(t: Tables):
    every = stored(t)
    lost = F.abs(F.hash("record_id")) % 3 == 0
    return Q.reconcile(every.filter(~lost), every, END).select("record_id", "interval", "value")


@query(
    "r19_gap_start",
    f"WITH {_FOUND} SELECT max(interval) AS last, date_trunc('day', max(interval))::TIMESTAMP AS recompute_from FROM found",
)
def _gap(t: Tables):
    return Q.gap_start(found(t), END + timedelta(days=20))


_SCORED = f"""{_FOUND}, scored AS ({score_sql("(SELECT *, 'NEM' AS network_id FROM found)")})"""


@query(
    "r20_highlights",
    f"""WITH {_SCORED},
        week AS (SELECT record_id, interval, aggregate, metric, period, value, significance FROM scored
            WHERE interval BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-08' AND significance >= 8
                AND NOT (aggregate = 'low' AND fueltech_id IS NOT DISTINCT FROM 'demand'))
        SELECT * FROM week WHERE significance >= 9 OR (SELECT count(*) FROM week WHERE significance >= 9) < 3""",
)
def _highlights(t: Tables):
    told = Q.highlights(stored(t), datetime(2024, 1, 1), datetime(2024, 1, 8))
    return told.select("record_id", "interval", "aggregate", "metric", "period", "value", "significance")


@query(
    "r21_repair",
    f"WITH {_FOUND} SELECT record_id, interval, value FROM found",
)
def _repair(t: Tables):
    every = stored(t)
    broken = every.withColumn("value", F.when(F.col("record_id").like("%.demand.%"), F.col("value") * 1000).otherwise(F.col("value")))
    return Q.repair(broken, "%.demand.%", every).select("record_id", "interval", "value")


@query(
    "r21_repair_report",
    f"""WITH {_FOUND} SELECT count(*) AS before, count(*) AS before_odd_units, count(*) AS stored, 0 AS stored_odd_units,
            count(*) AS attempted, 0 AS attempted_odd_units, true AS sound FROM found WHERE record_id LIKE '%.demand.power.%'""",
)
def _repair_report(t: Tables):
    every = stored(t)
    pattern = "%.demand.power.%"
    broken = every.withColumn(
        "value_unit", F.when(F.col("record_id").like(pattern), "GW").otherwise(F.col("value_unit"))
    )
    fixed = Q.repair(broken, pattern, every)
    return Q.repair_report(broken, fixed, every, pattern, "MW")
