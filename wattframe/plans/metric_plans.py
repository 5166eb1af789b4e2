"""The metric registry and the rollups."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from wattframe.functions.lookups import NETWORKS
from wattframe.operators import metrics as M
from wattframe.operators import rollups as R
from wattframe.plans.catalog import query
from wattframe.plans.sqltext import r6
from wattframe.plans.tables import END, START, Tables
from wattframe.plans.time_plans import _DUCK_BUCKET

_DATA = {
    "power": ({"a": "sum(generated)"}, "round(avg(a), 6)"),
    "energy": ({"b": "sum(energy)"}, "round(sum(b), 6)"),
    "emissions": ({"c": "sum(emissions)"}, "round(sum(c), 6)"),
    "market_value": ({"d": "sum(market_value)"}, "round(sum(d), 6)"),
    "storage_battery": (
        {"e": "sum(coalesce(energy_storage, 0))", "f": "count(energy_storage)"},
        "round(sum(e) / nullif(sum(f), 0), 6)",
    ),
}


def _mean(c, k=1):
    return ({f"s_{c}": f"sum({c})"}, f"round(avg(s_{c} * {k}), 6)")


def _total(c):
    return ({f"s_{c}": f"sum({c})"}, f"round(sum(s_{c}), 6)")


def _share(a, b):
    return (
        {f"s_{a}": f"sum({a})", f"s_{b}": f"sum({b})"},
        f"CASE WHEN sum(s_{b}) > 0 THEN round(sum(s_{a}) / sum(s_{b}) * 100, 2) END",
    )


_MARKET = {
    "price": ({"ps": "sum(price)", "pc": "count(price)"}, "round(sum(ps) / nullif(sum(pc), 0), 6)"),
    "demand": _mean("demand"),
    "demand_energy": _total("demand_energy"),
    "demand_gross": _mean("demand_gross"),
    "demand_gross_energy": _total("demand_gross_energy"),
    "generation_renewable": _mean("generation_renewable"),
    "generation_renewable_energy": _total("generation_renewable_energy"),
    "generation_renewable_with_storage": _mean("generation_renewable_with_storage"),
    "generation_renewable_with_storage_energy": _total("generation_renewable_with_storage_energy"),
    "curtailment": _mean("curtailment_total"),
    "curtailment_energy": _total("curtailment_energy_total"),
    "curtailment_solar_utility": _mean("curtailment_solar_total"),
    "curtailment_wind": _mean("curtailment_wind_total"),
    "curtailment_solar_utility_energy": _total("curtailment_energy_solar_total"),
    "curtailment_wind_energy": _total("curtailment_energy_wind_total"),
    "flow_imports": _mean("energy_imports", 12),
    "flow_exports": _mean("energy_exports", 12),
    "flow_imports_energy": _total("energy_imports"),
    "flow_exports_energy": _total("energy_exports"),
    "renewable_proportion": _share("generation_renewable", "demand_gross"),
    "renewable_with_storage_proportion": _share("generation_renewable_with_storage", "demand_gross"),
}


def series_sql(table, metrics, interval, keys=(), where="true", network=("NEM", "AEMO_ROOFTOP"), labels=None) -> str:
    """The two-stage aggregate in SQL."""
    plans = _MARKET if table == "x_ms" else _DATA
    inner: dict[str, str] = {}
    for m in metrics:
        inner.update(plans[m][0])
    labels = labels or {"fueltech_id": "fueltech", "fueltech_group_id": "fueltech_group", "status_id": "status"}
    group = "".join(f", {k}" for k in keys)
    shown = "".join(f", {k} AS {labels.get(k, k)}" for k in keys)
    codes = ", ".join(f"'{n}'" for n in network)
    return f"""WITH stage AS (SELECT interval{group}, {", ".join(f"{e} AS {a}" for a, e in inner.items())}
            FROM {table} WHERE network_id IN ({codes}) AND {where} GROUP BY interval{group})
        SELECT {_DUCK_BUCKET[interval]} AS interval, '{network[0]}' AS network{shown},
            {", ".join(f"{plans[m][1]} AS {m}" for m in metrics)}
        FROM stage GROUP BY {_DUCK_BUCKET[interval]}{group}"""


ALL_DATA = list(_DATA)
FOUR = ALL_DATA[:4]


@query(
    "a1_energy_by_region_fueltech_1d",
    series_sql("x_ui", FOUR, "1d", ["network_region", "fueltech_id"]),
)
def _flagship(t: Tables):
    return M.timeseries(t.ui(), FOUR, "1d", START, END, ["region", "fueltech"])


@query("a1_energy_by_region_fueltech_1h", series_sql("x_ui", FOUR, "1h", ["network_region", "fueltech_id"]))
def _hourly(t: Tables):
    return M.timeseries(t.ui(), FOUR, "1h", START, END, ["region", "fueltech"])


@query("a1_network_5m", series_sql("x_ui", FOUR, "5m"))
def _network(t: Tables):
    return M.timeseries(t.ui(), FOUR, "5m", START, END)


@query(
    "x11_request_4d",
    series_sql(
        "x_ui", FOUR, "5m",
        where="""interval >= TIMESTAMP '2024-01-27' AND interval < TIMESTAMP '2024-01-31'
            AND interval < (SELECT max(interval) FROM x_ui WHERE interval > TIMESTAMP '2024-01-24')""",
    ),
)
def _request(t: Tables):
    return M.request(t.ui(), FOUR, "5m", END)


@query("n18_expand_network_two_rooftops", series_sql("x_ui", FOUR, "1d", ["network_region", "fueltech_id"]))
def _two_rooftops(t: Tables):
    """Half of the rooftop rows come from a second feed that the caller's registry names."""
    east = replace(NETWORKS["NEM"], feeds=("AEMO_ROOFTOP", "ROOFTOP_HISTORY"))
    older = (F.col("network_id") == "AEMO_ROOFTOP") & (F.dayofmonth("interval") <= 15)
    rows = t.ui().withColumn("network_id", F.when(older, "ROOFTOP_HISTORY").otherwise(F.col("network_id")))
    return M.timeseries(rows, FOUR, "1d", START, END, ["region", "fueltech"], networks={**NETWORKS, "NEM": east})


@query("a1_network_week", series_sql("x_ui", FOUR, "7d"))
def _week(t: Tables):
    return M.timeseries(t.ui(), FOUR, "7d", START, END)


@query("a2_data_metrics", series_sql("x_ui", ALL_DATA, "1d", ["fueltech_group_id"]))
def _data(t: Tables):
    return M.timeseries(t.ui(), ALL_DATA, "1d", START, END, ["fueltech_group"])


@query("a3_market_metrics_region_1d", series_sql("x_ms", list(_MARKET), "1d", ["network_region"]))
def _market_region(t: Tables):
    return M.timeseries(t.ms(), list(_MARKET), "1d", START, END, ["region"], kind="market")


@query("a3_market_metrics_network_1h", series_sql("x_ms", list(_MARKET), "1h"))
def _market_network(t: Tables):
    return M.timeseries(t.ms(), list(_MARKET), "1h", START, END, kind="market")


_SHARES = ["renewable_proportion", "renewable_with_storage_proportion"]


@query("a4_proportions_month", series_sql("x_ms", _SHARES, "1M", ["network_region"], network=("WEM", "APVI")))
def _proportions(t: Tables):
    return M.timeseries(t.ms(), _SHARES, "1M", START, END, ["region"], network="WEM", kind="market")


@query(
    "a5_groupings_renewable_status",
    series_sql("x_ui", FOUR, "1d", ["renewable", "status_id"]),
)
def _renewable_status(t: Tables):
    return M.timeseries(t.ui(), FOUR, "1d", START, END, ["renewable", "status"])


@query("a5_facility_form", series_sql("x_ui", ["power", "energy"], "1d", ["facility_code", "unit_code"]))
def _facility(t: Tables):
    return M.timeseries(t.ui(), ["power", "energy"], "1d", START, END, kind="facility")


@query(
    "a6_filters",
    series_sql(
        "x_ui",
        FOUR,
        "1h",
        ["network_region", "fueltech_group_id"],
        "network_region = 'NSW1' AND fueltech_group_id IN ('wind', 'solar') AND interval >= TIMESTAMP '2024-01-05' "
        "AND interval < TIMESTAMP '2024-01-20'",
    ),
)
def _filters(t: Tables):
    return M.timeseries(
        t.ui(),
        FOUR,
        "1h",
        datetime(2024, 1, 5),
        datetime(2024, 1, 20),
        filters={"network_region": "NSW1", "fueltech_group": ["wind", "solar"]},
    )


@query(
    "a6_filters_facility_unit",
    series_sql(
        "x_ui",
        ["energy"],
        "1d",
        ["facility_code", "unit_code"],
        "facility_code IN ('F1', 'F2', 'F3', 'F4') AND unit_code IN ('U4', 'U8', 'U9', 'U12')",
    ),
)
def _facility_filter(t: Tables):
    filters = {"facility_code": ["F1", "F2", "F3", "F4"], "unit_code": ["U4", "U8", "U9", "U12"]}
    return M.timeseries(t.ui(), ["energy"], "1d", START, END, filters=filters, kind="facility")


# --- rollups -----------------------------------------------------------------------------


def rounded(df, digits: int = 6):
    """Float measures rounded, so the order of summation does not show."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.typeName() == "double"})


_DAYS = "date_trunc('day', interval)::TIMESTAMP"
_S = "round(sum({0}), 6) AS {0}"
_PAIR = "round(sum(coalesce(energy_storage, 0)), 6) AS energy_storage_sum, count(energy_storage) AS energy_storage_count"
_FULL = "count(DISTINCT interval) * 1000000000 + max(version) AS version"
_VALUES = f"{_S.format('emissions')}, {_S.format('market_value')}"
_CLAMPED = "round(sum(greatest(generated, 0)), 6) AS generated, round(sum(greatest(energy, 0)), 6) AS energy"
_NO_STORAGE = "fueltech_id NOT IN ('pumps', 'battery', 'battery_charging', 'battery_discharging')"

UNIT_DAILY_SQL = f"""SELECT {_DAYS} AS date, network_id, network_region, facility_code, unit_code, fueltech_id,
        fueltech_group_id, max(renewable) AS renewable, max(status_id) AS status_id, {_S.format("generated")},
        {_S.format("energy")}, {_PAIR}, {_VALUES}, count(*) AS interval_count, {_FULL}
    FROM x_ui GROUP BY ALL"""


@query("a7_unit_daily", UNIT_DAILY_SQL)
def _unit_daily(t: Tables):
    return rounded(R.unit_daily(t.ui()))


@query(
    "a8_fueltech_interval",
    f"""SELECT interval, network_id, network_region, fueltech_id, fueltech_group_id, {_S.format("generated")},
            {_S.format("energy")}, {r6("avg(energy_storage)")} AS energy_storage, {_VALUES}, count(*) AS unit_count, max(version) AS version
        FROM x_ui GROUP BY 1, 2, 3, 4, 5""",
)
def _fueltech_interval(t: Tables):
    return rounded(R.fueltech_interval(t.ui()))


@query(
    "a9_fueltech_daily",
    f"""SELECT {_DAYS} AS date, network_id, network_region, fueltech_id, fueltech_group_id, {_S.format("generated")},
            {_S.format("energy")}, {_PAIR}, {_VALUES}, count(*) AS unit_count, count(DISTINCT interval) AS interval_count, {_FULL}
        FROM x_ui GROUP BY 1, 2, 3, 4, 5""",
)
def _fueltech_daily(t: Tables):
    return rounded(R.fueltech_daily(t.ui()))


@query(
    "a10_renewable_interval",
    f"""SELECT interval, network_id, network_region, renewable, {_CLAMPED}, {r6("avg(energy_storage)")} AS energy_storage, {_VALUES},
            count(*) AS unit_count, max(version) AS version FROM x_ui WHERE {_NO_STORAGE} GROUP BY 1, 2, 3, 4""",
)
def _renewable_interval(t: Tables):
    return rounded(R.renewable_interval(t.ui()))


@query(
    "a11_renewable_daily",
    f"""SELECT {_DAYS} AS date, network_id, network_region, renewable, {_CLAMPED}, {_PAIR}, {_VALUES}, count(*) AS unit_count,
            count(DISTINCT interval) AS interval_count, {_FULL} FROM x_ui WHERE {_NO_STORAGE} GROUP BY 1, 2, 3, 4""",
)
def _renewable_daily(t: Tables):
    return rounded(R.renewable_daily(t.ui()))


def _market_sql(bucket: str, name: str, suffix: str, where: str = "true") -> str:
    sums = ", ".join(f"round(sum({c}), 4) AS {c}_sum" for c in R.MARKET_SUMS)
    period = ", ".join(f"round(sum({c}), 4) AS {c}_{suffix}" for c in R.MARKET_PERIOD)
    return f"""SELECT {bucket} AS {name}, network_id, network_region, round(sum(price), 4) AS price_sum,
            count(price) AS price_count, {sums}, {period}, count(*) AS interval_count, {_FULL}
        FROM x_ms WHERE {where} GROUP BY 1, 2, 3"""


MARKET_DAILY_SQL = _market_sql(_DAYS, "date", "daily")


@query("a12_market_daily", MARKET_DAILY_SQL)
def _market_daily(t: Tables):
    return rounded(R.market_daily(t.ms()), 4)


@query("a13_market_monthly", _market_sql("date_trunc('month', interval)::TIMESTAMP", "month", "monthly"))
def _market_monthly(t: Tables):
    return rounded(R.market_monthly(t.ms()), 4)


@query("a14_rebuild", MARKET_DAILY_SQL)
def _rebuild(t: Tables):
    """A rollup that missed late rows, healed, equals the direct rollup."""
    late = (F.col("interval") >= F.lit("2024-01-10 06:00:00").cast("timestamp_ntz")) & (F.col("version") % 3 == 0)
    stale = R.market_daily(t.ms().filter(~late))
    healed = R.rebuild(R.market_daily, t.ms(), stale, datetime(2024, 1, 10, 6), datetime(2024, 1, 30, 23))
    return rounded(healed, 4)


@query(
    "a15_monthly_from_daily",
    """SELECT date_trunc('month', interval)::TIMESTAMP AS month, network_id, network_region,
            round(sum(demand_total_energy), 4) AS demand_total_energy_daily,
            round(sum(demand_total_market_value), 4) AS demand_total_market_value_daily FROM x_ms GROUP BY 1, 2, 3""",
)
def _from_daily(t: Tables):
    columns = ["demand_total_energy_daily", "demand_total_market_value_daily"]
    return rounded(R.monthly_from_daily(R.market_daily(t.ms()), columns), 4)


@query(
    "a35_verify_rollup",
    """SELECT network_region, count(*) AS records, min(interval) AS first_at, max(interval) AS last_at FROM x_ms GROUP BY 1""",
)
def _verify(t: Tables):
    return R.verify_rollup(t.ms(), ["network_region"], "interval")
