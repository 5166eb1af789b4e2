"""Series and reports on top of the facts, rollups and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.lookups import NETWORKS, Network, fueltech_group, is_renewable
from wattframe.functions.timebucket import bucket, check_span, floor_minutes, snap_window, step_lit, ts_lit, week_start
from wattframe.operators.flows import flow_energy, flow_power
from wattframe.operators.gapfill import gapfill, interpolate
from wattframe.operators.history import live_months
from wattframe.operators.metrics import timeseries


def steady(total: Column) -> Column:
    """A sum without its last digits, which depend on the order of addition.

    Rounding to print afterwards then gives the same text on every run.
    """
    return F.round(total, 6)


DAILY_OR_LONGER = ("1d", "7d", "1M", "3M", "season", "1y", "fy")


def _between(column: str, start, end) -> Column:
    return F.col(column).between(ts_lit(start), ts_lit(end))


def pick_rollup(interval: str, fine: DataFrame, daily: DataFrame) -> DataFrame:
    """The daily rollup for buckets of a day or more, else the fine one."""
    if interval in DAILY_OR_LONGER:
        return daily.withColumnRenamed("date", "interval")
    return fine


def _network_filter(network: str, networks: dict[str, Network] = NETWORKS) -> Column:
    """All feeds of a network, with western rooftop kept to its region."""
    codes = [c for c in networks[network].codes if c != "APVI"]
    condition = F.col("network_id").isin(*codes)
    if network == "WEM":
        condition = condition | ((F.col("network_id") == "APVI") & (F.col("network_region") == "WEM"))
    return condition


def _fueltech_rows(fine, daily, interval, start, end, network, region, excluded) -> DataFrame:
    rows = pick_rollup(interval, fine, daily).filter(
        _between("interval", start, end) & _network_filter(network) & ~F.col("fueltech_id").isin(*excluded)
    )
    if region:
        rows = rows.filter(F.col("network_region") == region)
    return rows.groupBy(bucket("interval", interval).alias("interval"), F.col("fueltech_id").alias("fueltech_code"))


def power_by_fueltech(fine: DataFrame, daily: DataFrame, interval: str, start, end, network: str = "NEM", region: str | None = None) -> DataFrame:
    """Power, emissions and intensity per technology; rooftop comes on its own."""
    grouped = _fueltech_rows(fine, daily, interval, start, end, network, region, ("solar_rooftop", "battery"))
    power, out = F.sum("generated"), F.sum("emissions")
    return grouped.agg(
        F.round(power, 4).alias("fueltech_power"),
        F.round(out, 4).alias("fueltech_emissions"),
        F.round(out / F.nullif(power, F.lit(0.0)), 4).alias("fueltech_emissions_intensity"),
    )


def energy_by_fueltech(fine: DataFrame, daily: DataFrame, interval: str, start, end, network: str = "NEM", region: str | None = None) -> DataFrame:
    """Energy in GWh, value and emissions per technology."""
    grouped = _fueltech_rows(fine, daily, interval, start, end, network, region, ("battery",))
    return grouped.agg(
        F.round(steady(F.sum("energy")) / 1000, 4).alias("fueltech_energy_gwh"),
        F.round(F.sum("market_value"), 2).alias("fueltech_market_value_dollars"),
        F.round(F.sum("emissions"), 4).alias("fueltech_emissions"),
    )


def price_demand(summary: DataFrame, interval: str, start, end, network: str = "NEM", region: str | None = None) -> DataFrame:
    """Mean price; demand and curtailment summed, per bucket."""
    rows = summary.filter((F.col("network_id") == network) & _between("interval", start, end))
    label = F.col("network_region") if region else F.lit(network)
    if region:
        rows = rows.filter(F.col("network_region") == region.upper())
    return rows.groupBy(
        bucket("interval", interval).alias("interval"), "network_id", label.alias("network_region")
    ).agg(
        F.avg("price").alias("price"),
        F.sum("demand").alias("demand"),
        F.sum("demand_total").alias("demand_total"),
        F.sum("curtailment_total").alias("curtailment_total"),
        F.sum("curtailment_solar_total").alias("curtailment_solar_utility_total"),
        F.sum("curtailment_wind_total").alias("curtailment_wind_total"),
    )


def demand_energy(summary: DataFrame, daily: DataFrame, interval: str, start: datetime, end: datetime, networks: Sequence[str] = ("NEM",), region: str | None = None) -> DataFrame:
    """Demand energy in GWh and its value; days and months off the daily rollup."""
    keys = ["network_id", *(["network_region"] if region else [])]
    if interval in ("1d", "1M"):
        rows, day = daily, F.col("date")
        energy, value = "demand_total_energy_daily", "demand_total_market_value_daily"
        lo = start.replace(hour=0, minute=0, second=0)
        lo = lo.replace(day=1) if interval == "1M" else lo
        rows = rows.filter((day >= ts_lit(lo)) & (day <= ts_lit(end)))
        at = bucket("date", interval)
    else:
        rows = summary.filter(_between("interval", start, end))
        energy, value = "demand_total_energy", "demand_total_market_value"
        # Fixed-width weeks begin on Monday here.
        at = week_start("interval", "monday") if interval == "7d" else bucket("interval", interval)
    rows = rows.filter(F.col("network_id").isin(*networks))
    if region:
        rows = rows.filter(F.col("network_region") == region)
    if interval == "1d":
        return rows.select(
            at.alias("interval"),
            *keys,
            F.round(steady(F.col(energy)) / 1000, 4).alias("demand_energy"),
            F.round(F.col(value), 4).alias("demand_market_value"),
        )
    return rows.groupBy(at.alias("interval"), *keys).agg(
        F.round(steady(F.sum(energy)) / 1000, 4).alias("demand_energy"),
        F.round(F.sum(value), 4).alias("demand_market_value"),
    )


def curtailment_energy(summary: DataFrame, interval: str, start, end, network: str = "NEM", region: str | None = None) -> DataFrame:
    """Curtailed energy in GWh; only the eastern market publishes it."""
    if network != "NEM":
        raise ValueError("curtailment is known for the NEM only")
    rows = summary.filter((F.col("network_id") == "NEM") & _between("interval", start, end))
    label = F.col("network_region") if region else F.lit("NEM")
    if region:
        rows = rows.filter(F.col("network_region") == region.upper())
    names = ("curtailment_energy_total", "curtailment_energy_solar_total", "curtailment_energy_wind_total")
    return rows.groupBy(bucket("interval", interval).alias("interval"), "network_id", label.alias("network_region")).agg(
        *[F.round(steady(F.sum(c)) / 1000, 4).alias(c) for c in names]
    )


# --- rooftop and weather -------------------------------------------------------------------


def _rooftop_units(units: DataFrame, feeds: Sequence[str], region: str | None) -> DataFrame:
    own = F.col("network_id").isin(*feeds)
    dims = units.filter(own)
    if region:
        dims = dims.filter(F.col("network_region") == region)
    return dims.select("unit_code", F.col("network_id").alias("_network"), "network_region", "fueltech_id")


def rooftop_combined(telemetry: DataFrame, units: DataFrame, start: datetime, end: datetime, feeds: Sequence[str] = ("AEMO_ROOFTOP",), region: str | None = None, chunk="month") -> DataFrame:
    """Rooftop power with forecasts where no actual is there, on five minutes."""
    lo, hi = snap_window(start, end)
    dims = _rooftop_units(units, feeds, region)
    rows = telemetry.filter(_between("interval", lo, hi)).join(dims, "unit_code")
    flag = F.col("is_forecast")
    half = floor_minutes("interval", 30).alias("interval")
    # Highest figure per feed, region and kind, in one pass over the rows.
    kinds = [
        F.max(F.when(keep, F.col(c))).alias(f"{c}_{name}")
        for c in ("generated", "energy")
        for name, keep in (("actual", ~flag), ("forecast", flag))
    ]
    best = rows.groupBy(half, "_network", "network_region").agg(*kinds, F.bool_and(flag).alias("is_forecast"))
    summed = best.groupBy("interval", F.lit("solar_rooftop").alias("fueltech_id")).agg(
        steady(F.sum(F.coalesce("generated_actual", "generated_forecast"))).alias("generated"),
        steady(F.sum(F.coalesce("energy_actual", "energy_forecast"))).alias("energy"),
        F.bool_or("is_forecast").alias("is_forecast"),
    )
    full = gapfill(summed, ["fueltech_id"], "interval", timedelta(minutes=5), lo, hi)
    full = interpolate(full, ["fueltech_id"], "interval", ["generated", "energy"], chunk)
    return full.filter(F.col("interval") >= ts_lit(start))


def rooftop_forecast(telemetry: DataFrame, units: DataFrame, start: datetime, end: datetime, feeds: Sequence[str] = ("AEMO_ROOFTOP",), region: str | None = None, chunk="month") -> DataFrame:
    """Forecast rooftop power on five minutes from its half-hourly points."""
    lo, hi = snap_window(start, end)
    dims = _rooftop_units(units, feeds, region)
    rows = telemetry.filter(_between("interval", lo, hi) & F.col("is_forecast")).join(dims, "unit_code")
    per = rows.groupBy(floor_minutes("interval", 5).alias("interval"), "fueltech_id").agg(
        F.coalesce(steady(F.sum("generated")), F.lit(0.0)).alias("generated"),
        F.coalesce(steady(F.sum("energy")), F.lit(0.0)).alias("energy"),
    )
    full = gapfill(per, ["fueltech_id"], "interval", timedelta(minutes=5), lo, hi)
    full = interpolate(full, ["fueltech_id"], "interval", ["generated", "energy"], chunk)
    return full.filter(F.col("interval") >= ts_lit(start))


def weather_series(observations: DataFrame, interval: str, start, end, stations: Sequence[str] | None = None, step: timedelta | None = None) -> DataFrame:
    """Mean, lowest and highest temperature per station and bucket, gaps kept."""
    from wattframe.functions.timebucket import FIXED_STEP

    rows = observations.filter(_between("observation_time", start, end))
    if stations:
        rows = rows.filter(F.col("station_id").isin(*stations))
    per = rows.groupBy(bucket("observation_time", interval).alias("interval"), "station_id").agg(
        F.avg("temp_air").alias("temp_air"),
        F.coalesce(F.min("temp_min"), F.min("temp_air")).alias("temp_min"),
        F.coalesce(F.max("temp_max"), F.max("temp_air")).alias("temp_max"),
    )
    return gapfill(per, ["station_id"], "interval", step or FIXED_STEP[interval], start, end)


# --- mixes ---------------------------------------------------------------------------------

# Technologies left out of the daily mix.
MIX_EXCLUDED = ("imports", "exports", "interconnector", "battery_discharging")


def _mix(telemetry, market, units, grain: str, measure: str, demand_scale: float, networks: Sequence[str], demand_networks) -> DataFrame:
    dims = units.filter(
        ~F.col("fueltech_id").isin(*MIX_EXCLUDED) & (F.col("dispatch_type") == "GENERATOR")
    ).select("unit_code", "fueltech_id")
    per_unit = (
        telemetry.filter(F.col("network_id").isin(*networks))
        .groupBy(bucket("interval", grain).alias("at"), "unit_code")
        .agg(F.sum(measure).alias("value"))
    )
    rows = per_unit.join(dims, "unit_code")
    by_tech = rows.groupBy(
        "at", fueltech_group(F.col("fueltech_id")).alias("fueltech_group"), is_renewable(F.col("fueltech_id")).alias("renewable")
    ).agg(steady(F.sum("value")).alias("value"))
    total = rows.groupBy("at").agg(steady(F.sum("value")).alias("total"))
    demand = (
        market.filter(F.col("network_id").isin(*demand_networks))
        .groupBy(bucket("interval", grain).alias("at"))
        .agg((steady(F.sum("demand_total")) * demand_scale).alias("demand_total"))
    )
    joined = by_tech.filter(F.col("fueltech_group").isNotNull()).join(total, "at").join(demand, "at", "left")
    return joined.select(
        "at",
        "fueltech_group",
        "renewable",
        F.round("value", 2).alias(measure),
        F.round("total", 2).alias("generated_total"),
        F.round("demand_total", 2).alias("demand_total"),
        F.round(F.col("value") / F.nullif(F.col("total"), F.lit(0.0)) * 100, 2).alias("generated_proportion"),
    )


def daily_mix(telemetry: DataFrame, market: DataFrame, units: DataFrame, start, end, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Energy share per technology group and day, with the day's totals."""
    inside = (F.col("interval") >= ts_lit(start)) & (F.col("interval") < ts_lit(end))
    out = _mix(telemetry.filter(inside), market.filter(inside), units, "1d", "energy", 1.0, networks[network].codes, (network,))
    return out.withColumnRenamed("at", "trading_day")


def time_of_day_mix(telemetry: DataFrame, market: DataFrame, units: DataFrame, start, end, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Power share per technology group and interval."""
    inside = (F.col("interval") >= ts_lit(start)) & (F.col("interval") < ts_lit(end))
    codes = networks[network].codes
    out = _mix(telemetry.filter(inside), market.filter(inside), units, "5m", "generated", 1 / 12, codes, codes)
    return out.withColumnRenamed("at", "interval")


def fold_other(mix: DataFrame, keys: Sequence[str], label: str, share: str, values: Sequence[str], cutoff: float = 1.0) -> DataFrame:
    """Shares up to the cutoff as one row "Other"; everything adds up."""
    name = F.when(F.col(share) > cutoff, F.col(label)).otherwise(F.lit("Other"))
    return mix.groupBy(*keys, name.alias(label)).agg(*[F.sum(c).alias(c) for c in (*values, share)])


# Groups that are not part of the weekly generation mix.
WEEKLY_EXCLUDED = ("battery", "battery_charging", "pumps")


def _two_weeks(daily: DataFrame, start: datetime) -> DataFrame:
    day = F.col("date")
    rows = daily.filter((day >= ts_lit(start - timedelta(days=7))) & (day < ts_lit(start + timedelta(days=7))))
    return rows.withColumn("_now", day >= ts_lit(start))


def _change(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before * 100)


def weekly_mix(unit_daily: DataFrame, start: datetime, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Monday-to-Sunday mix in GWh with shares and change on the week before."""
    rows = _two_weeks(unit_daily, start).filter(
        F.col("network_id").isin(*networks[network].codes)
        & F.col("fueltech_group_id").isNotNull()
        & ~F.col("fueltech_group_id").isin(*WEEKLY_EXCLUDED)
    )
    now = F.col("_now")
    per = rows.groupBy("fueltech_group_id").agg(
        F.count_if(now).alias("n"),
        F.round(F.sum(F.when(now, F.col("energy"))), 6).alias("energy"),
        F.round(F.sum(F.when(now, F.col("market_value"))), 6).alias("value"),
        F.round(F.sum(F.when(~now, F.col("energy"))), 6).alias("energy_before"),
        F.round(F.sum(F.when(~now, F.col("market_value"))), 6).alias("value_before"),
    )
    gwh = per.filter(F.col("n") > 0).select(
        "fueltech_group_id",
        (F.coalesce("energy", F.lit(0.0)) / 1000).alias("gwh"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
        (F.col("energy_before") / 1000).alias("gwh_before"),
        "value_before",
    )
    # One row per technology group: a handful.
    whole = F.sum("gwh").over(Window.partitionBy(F.lit(1)))
    return gwh.withColumn("total", whole).select(
        "fueltech_group_id",
        F.round("gwh", 2).alias("energy_gwh"),
        F.round("value", 2).alias("market_value"),
        F.round(F.when(F.col("total") > 0, F.col("gwh") / F.col("total") * 100).otherwise(0.0), 2).alias("demand_proportion"),
        F.round(_change(F.col("gwh"), F.col("gwh_before")), 1).alias("wow_change"),
        F.round(_change(F.col("value"), F.col("value_before")), 1).alias("mv_wow_change"),
    )


def weekly_price(market_daily: DataFrame, start: datetime, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """Demand and mean price per region, this week and the one before."""
    rows = _two_weeks(market_daily, start).filter(F.col("network_id").isin(*networks[network].codes))

    def price(when: Column) -> Column:
        total = F.sum(F.when(when, F.col("price_sum")))
        return F.round(total / F.nullif(F.sum(F.when(when, F.col("price_count"))), F.lit(0)), 6)

    now = F.col("_now")
    return rows.groupBy("network_region").agg(
        F.round(F.sum(F.when(now, F.col("demand_energy_daily"))), 4).alias("demand_energy"),
        price(now).alias("price"),
        price(~now).alias("price_before"),
    )


def weekly_headline(unit_daily: DataFrame, market_daily: DataFrame, start: datetime, network: str = "NEM", networks: dict[str, Network] = NETWORKS) -> DataFrame:
    """One row: energy, renewable share and mean price against the week before."""
    rows = _two_weeks(unit_daily, start).filter(
        F.col("network_id").isin(*networks[network].codes)
        & F.col("fueltech_group_id").isNotNull()
        & ~F.col("fueltech_group_id").isin(*WEEKLY_EXCLUDED)
    )
    now, green = F.col("_now"), F.col("renewable")
    energy = rows.agg(
        *[
            F.sum(F.when(when & part, F.col("energy"))).alias(name)
            for name, when, part in (
                ("all_now", now, F.lit(True)),
                ("all_before", ~now, F.lit(True)),
                ("green_now", now, green),
                ("green_before", ~now, green),
            )
        ]
    ).withColumn("_k", F.lit(1))
    prices = (
        weekly_price(market_daily, start, network)
        .agg(F.avg("price").alias("price_now"), F.avg("price_before").alias("price_before"))
        .withColumn("_k", F.lit(1))
    )
    share_now, share_before = F.col("green_now") / F.col("all_now") * 100, F.col("green_before") / F.col("all_before") * 100
    return energy.join(prices, "_k").select(
        F.round(_change(F.col("all_now"), F.col("all_before")), 1).alias("total_energy_wow"),
        F.round(F.when(share_before > 0, share_now - share_before), 1).alias("renewable_wow"),
        F.round(_change(F.col("price_now"), F.col("price_before")), 1).alias("avg_price_wow"),
    )


# --- capacity ------------------------------------------------------------------------------


def capacity_history(units: DataFrame, start: datetime, end: datetime, now: datetime) -> DataFrame:
    """Capacity in service per month, region and technology.

    Of a battery only the discharging half counts; rooftop has its own history.
    """
    capacity = F.coalesce("capacity_maximum", "capacity_registered")
    network, region = F.col("network_id"), F.col("network_region")
    valid = ((network == "WEM") & (region == "WEM")) | ((network == "NEM") & (region != "WEM"))
    rows = units.filter(
        F.col("fueltech_id").isNotNull()
        & ~F.col("fueltech_id").isin("battery", "battery_charging", "solar_rooftop")
        & capacity.isNotNull()
        & valid
    ).withColumn("_capacity", capacity)
    return (
        live_months(rows, start, end, now)
        .groupBy("month_start", "network_id", "network_region", "fueltech_id")
        .agg(F.sum("_capacity").alias("total_capacity"))
    )


# Rooftop reporting units and the regions they stand for.
ROOFTOP_REGIONS = {
    "ROOFTOP_APVI_NSW": "NSW1",
    "ROOFTOP_APVI_VIC": "VIC1",
    "ROOFTOP_APVI_QLD": "QLD1",
    "ROOFTOP_APVI_SA": "SA1",
    "ROOFTOP_APVI_TAS": "TAS1",
    "ROOFTOP_APVI_WA": "WEM",
}


def rooftop_capacity_history(history: DataFrame, units: DataFrame, start: datetime, end: datetime, regions: dict[str, str] = ROOFTOP_REGIONS, chunk: str | None = None) -> DataFrame:
    """Monthly rooftop capacity: last known value held, 0 before the first.

    `history` joins to `units` (unit_id, unit_code). The months of a unit are
    few, so the plain window is used unless told otherwise.
    """
    from wattframe.functions.lookups import lookup
    from wattframe.operators.ordered import last_known

    lo, hi = start.replace(day=1), end.replace(day=1)
    named = units.filter(F.col("unit_code").isin(*regions)).select("unit_id", "unit_code")
    inside = (F.col("changed_at") >= ts_lit(lo)) & (F.col("changed_at") < ts_lit(hi) + F.make_ym_interval(F.lit(0), F.lit(1)))
    per = (
        history.filter(inside)
        .join(named, "unit_id")
        .groupBy("unit_code", bucket("changed_at", "1M").alias("month_start"))
        .agg(F.max("capacity_registered").alias("capacity"))
    )
    months = F.explode(F.sequence(ts_lit(lo), ts_lit(hi), F.make_ym_interval(F.lit(0), F.lit(1))))
    spine = named.select("unit_code").distinct().select("unit_code", months.alias("month_start"))
    full = last_known(spine.join(per, ["unit_code", "month_start"], "left"), ["unit_code"], "month_start", ["capacity"], chunk)
    region = lookup(F.col("unit_code"), regions)
    return full.groupBy(
        "month_start",
        F.when(region == "WEM", "WEM").otherwise("NEM").alias("network_id"),
        region.alias("network_region"),
        F.lit("solar_rooftop").alias("fueltech_id"),
    ).agg(F.sum(F.coalesce("capacity", F.lit(0.0))).alias("total_capacity"))


def capacity_series(capacity: DataFrame) -> DataFrame:
    """One row per region and technology: months as a list of values.

    Series of nothing but zero are dropped. The list is one value per month.
    """
    keys = ["network_id", "network_region", "fueltech_id"]
    point = F.struct("month_start", F.coalesce("total_capacity", F.lit(0.0)).alias("v"))
    grouped = capacity.groupBy(*keys).agg(
        F.min("month_start").alias("start"),
        F.max("month_start").alias("last"),
        F.transform(F.array_sort(F.collect_list(point)), lambda p: p["v"]).alias("data"),
        F.max(F.coalesce("total_capacity", F.lit(0.0)) != 0).alias("_alive"),
    )
    series_id = F.concat_ws(".", F.lit("capacity"), F.lower("network_id"), F.lower("network_region"), "fueltech_id")
    return grouped.filter("_alive").select(series_id.alias("id"), *keys, "start", "last", "data")


# --- exports -------------------------------------------------------------------------------

# Technologies of the wide export, and those with emissions.
WIDE_ENERGY = (
    "battery_charging",
    "battery_discharging",
    "bioenergy_biogas",
    "bioenergy_biomass",
    "coal_black",
    "coal_brown",
    "distillate",
    "gas_ccgt",
    "gas_ocgt",
    "gas_recip",
    "gas_steam",
    "hydro",
    "pumps",
    "solar_utility",
    "solar_rooftop",
    "wind",
)
WIDE_EMISSIONS = (
    "bioenergy_biogas",
    "bioenergy_biomass",
    "coal_black",
    "coal_brown",
    "distillate",
    "gas_ccgt",
    "gas_ocgt",
    "gas_recip",
    "gas_steam",
)


def wide_export(unit_fact: DataFrame, market: DataFrame, flows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Half-hours by region, one column per technology and measure.

    The pivot is a row of conditional sums, so one aggregation does it all.
    """
    inside = (F.col("interval") >= ts_lit(start)) & (F.col("interval") < ts_lit(end))
    half = floor_minutes("interval", 30).alias("interval")
    keys = ["interval", "network_region"]
    own = F.col("network_id").isin("NEM", "AEMO_ROOFTOP") | (
        F.col("network_id").isin("WEM", "APVI") & (F.col("network_region") == "WEM")
    )
    ft = F.col("fueltech_id")
    techs = unit_fact.filter(inside & own).groupBy(half, "network_region").agg(
        *[steady(F.sum(F.when(ft == t, F.col("energy")))).alias(f"{t}_energy") for t in WIDE_ENERGY],
        *[steady(F.sum(F.when(ft == t, F.col("emissions")))).alias(f"{t}_emissions") for t in WIDE_EMISSIONS],
        steady(F.sum("energy")).alias("_energy"),
        steady(F.sum("emissions")).alias("_emissions"),
    )
    markets = F.col("network_id").isin("NEM", "WEM")
    prices = market.filter(inside & markets & ~F.col("is_forecast")).groupBy(half, "network_region").agg(
        F.round(steady(F.avg("price")), 2).alias("price"), F.round(steady(F.avg("demand")), 2).alias("demand")
    )
    moved = ("energy_imports", "energy_exports", "emissions_imports", "emissions_exports")
    moves = flows.filter(inside & markets).groupBy(half, "network_region").agg(*[steady(F.sum(c)).alias(c) for c in moved])
    steps = F.explode(
        F.sequence(ts_lit(start), ts_lit(end) - step_lit(timedelta(minutes=30)), step_lit(timedelta(minutes=30)))
    )
    spine = techs.select("network_region").distinct().select("network_region", steps.alias("interval"))
    joined = spine.join(techs, keys, "left").join(prices, keys, "left").join(moves, keys, "left")

    def shown(c: Column, sign: int = 1) -> Column:
        return F.coalesce(F.round(c * sign, 2), F.lit(0.0))

    out = F.coalesce("_emissions", F.lit(0.0)) + F.when(
        F.col("_energy").isNotNull(),
        F.coalesce("emissions_imports", F.lit(0.0)) + F.coalesce("emissions_exports", F.lit(0.0)),
    ).otherwise(0.0)
    intensity = F.when(
        F.coalesce("_energy", F.lit(0.0)) != 0, F.round(out / F.nullif(F.col("_energy"), F.lit(0.0)), 4)
    ).otherwise(0.0)
    return joined.select(
        *keys,
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("demand", F.lit(0.0)).alias("demand"),
        shown(F.col("energy_imports")).alias("imports_energy"),
        shown(F.col("energy_exports"), -1).alias("exports_energy"),
        shown(F.col("emissions_imports")).alias("imports_emissions"),
        shown(F.col("emissions_exports"), -1).alias("exports_emissions"),
        *[shown(F.col(f"{t}_energy"), -1 if t in ("battery_charging", "pumps") else 1).alias(f"{t}_energy") for t in WIDE_ENERGY],
        *[shown(F.col(f"{t}_emissions")).alias(f"{t}_emissions") for t in WIDE_EMISSIONS],
        intensity.alias("emissions_intensity"),
    )


def country_stat(stats: DataFrame, stat_type: str, country: str = "au") -> DataFrame:
    """A national statistic, newest first."""
    rows = stats.filter((F.col("stat_type") == stat_type) & (F.col("country") == country))
    return rows.select("stat_date", "value", "stat_type").orderBy(F.col("stat_date").desc())


def data_range(telemetry: DataFrame, units: DataFrame, now: datetime, networks: Sequence[str] = ("NEM",), region: str | None = None, unit_codes: Sequence[str] | None = None, energy: bool = False, days: int = 7) -> DataFrame:
    """First reading ever and newest reading of the last days, one row.

    Rooftop counts only when a rooftop network is asked for.
    """
    excluded = ["imports", "exports"]
    if not any(n in ("APVI", "AEMO_ROOFTOP", "AEMO_ROOFTOP_BACKFILL") for n in networks):
        excluded.append("solar_rooftop")
    dims = units.filter(
        F.col("network_id").isin(*networks) & ~F.col("fueltech_id").isin(*excluded) & ~F.col("interconnector")
    )
    if region:
        dims = dims.filter(F.col("network_region") == region)
    if unit_codes:
        dims = dims.filter(F.col("unit_code").isin(*unit_codes))
    field = "energy" if energy else "generated"
    recent = telemetry.filter(
        (F.col("interval") >= ts_lit(now - timedelta(days=days))) & ~F.col("is_forecast") & F.col(field).isNotNull()
    )
    # Newest reading per unit first; the join is then dimension-sized.
    newest = recent.groupBy("unit_code").agg(F.max("interval").alias("_last"))
    return newest.join(dims.select("unit_code", "data_first_seen"), "unit_code").agg(
        F.min("data_first_seen").alias("start"), F.max("_last").alias("last")
    )


# --- pollution -----------------------------------------------------------------------------

def pollution_import(reports: DataFrame, substances: DataFrame) -> DataFrame:
    """Reported emissions as pollution facts: totals of enabled substances."""
    place = F.lower("destination")
    category = F.when(place.contains("water"), "water").when(place.contains("land"), "land").otherwise("air")
    part = F.when(place.contains("point"), "point").when(place.contains("fugitive"), "fugitive").otherwise("total")
    quality = (
        F.when(F.col("direct_measurement"), "measured")
        .when(F.col("engineering_calc"), "calculated")
        .when(F.col("emission_factors"), "emission_factors")
        .otherwise("estimated")
    )
    enabled = substances.filter("enabled").select(F.col("npi_name").alias("name"), F.col("code").alias("substance_code"))
    rows = reports.join(enabled, "name").withColumn("pollution_subcategory", part)
    return rows.filter(F.col("pollution_subcategory") == "total").select(
        "npi_facility_id",
        "substance_code",
        "report_year",
        category.alias("pollution_category"),
        "pollution_subcategory",
        F.col("quantity_kg").alias("pollution_value"),
        F.lit("kg").alias("pollution_unit"),
        quality.alias("data_quality"),
    )


def pollution_series(pollution: DataFrame, substances: DataFrame, facilities: DataFrame, codes: Sequence[str] | None = None, categories: Sequence[str] | None = None, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Yearly points per pollutant and facility, stamped 1 July, and the usual quality."""
    wanted = substances.filter("enabled")
    if codes:
        wanted = wanted.filter(F.col("code").isin(*codes))
    elif categories:
        wanted = wanted.filter(F.col("category").isin(*categories))
    else:
        wanted = wanted.filter(F.col("category") == "air_pollutant")
    if codes and categories:
        wanted = substances.filter("enabled").filter(F.col("code").isin(*codes) | F.col("category").isin(*categories))
    rows = pollution
    if first_year:
        rows = rows.filter(F.col("report_year") >= first_year)
    if last_year:
        rows = rows.filter(F.col("report_year") <= last_year)
    known = facilities.filter(F.col("approved") & F.col("npi_id").isNotNull()).select(
        F.col("npi_id").alias("npi_facility_id"), "facility_code"
    )
    joined = rows.join(known, "npi_facility_id").join(
        wanted.select(F.col("code").alias("substance_code"), "category"), "substance_code"
    )
    stamp = F.make_date(F.col("report_year"), F.lit(7), F.lit(1)).cast("timestamp_ntz")
    point = F.struct(stamp.alias("ts"), F.col("pollution_value").alias("value"))
    quality = F.coalesce("data_quality", F.lit("unknown"))
    return joined.groupBy("substance_code", "category", "facility_code").agg(
        F.min(stamp).alias("date_start"),
        F.max(stamp).alias("date_end"),
        F.mode(quality, True).alias("data_quality"),
        F.array_sort(F.collect_list(point)).alias("data"),
    )


def facility_pollution(pollution: DataFrame, substances: DataFrame, facilities: DataFrame, facility: str | None = None, year: int | None = None) -> DataFrame:
    """Pollution records of a facility, newest first."""
    rows = pollution if year is None else pollution.filter(F.col("report_year") == year)
    known = facilities.filter(F.col("npi_id").isNotNull()).select(F.col("npi_id").alias("npi_facility_id"), "facility_code")
    if facility:
        known = known.filter(F.col("facility_code") == facility)
    names = substances.select(F.col("code").alias("substance_code"), F.col("npi_name").alias("substance_name"), "category")
    return (
        rows.join(known, "npi_facility_id")
        .join(names, "substance_code")
        .select(
            "facility_code",
            F.col("report_year").alias("year"),
            "substance_code",
            "substance_name",
            "category",
            "pollution_category",
            F.col("pollution_value").alias("value_kg"),
            "data_quality",
        )
        .orderBy(F.col("year").desc(), "substance_name")
    )


# --- nested series and bundles ----------------------------------------------------------------


def to_series(df: DataFrame, metrics: Sequence[str], keys: Sequence[str], interval: str, network: str = "NEM", fill: bool = True) -> DataFrame:
    """One row per metric and group: ordered (time, value) points.

    Gaps inside a series become explicit NULL points. The points of one series
    are the buckets of one request: a span beyond what `check_span` allows is an error.
    """
    from wattframe.functions.clean import series_key
    from wattframe.operators.gapfill import fill_interior

    long = df.unpivot([*keys, "interval"], list(metrics), "metric", "value")
    if fill:
        long = fill_interior(long, ["metric", *keys], "interval", interval)
    point = F.struct(F.col("interval").alias("ts"), "value")
    series = long.groupBy("metric", *keys).agg(F.array_sort(F.collect_list(point)).alias("data"))
    # The ends shown are those of the whole metric: one row per metric.
    ends = df.unpivot([*keys, "interval"], list(metrics), "metric", "value").groupBy("metric").agg(
        F.min("interval").alias("date_start"), F.max("interval").alias("date_end")
    )
    ends = ends.withColumn("date_end", check_span(interval, F.col("date_start"), F.col("date_end")))
    name = F.concat_ws("_", "metric", series_key(keys))
    hours, minutes = divmod(NETWORKS[network].offset_minutes, 60)
    return series.join(ends, "metric").select(
        F.lit(network).alias("network"),
        "metric",
        name.alias("name"),
        *keys,
        F.lit(interval).alias("interval"),
        "date_start",
        "date_end",
        F.lit(f"+{hours:02d}:{minutes:02d}").alias("offset"),
        "data",
    )


SERIES = ("series_id", "interval", "value")


def append_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sets of series as one; an id present in both keeps the first set's points."""
    fresh = b.join(a.select("series_id").distinct(), "series_id", "left_anti")
    return a.unionByName(fresh)


def get_series(df: DataFrame, series_id: str) -> DataFrame:
    """The points of one series."""
    return df.filter(F.col("series_id") == series_id)


def _long(df: DataFrame, values: dict[str, str], prefix: Sequence[Column | str], group: str | None = None) -> DataFrame:
    """Measures as long rows; the id is prefix, group and measure name."""
    cols = [c for c in values if c in df.columns]
    pairs = F.explode(
        F.array(*[F.struct(F.lit(values[c]).alias("n"), F.col(c).cast("double").alias("v")) for c in cols])
    )
    picked = df.select("interval", *([group] if group else []), pairs.alias("p"))
    parts = [p if isinstance(p, Column) else F.lit(p) for p in prefix]
    series = F.lower(F.concat_ws(".", *parts, *([F.col(group)] if group else []), F.col("p.n")))
    return picked.select(series.alias("series_id"), "interval", F.col("p.v").alias("value"))


def _stack(parts: Sequence[DataFrame | None]) -> DataFrame:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def power_bundle(fine, daily, summary, telemetry, units, weather, start, end, network: str = "NEM", region: str | None = None, interval: str = "5m", stations=None, chunk="month") -> DataFrame:
    """Everything a power view shows, as one set of series.

    Technologies, rooftop with forecast, price, demand, curtailment, flows,
    and weather at half-hours.
    """
    where = ("au", network, region or "all")
    techs = power_by_fueltech(fine, daily, interval, start, end, network, region)
    rooftop = rooftop_combined(telemetry, units, start, end, region=region, chunk=chunk)
    ahead = rooftop_forecast(telemetry, units, start, end, region=region, chunk=chunk)
    market = price_demand(summary, interval, start, end, network, region)
    inside = summary.filter(F.col("interval").between(ts_lit(start), ts_lit(end)))
    flows = flow_power(inside.filter(F.col("network_region") == region), interval, network) if region else None
    return _stack(
        [
            _long(techs, {"fueltech_power": "power", "fueltech_emissions": "emissions", "fueltech_emissions_intensity": "emissions_factor"}, where, "fueltech_code"),
            _long(rooftop, {"generated": "power"}, where, "fueltech_id"),
            _long(ahead, {"generated": "power_forecast"}, where, "fueltech_id"),
            _long(market, {"price": "price", "demand": "demand", "demand_total": "demand_total", "curtailment_total": "curtailment", "curtailment_solar_utility_total": "curtailment_solar_utility", "curtailment_wind_total": "curtailment_wind"}, where),
            None if flows is None else _long(flows, {"power_imports": "imports.power", "power_exports": "exports.power", "emissions_imports": "imports.emissions", "emissions_exports": "exports.emissions", "factor_imports": "imports.emissions_factor", "factor_exports": "exports.emissions_factor"}, where),
            _weather(weather, "30m", start, end, where, stations, False),
        ]
    )


def _weather(weather, interval, start, end, where, stations, extremes: bool) -> DataFrame | None:
    if weather is None:
        return None
    names = {"temp_air": "temperature_mean" if extremes else "temperature"}
    if extremes:
        names |= {"temp_min": "temperature_min", "temp_max": "temperature_max"}
    return _long(weather_series(weather, interval, start, end, stations), names, (*where, "weather"), "station_id")


def energy_bundle(fine, daily, summary, market_daily, weather, start, end, network: str = "NEM", region: str | None = None, interval: str = "1d", stations=None) -> DataFrame:
    """Everything an energy view shows over a year: energy, value, emissions,
    demand, curtailment, flows and weather."""
    where = ("au", network, region or "all")
    techs = energy_by_fueltech(fine, daily, interval, start, end, network, region)
    demand = demand_energy(summary, market_daily, interval, start, end, (network,), region)
    if not region:
        demand = demand.groupBy("interval").agg(*[F.sum(c).alias(c) for c in ("demand_energy", "demand_market_value")])
    curtailed = curtailment_energy(summary, interval, start, end, network, region) if network == "NEM" else None
    flows = None
    if region and network == "NEM":
        inside = summary.filter((F.col("network_region") == region) & (F.col("interval") >= ts_lit(start)) & (F.col("interval") < ts_lit(end)))
        flows = flow_energy(inside, interval, network)
    return _stack(
        [
            _long(techs, {"fueltech_energy_gwh": "energy", "fueltech_market_value_dollars": "market_value", "fueltech_emissions": "emissions"}, where, "fueltech_code"),
            _long(demand, {"demand_energy": "demand.energy", "demand_market_value": "demand.market_value"}, where),
            None if curtailed is None else _long(curtailed, {"curtailment_energy_total": "curtailment.energy", "curtailment_energy_solar_total": "curtailment_solar_utility.energy", "curtailment_energy_wind_total": "curtailment_wind.energy"}, where),
            None if flows is None else _long(flows, {"energy_imports_gwh": "imports.energy", "energy_exports_gwh": "exports.energy", "emissions_imports": "imports.emissions", "emissions_exports": "exports.emissions", "factor_imports": "imports.emissions_factor", "factor_exports": "exports.emissions_factor"}, where),
            _weather(weather, "1d", start, end, where, stations, True) if interval == "1d" else None,
        ]
    )


def stat_series(stats: DataFrame, stat_type: str = "cpi", country: str = "au") -> DataFrame:
    """A national statistic as a series."""
    rows = country_stat(stats, stat_type, country)
    return rows.select(
        F.concat_ws(".", F.lit(country), F.lit(stat_type)).alias("series_id"),
        F.col("stat_date").alias("interval"),
        F.col("value").cast("double").alias("value"),
    )


def monthly_bundle(fine, daily, summary, market_daily, stats, start, end, regions: dict[str, str]) -> DataFrame:
    """Months of every region in one set, the statistic first.

    `regions` maps a region to its network.
    """
    parts = [stat_series(stats)]
    for region, network in regions.items():
        parts.append(energy_bundle(fine, daily, summary, market_daily, None, start, end, network, region, "1M"))
    return _stack(parts)


def daily_bundle(fine, daily, summary, market_daily, weather, stats, start, end, region: str, network: str = "NEM", stations=None) -> DataFrame:
    """Days of one region, with weather and the statistic."""
    own = energy_bundle(fine, daily, summary, market_daily, weather, start, end, network, region, "1d", stations)
    return _stack([own, stat_series(stats)])


def flow_bundle(edges: DataFrame, end: datetime, days: int = 7) -> DataFrame:
    """Named flows of the last days as series (from `edge_power`)."""
    rows = edges.filter((F.col("interval") >= ts_lit(end - timedelta(days=days))) & (F.col("interval") <= ts_lit(end)))
    return rows.select(
        F.concat_ws(".", F.lit("au"), F.lit("nem"), F.lit("flows"), "flow").alias("series_id"),
        "interval",
        F.col("power").alias("value"),
    )


# Flows the grid map shows the other way round.
MAP_INVERTED = ("VIC1->NSW1", "VIC1->SA1")


def map_feed(edges: DataFrame, power_sets: Sequence[DataFrame], end: datetime, days: int = 1) -> DataFrame:
    """Flows, two of them inverted, and the power sets of the regions."""
    from wattframe.operators.flows import invert_flow

    named = F.col("flow").isin(*MAP_INVERTED)
    turned = edges.filter(~named).unionByName(invert_flow(edges.filter(named)))
    return _stack([flow_bundle(turned, end, days), *power_sets])


def station_series(unit_fact: DataFrame, facility: str | Sequence[str], metrics: Sequence[str], interval: str, start, end, network: str = "NEM") -> DataFrame:
    """Series per unit of a station, in long form."""
    wide = timeseries(unit_fact, metrics, interval, start, end, filters={"facility_code": facility}, network=network, kind="facility")
    long = wide.unpivot(["facility_code", "unit_code", "interval"], list(metrics), "metric", "value")
    return long.select(
        F.concat_ws(".", "facility_code", "unit_code", "metric").alias("series_id"), "interval", "value"
    )
