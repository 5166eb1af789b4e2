"""Enriched facts: energy, emissions and value per unit; demand per region."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.lookups import (
    HYBRID_STORAGE_UNITS,
    MARKET_RENEWABLE_FUELTECHS,
    NON_UNIT_FUELTECHS,
    TWO_WAY_FUELTECHS,
    interval_minutes,
    lookup,
)
from wattframe.functions.timebucket import NTZ, epoch_seconds, floor_minutes, guard_intervals, step_lit, ts_lit
from wattframe.operators.gapfill import (
    LOOKBACK,
    TAIL,
    gapfill,
    locf,
    rescale_energy,
    runs,
    spread,
)
from wattframe.operators.ingest import relabel_region
from wattframe.operators.ordered import lag_row, lag_step
from wattframe.session import stage

FIVE = timedelta(minutes=5)
HOUR = timedelta(hours=1)

# Networks that publish their own energy.
OWN_ENERGY_NETWORKS = ("WEM", "WEMDE", "AEMO_ROOFTOP_BACKFILL")
# Intervals per hour that turn demand into energy.
MARKET_INTERVALS_PER_HOUR = {"NEM": 12.0, "WEM": 2.0}
# Feeds that carry the rooftop output of the eastern market.
ROOFTOP_NETWORKS = ("AEMO_ROOFTOP",)


def trapezoid_energy(telemetry: DataFrame, start: datetime, end: datetime, lookback: timedelta = FIVE, chunk="month") -> DataFrame:
    """Energy of each reading from its own and the previous row's power.

    Only rows that qualify are returned, flagged 2: a predecessor exists, the
    network does not publish its own energy, and the row is not settled yet.
    """
    window = telemetry.filter(
        F.col("interval").between(ts_lit(start - lookback), ts_lit(end))
        & ~F.col("network_id").isin(*OWN_ENERGY_NETWORKS)
    )
    paired = lag_row(window, ["network_id", "unit_code"], "interval", ["generated"], chunk=chunk)
    per_hour = 60 / interval_minutes(F.col("network_id"))
    energy = (F.col("generated") + F.col("prev_generated")) / 2 / per_hour
    due = (
        F.col("interval").between(ts_lit(start), ts_lit(end))
        & F.col("prev_generated").isNotNull()
        & (F.col("energy_quality_flag") < 2)
    )
    return (
        paired.filter(due)
        .withColumn("energy", energy)
        .withColumn("energy_quality_flag", F.lit(2).cast("short"))
        .select(*telemetry.columns)
    )


def emissions(energy: Column, factor: Column) -> Column:
    """Emissions of positive energy, 0 otherwise."""
    return F.when(energy > 0, F.coalesce(F.round(factor * energy, 4), F.lit(0.0))).otherwise(F.lit(0.0))


def emission_factor(energy: Column, factor: Column) -> Column:
    return F.when(energy > 0, F.coalesce(F.round(factor, 4), F.lit(0.0))).otherwise(F.lit(0.0))


def market_value(energy: Column, price: Column) -> Column:
    """Value of positive energy; unknown where the price is."""
    return F.when(energy > 0, F.round(energy * price, 4)).otherwise(F.lit(0.0))


_UNIT_COLUMNS = (
    "network_region",
    "facility_code",
    "unit_code",
    "status_id",
    "fueltech_id",
    "fueltech_group_id",
    "renewable",
)
UNIT_KEYS = ("interval", "network_id", "network_region", "facility_code", "unit_code")


def carried_prices(market: DataFrame, start: datetime, end: datetime, chunk="month", carry_in: bool = False) -> DataFrame:
    """Published prices carried over the five-minute grid, by region.

    With `carry_in` the last price before `start` holds until the first one inside, so that a recomputed
    day has the prices it has in a longer run. The fill reads its rows twice, the market is read once.
    """
    keys = ["network_id", "network_region"]
    known = market.filter((F.col("interval") <= ts_lit(end)) & F.col("price").isNotNull())
    if not carry_in:
        known = known.filter(F.col("interval") >= ts_lit(start))
    published = known.groupBy(floor_minutes("interval", 5).alias("interval"), *keys).agg(F.avg("price").alias("price"))
    if carry_in:
        begun = F.greatest("interval", ts_lit(start)).alias("interval")
        published = published.groupBy(begun, *keys).agg(F.max_by("price", "interval").alias("price"))
    return spread(stage(published), keys, "interval", FIVE, end, hold=["price"], chunk=chunk)


def daily_prices(prices: DataFrame) -> DataFrame:
    """(network_region, _day, _rank, _from, _prices): the prices of a day's steps in a row, from the first one on.

    `prices` (carried) have no holes after a network's first one, so neither have the days. A region of several
    networks has a row for each `_rank`; those beyond 0 hold what is there besides.
    """
    at = F.col("interval")
    steps = prices.filter(at == floor_minutes("interval", 5)).groupBy("network_region", "interval")
    ranked = steps.agg(F.array_sort(F.collect_list("price")).alias("all")).select(
        "network_region", "interval", F.posexplode("all").alias("_rank", "price")
    )
    in_order = F.array_sort(F.collect_list(F.struct("interval", "price")))
    return ranked.groupBy("network_region", F.to_date("interval").alias("_day"), "_rank").agg(
        F.min("interval").alias("_from"), F.transform(in_order, lambda x: x["price"]).alias("_prices")
    )


def _pieces(tasks: int, days: int) -> int:
    """Into how many tasks the rows of a day are dealt: `tasks` of some days, those of a month at most."""
    return -(-tasks // min(max(days, 1), 32))


def priced_steps(rows: DataFrame, prices: DataFrame, days: int = 32, day: str | None = None) -> DataFrame:
    """Each row repeated on the five-minute steps from `interval` to `_until`, with the carried price of its region.

    Rows are cut by day and meet a day's prices before they are repeated, so what is shuffled grows with the readings.
    Tasks are as many as the session's shuffle partitions: merged by their size before, they would hold too much after.
    Each has pieces of few days, of about so many `days` in all, so a table by day can be written without another shuffle.
    A column `day`, if named, tells the day as a number (20240131), worked out before rows are repeated.
    """
    each = F.explode(F.sequence(F.to_date("interval"), F.to_date("_until"), F.expr("INTERVAL 1 DAY")))
    midnight = F.col("_day").cast(NTZ)
    cut = rows.withColumn("_day", each).withColumns(
        {
            "interval": F.greatest("interval", midnight),
            "_until": F.least("_until", midnight + F.expr("INTERVAL 1 DAY") - step_lit(FIVE)),
        }
    )
    if day:
        cut = cut.withColumn(day, F.year("_day") * 10_000 + F.month("_day") * 100 + F.dayofmonth("_day"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = _pieces(tasks, days)
    piece = F.unix_date("_day") * many + F.pmod(F.hash("unit_code"), F.lit(many))
    dealt = cut.repartitionById(tasks, F.pmod(piece, F.lit(tasks)))
    known = dealt.join(daily_prices(prices), ["network_region", "_day"], "left")
    steps = known.withColumn("_t", F.explode(F.sequence("interval", "_until", step_lit(FIVE))))
    place = ((epoch_seconds("_t") - epoch_seconds("_from")) / 300).cast("int")
    out = steps.withColumn("price", F.get("_prices", place)).filter((F.coalesce("_rank", F.lit(0)) == 0) | F.col("price").isNotNull())
    return out.withColumn("interval", F.col("_t")).drop("_t", "_day", "_until", "_rank", "_from", "_prices")


def unit_intervals(
    telemetry: DataFrame,
    market: DataFrame,
    units: DataFrame,
    start: datetime,
    end: datetime,
    networks: Sequence[str] | None = None,
    version: int = 0,
    chunk: str | None = "month",
    carry_in: bool = False,
    day: str | None = None,
) -> DataFrame:
    """The unit fact for [start, end).

    Readings are summed per five minutes and floored, coarse rooftop feeds are
    carried over the grid, and price, emissions and value are attached. Tasks have rows of few days; a column
    `day`, if named, tells them as numbers.
    `units` has the unit attributes with those of their facility; Spark picks
    the join by its measured size.
    """
    actual = telemetry.filter(~F.col("is_forecast"))
    if networks:
        actual = actual.filter(F.col("network_id").isin(*networks))
    dims = units.select(*_UNIT_COLUMNS, "emissions_factor_co2")
    sparse = actual.filter(F.col("interval").between(ts_lit(start), ts_lit(end)))

    # Readings combine per unit before attributes are attached, so the join
    # sees one row per unit and interval.
    ft = F.col("fueltech_id")
    per_unit = sparse.groupBy(floor_minutes("interval", 5).alias("interval"), "network_id", "unit_code").agg(
        F.round(F.sum("generated"), 4).alias("generated"),
        F.round(F.sum("energy"), 4).alias("energy"),
        F.round(F.sum("energy_storage"), 4).alias("energy_storage"),
    )
    plain_dims = dims.filter(~ft.isin(*NON_UNIT_FUELTECHS) & F.col("fueltech_group_id").isNotNull())
    plain = per_unit.join(plain_dims, "unit_code").withColumns(
        {c: _floor_one_way(F.col(c), ft) for c in ("generated", "energy")}
    )

    rooftop_dims = dims.filter(ft == "solar_rooftop").drop("fueltech_group_id", "renewable")
    rooftop_seen = actual.filter(F.col("interval").between(ts_lit(start - LOOKBACK), ts_lit(end)))
    rooftop = (
        rooftop_seen.join(rooftop_dims.select("unit_code"), "unit_code", "left_semi")
        .groupBy(floor_minutes("interval", 5).alias("interval"), "network_id", "unit_code")
        .agg(
            F.coalesce(F.round(F.sum("generated"), 4), F.lit(0.0)).alias("generated"),
            F.sum("energy").alias("energy"),
        )
        .withColumn(
            "energy",
            F.coalesce(
                F.round(rescale_energy(F.col("energy"), interval_minutes(F.col("network_id"))), 4),
                F.lit(0.0),
            ),
        )
    )
    seeded = rooftop.filter((F.col("interval") >= ts_lit(start - LOOKBACK)) & (F.col("interval") <= ts_lit(end)))
    held = runs(seeded, ["network_id", "unit_code"], "interval", FIVE, end, tail=TAIL, chunk=chunk).drop("_next")
    solar = (
        held.join(rooftop_dims, "unit_code")
        .withColumn("fueltech_group_id", F.lit("solar"))
        .withColumn("renewable", F.lit(True))
        .withColumn("energy_storage", F.lit(None).cast("double"))
    )

    both = plain.withColumn("_until", F.col("interval")).unionByName(solar)
    energy, factor = F.col("energy"), F.col("emissions_factor_co2")
    both = both.withColumns({"emissions": emissions(energy, factor), "emission_factor": emission_factor(energy, factor)})
    priced = priced_steps(both.drop("emissions_factor_co2"), carried_prices(market, start, end, chunk, carry_in), (end - start).days, day)
    priced = priced.filter((F.col("interval") >= ts_lit(start)) & (F.col("interval") < ts_lit(end)))
    fact = priced.select(
        "interval",
        "network_id",
        *_UNIT_COLUMNS,
        "generated",
        "energy",
        "energy_storage",
        "emissions",
        "emission_factor",
        market_value(energy, F.col("price")).alias("market_value"),
        F.lit(version).cast("long").alias("version"),
        *([day] if day else []),
    )
    return relabel_region(fact)


def _floor_one_way(total: Column, fueltech: Column) -> Column:
    return F.when(fueltech.isin(*TWO_WAY_FUELTECHS), total).otherwise(F.greatest(total, F.lit(0.0)))


# --- market fact --------------------------------------------------------------------------


def pick_price(network: Column, dispatch: Column, trading: Column) -> Column:
    """The western market prefers the dispatch price, others settle on trading."""
    return F.when(network == "WEM", dispatch).otherwise(trading)


def demand_proxy(network: Column, demand: Column, generation: Column) -> Column:
    """An isolated network's demand is its generation where none is published."""
    return F.when(network == "WEM", F.coalesce(demand, generation)).otherwise(demand)


def _exact(total: Column) -> Column:
    """A sum to the six digits readings are kept in, whatever the order of addition."""
    return F.round(total, 6)


def renewable_and_storage(telemetry: DataFrame, units: DataFrame, networks: Sequence[str] | None = None) -> DataFrame:
    """Renewable and hybrid-storage output per interval and region.

    Pre-aggregated per unit, so the attribute join and the regional sum work
    on one row per unit and interval.
    """
    power = F.greatest(F.col("generated"), F.lit(0.0))
    per_unit = (
        telemetry.filter(~F.col("is_forecast"))
        .groupBy(floor_minutes("interval", 5).alias("interval"), "unit_code")
        .agg(F.sum(power).alias("power"))
    )
    dims = units.select("unit_code", "fueltech_id", F.col("network_id"), "network_region")
    if networks:
        dims = dims.filter(F.col("network_id").isin(*networks))
    hybrid = F.col("unit_code").isin(*HYBRID_STORAGE_UNITS)
    green = F.col("fueltech_id").isin(*MARKET_RENEWABLE_FUELTECHS) & ~hybrid
    return (
        per_unit.join(dims, "unit_code")
        .groupBy("interval", "network_id", "network_region")
        .agg(
            _exact(F.sum(F.when(green, F.col("power")).otherwise(0.0))).alias("renewable_generation"),
            _exact(F.sum(F.when(hybrid, F.col("power")).otherwise(0.0))).alias("storage_generation"),
        )
    )


def curtailment(market: DataFrame) -> DataFrame:
    """Available minus cleared output per interval and region."""
    solar = F.round(F.col("ss_solar_uigf") - F.col("ss_solar_clearedmw"), 4)
    wind = F.round(F.col("ss_wind_uigf") - F.col("ss_wind_clearedmw"), 4)
    return (
        market.groupBy(floor_minutes("interval", 5).alias("interval"), "network_id", "network_region")
        .agg(F.avg(solar).alias("curtailment_solar_total"), F.avg(wind).alias("curtailment_wind_total"))
        .withColumn(
            "curtailment_total",
            F.coalesce("curtailment_solar_total", F.lit(0.0)) + F.coalesce("curtailment_wind_total", F.lit(0.0)),
        )
    )


def gross_and_renewable(df: DataFrame, prefix: str = "") -> DataFrame:
    """Gross demand and renewable output with rooftop, and with hybrid storage."""
    p = prefix
    return (
        df.withColumn(f"{p}demand_gross", F.round(F.col(f"{p}demand_total") + F.col(f"{p}rooftop_solar"), 4))
        .withColumn(
            f"{p}generation_renewable", F.round(F.col(f"{p}renewable_generation") + F.col(f"{p}rooftop_solar"), 4)
        )
        .withColumn(
            f"{p}generation_renewable_with_storage",
            F.round(F.col(f"{p}generation_renewable") + F.col(f"{p}storage_generation"), 4),
        )
    )


def pair_energy(df: DataFrame, columns: dict[str, str], per_hour: Column) -> DataFrame:
    """Energy between consecutive intervals: `columns` maps power to energy names."""
    out = {
        energy: F.round((F.col(power) + F.col(f"prev_{power}")) / 2 / per_hour, 4) for power, energy in columns.items()
    }
    return df.withColumns(out)


def demand_value(df: DataFrame) -> DataFrame:
    """Market value of the three demand figures."""
    return df.withColumns(
        {f"{d}_market_value": F.round(F.col(f"{d}_energy") * F.col("price"), 4) for d in ("demand", "demand_total", "demand_gross")}
    )


_ZERO_FILLED = (
    "rooftop_solar",
    "renewable_generation",
    "storage_generation",
    "curtailment_solar_total",
    "curtailment_wind_total",
)
_PAIRS = {
    "demand": "demand_energy",
    "demand_total": "demand_total_energy",
    "demand_gross": "demand_gross_energy",
    "generation_renewable": "generation_renewable_energy",
    "generation_renewable_with_storage": "generation_renewable_with_storage_energy",
    "curtailment_solar_total": "curtailment_energy_solar_total",
    "curtailment_wind_total": "curtailment_energy_wind_total",
}
FLOW_COLUMNS = (
    "energy_imports",
    "energy_exports",
    "emissions_imports",
    "emissions_exports",
    "market_value_imports",
    "market_value_exports",
)
MARKET_MEASURES = (
    "price",
    "demand",
    "demand_total",
    "demand_gross",
    "generation_renewable",
    "demand_energy",
    "demand_total_energy",
    "demand_gross_energy",
    "generation_renewable_energy",
    "demand_market_value",
    "demand_total_market_value",
    "demand_gross_market_value",
    "curtailment_solar_total",
    "curtailment_wind_total",
    "curtailment_total",
    "curtailment_energy_solar_total",
    "curtailment_energy_wind_total",
    "curtailment_energy_total",
    "generation_renewable_with_storage",
    "generation_renewable_with_storage_energy",
    *FLOW_COLUMNS,
)


def market_summary(
    telemetry: DataFrame,
    market: DataFrame,
    units: DataFrame,
    start: datetime,
    end: datetime,
    flows: DataFrame | None = None,
    version: int = 0,
    rooftop_networks: Sequence[str] = ROOFTOP_NETWORKS,
    per_hour: dict[str, float] = MARKET_INTERVALS_PER_HOUR,
    chunk: str | None = "month",
    lookback: timedelta = HOUR,
) -> DataFrame:
    """The market fact for [start, end], both ends included.

    Scans `lookback` early so fills and pairs have a seed. Regions are those the
    market table knows in that span. Sums by interval and region are written to the shared folder before they are
    filled, as a fill reads its input twice.
    """
    early = start - lookback
    keys = ["network_id", "network_region"]
    span = F.col("interval").between(ts_lit(early), ts_lit(end))
    market = market.filter(span & ~F.col("is_forecast"))
    telemetry = telemetry.filter(span & ~F.col("is_forecast"))
    bucketed = floor_minutes("interval", 5).alias("interval")

    base = market.groupBy(bucketed, *keys).agg(
        F.avg(F.coalesce("price_dispatch", "price")).alias("price_dispatch_first"),
        F.avg("price").alias("price_trading"),
        F.avg("demand").alias("demand"),
        F.avg("demand_total").alias("demand_total"),
        F.avg(F.round(F.col("ss_solar_uigf") - F.col("ss_solar_clearedmw"), 4)).alias("curtailment_solar_total"),
        F.avg(F.round(F.col("ss_wind_uigf") - F.col("ss_wind_clearedmw"), 4)).alias("curtailment_wind_total"),
    )
    base = stage(base)
    regions = base.select(*keys).distinct()
    full = gapfill(base, keys, "interval", FIVE, early, end)
    full = locf(full, keys, "interval", ["price_dispatch_first", "price_trading"], chunk=chunk)

    rooftop_dims = units.filter(
        (F.col("fueltech_id") == "solar_rooftop") & F.col("network_id").isin(*rooftop_networks)
    ).select("unit_code", "network_region")
    rooftop = (
        telemetry.join(rooftop_dims, "unit_code")
        .join(regions.select("network_region").distinct(), "network_region", "left_semi")
        .groupBy(bucketed, "network_region")
        .agg(F.round(F.avg("generated"), 9).alias("rooftop_solar"))
    )
    known = stage(rooftop.filter(F.col("rooftop_solar").isNotNull()))
    rooftop = spread(known, ["network_region"], "interval", FIVE, end, line=["rooftop_solar"], tail=TAIL, chunk=chunk)
    rooftop = rooftop.withColumn("network_id", F.lit("NEM"))

    green = renewable_and_storage(telemetry, units)
    green = green.join(regions.select("network_id").distinct(), "network_id", "left_semi")
    green = green.join(regions.select("network_region").distinct(), "network_region", "left_semi")
    # Sums are never NULL, so consecutive rows are the anchors of both lines.
    green = spread(stage(green), keys, "interval", FIVE, line=["renewable_generation", "storage_generation"], chunk=chunk)

    west = units.filter(F.col("network_id") == "WEM").select("unit_code")
    total = (
        telemetry.join(west, "unit_code", "left_semi")
        .groupBy(bucketed, F.lit("WEM").alias("network_id"))
        .agg(_exact(F.sum("generated")).alias("total_generation"))
    )
    known = stage(total.filter(F.col("total_generation").isNotNull()))
    total = spread(known, ["network_id"], "interval", FIVE, line=["total_generation"], chunk=chunk)

    on = ["interval", *keys]
    joined = full.join(rooftop, on, "full_outer").join(green, on, "full_outer")
    joined = joined.join(total, ["interval", "network_id"], "left")
    network = F.col("network_id")
    combined = joined.select(
        *on,
        pick_price(network, F.col("price_dispatch_first"), F.col("price_trading")).alias("price"),
        demand_proxy(network, F.col("demand"), F.col("total_generation")).alias("demand"),
        demand_proxy(network, F.col("demand_total"), F.col("total_generation")).alias("demand_total"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rooftop_solar", "renewable_generation", "storage_generation")],
        "curtailment_solar_total",
        "curtailment_wind_total",
    )
    lagged = [c for c in combined.columns if c not in (*on, "price")]
    # Every series here is gap-free: the predecessor is the slot before.
    paired = lag_step(combined, keys, "interval", lagged, FIVE, chunk=chunk or "month")
    paired = paired.filter(F.col("interval").between(ts_lit(start), ts_lit(end)))
    zero = [*_ZERO_FILLED, *[f"prev_{c}" for c in _ZERO_FILLED]]
    filled = paired.withColumn(
        "curtailment_total",
        F.coalesce("curtailment_solar_total", F.lit(0.0)) + F.coalesce("curtailment_wind_total", F.lit(0.0)),
    ).fillna(0.0, subset=zero)
    shaped = gross_and_renewable(gross_and_renewable(filled), "prev_")
    rate = lookup(network, per_hour, F.lit(12.0))
    shaped = pair_energy(shaped, _PAIRS, rate).withColumn(
        "curtailment_energy_total",
        F.round(F.col("curtailment_energy_solar_total") + F.col("curtailment_energy_wind_total"), 4),
    )
    shaped = demand_value(shaped)
    return attach_flows(shaped, flows).select(*on, *MARKET_MEASURES, F.lit(version).cast("long").alias("version"))


def attach_flows(summary: DataFrame, flows: DataFrame | None) -> DataFrame:
    """Flow columns by interval and region; their market values are constant."""
    if flows is None:
        return summary.withColumns({c: F.lit(None).cast("double") for c in FLOW_COLUMNS})
    known = flows.select("interval", "network_region", *FLOW_COLUMNS[:4])
    known = known.withColumns({c: F.lit(0.0) for c in FLOW_COLUMNS[4:]})
    return summary.join(known, ["interval", "network_region"], "left")


# --- intensities -----------------------------------------------------------------------------


def region_intensity(unit_fact: DataFrame, network: str = "NEM") -> DataFrame:
    """Energy, emissions and their ratio per interval and region of a network."""
    running = unit_fact.filter(
        (F.col("network_id") == network) & (F.col("generated") > 0) & (F.col("fueltech_id") != "battery_charging")
    )
    sums = running.groupBy("interval", "network_region").agg(
        F.sum("energy").alias("energy"), F.sum("emissions").alias("emissions")
    )
    ratio = F.when(F.col("energy") > 0, F.col("emissions") / F.col("energy")).otherwise(F.lit(0.0))
    return sums.withColumn("emissions_intensity", ratio)


def region_factor(
    telemetry: DataFrame,
    units: DataFrame,
    step: timedelta,
    start: datetime,
    end: datetime,
    network: str = "NEM",
    limit: int = 1000,
) -> DataFrame:
    """Emission factor per region on a complete grid; at most `limit` steps."""
    guard_intervals(start, end, step, limit)
    minutes = int(step.total_seconds() // 60)
    dims = units.filter((F.col("network_id") == network) & ~F.col("interconnector")).select(
        "unit_code", "facility_code", "network_region", "emissions_factor_co2"
    )
    per_facility = (
        telemetry.filter(
            ~F.col("is_forecast") & (F.col("generated") > 0) & F.col("interval").between(ts_lit(start), ts_lit(end))
        )
        .join(dims, "unit_code")
        .groupBy(floor_minutes("interval", minutes).alias("interval"), "facility_code", "network_region")
        .agg(
            F.coalesce(F.sum("generated"), F.lit(0.0)).alias("power"),
            F.coalesce(F.sum("generated") * F.max("emissions_factor_co2"), F.lit(0.0)).alias("emissions"),
        )
    )
    # Created steps add nothing but the row itself, so the grid is per region.
    sums = per_facility.groupBy("interval", "network_region").agg(
        F.sum("power").alias("generated"), F.sum("emissions").alias("emissions")
    )
    full = gapfill(sums, ["network_region"], "interval", step, start, end)
    generated, out = F.col("generated"), F.col("emissions")
    return full.select(
        "interval",
        "network_region",
        F.coalesce(generated, F.lit(0.0)).alias("generated"),
        F.coalesce(out, F.lit(0.0)).alias("emissions"),
        F.when(generated > 0, F.round(out / generated, 4)).otherwise(F.lit(0.0)).alias("emissions_factor"),
    )


