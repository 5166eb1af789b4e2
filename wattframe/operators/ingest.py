"""From feed rows to telemetry and market rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.clean import parse_ts
from wattframe.functions.lookups import NETWORKS, TWO_WAY_FUELTECHS, Network, literal_map
from wattframe.functions.timebucket import epoch_seconds, step_lit, ts_lit
from wattframe.operators.ordered import last_known
from wattframe.operators.versioning import dedupe_first, dedupe_last

TELEMETRY_KEYS = ("interval", "network_id", "unit_code", "is_forecast")

# Retired one-way codes and the codes that carry on their series.
ALIASES = {"BBATTERY": "BBATTERYG1", "BBATRYL1": "BBATTERYL1", "DALNTH01": "DALNTHG1"}

# Two-way units and their charge and discharge codes, set by hand.
MANUAL_UNIT_MAP = {
    "COLLIE_ESR1": ("COLLIE_ESRL1", "COLLIE_ESRG1"),
    "LVES1": ("LVESL1", "LVESG1"),
    "ULPBESS1": ("ULPBESSL1", "ULPBESSG1"),
    "COLLIE_BESS2": ("COLLIE_BESSL2", "COLLIE_BESSG2"),
    "SNB01": ("SNBL01", "SNBG01"),
    "TARBESS1": ("TARBESSL1", "TARBESSG1"),
    "TEMPB1": ("TEMPBL1", "TEMPBG1"),
    "WDBESS1": ("WDBESSL1", "WDBESSG1"),
    "DALNTH1": ("DALNTHL1", "DALNTHG1"),
    "BBATTERY1": ("BBATTERYL1", "BBATTERYG1"),
}

# Technologies and the day their readings become usable.
HISTORY_CUTOFFS = {"solar": "2016-08-01", "wind": "2009-07-01"}

# Cadences a feed may have, and the one assumed otherwise.
KNOWN_CADENCES = (5, 30)
LEGACY_CADENCE = 30


def to_telemetry(
    df: DataFrame,
    ts: str = "settlementdate",
    code: str = "duid",
    power: str = "scadavalue",
    network: Network = NETWORKS["NEM"],
    energy_storage: str | None = None,
    is_forecast: bool = False,
    order=None,
) -> DataFrame:
    """Feed rows as telemetry; of rows with one key the last by `order` stays."""
    c = F.col(ts)
    interval = c.cast("timestamp_ntz") if df.schema[ts].dataType.typeName().startswith("timestamp") else parse_ts(c)
    generated = F.coalesce(F.col(power).try_cast("double"), F.lit(0.0))
    storage = F.col(energy_storage).try_cast("double") if energy_storage else F.lit(None).cast("double")
    out = df.select(
        interval.alias("interval"),
        F.lit(network.code).alias("network_id"),
        F.col(code).alias("unit_code"),
        generated.alias("generated"),
        (generated / network.intervals_per_hour).alias("energy"),
        storage.alias("energy_storage"),
        F.lit(is_forecast).alias("is_forecast"),
        F.lit(0).cast("short").alias("energy_quality_flag"),
        *([F.col(order).alias("_order")] if order else []),
    )
    if order is None:
        return out
    return dedupe_last(out, TELEMETRY_KEYS, "_order").drop("_order")


def split_bidirectional(telemetry: DataFrame, unit_map: DataFrame) -> DataFrame:
    """Adds a charge or discharge copy of every reading of a two-way unit.

    The original stays. `unit_map` has (unit, charge_unit, discharge_unit);
    its size decides the join, nothing is forced to broadcast.
    """
    down = F.col("generated") < 0
    copies = telemetry.join(unit_map, telemetry["unit_code"] == unit_map["unit"]).select(
        *[
            F.when(down, F.col("charge_unit")).otherwise(F.col("discharge_unit")).alias(c)
            if c == "unit_code"
            else (F.abs(F.col(c)).alias(c) if c in ("generated", "energy") else F.col(c))
            for c in telemetry.columns
        ]
    )
    return telemetry.unionByName(copies)


def build_unit_map(units: DataFrame, manual: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Charge and discharge code per two-way unit.

    Hand-set entries win; a facility with several charge or discharge units is
    left out unless the other side is missing, and missing codes are made from
    the unit code with L (load) or G (generation).
    """
    manual = MANUAL_UNIT_MAP if manual is None else manual
    ft = F.col("fueltech_id")
    two_way = (F.col("dispatch_type") == "BIDIRECTIONAL") & (ft == "battery")
    per = units.groupBy("facility_code").agg(
        F.min(F.when(two_way, F.col("unit_code"))).alias("unit"),
        F.min(F.when(ft == "battery_charging", F.col("unit_code"))).alias("charge"),
        F.min(F.when(ft == "battery_discharging", F.col("unit_code"))).alias("discharge"),
        F.count_if(ft == "battery_charging").alias("n_charge"),
        F.count_if(ft == "battery_discharging").alias("n_discharge"),
    )
    unit = F.col("unit")
    synthetic = (F.col("n_charge") == 0) | (F.col("n_discharge") == 0)
    derived = per.filter(unit.isNotNull() & (synthetic | ((F.col("n_charge") == 1) & (F.col("n_discharge") == 1)))).select(
        "unit",
        F.coalesce("charge", F.concat(unit, F.lit("L"))).alias("charge_unit"),
        F.when(F.col("n_charge") == 0, F.concat(unit, F.lit("G")))
        .otherwise(F.coalesce("discharge", F.concat(unit, F.lit("G"))))
        .alias("discharge_unit"),
    )
    if not manual:
        return derived
    spark = units.sparkSession
    rows = ", ".join(f"('{u}', '{c}', '{d}')" for u, (c, d) in manual.items())
    by_hand = spark.sql(f"SELECT * FROM VALUES {rows} AS t(unit, charge_unit, discharge_unit)")
    return by_hand.unionByName(derived.filter(~unit.isin(*manual)))


def alias_copies(telemetry: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Adds a copy of retired codes' rows under the code that replaced them."""
    new = F.try_element_at(literal_map(aliases), F.col("unit_code"))
    copies = telemetry.filter(F.col("unit_code").isin(*aliases)).withColumn("unit_code", new)
    return telemetry.unionByName(copies)


def remap_region_codes(df: DataFrame, prefix: str, regions: Sequence[str], code: str = "unit_code") -> DataFrame:
    """Region ids become synthetic unit codes; unknown regions are dropped."""
    name = F.concat(F.lit(prefix), F.regexp_replace(F.col(code), "1+$", ""))
    return df.filter(F.col(code).isin(*regions)).withColumn(code, name)


# --- market feeds ---------------------------------------------------------------------


def price_feed(table: DataFrame, price_column: str, order: str, ts: str = "settlementdate") -> DataFrame:
    """First price per region and time; rows without a price do not count."""
    rows = table.filter(F.col("rrp").isNotNull())
    first = dedupe_first(rows.select(ts, "regionid", "rrp", order), [ts, "regionid"], order)
    return first.select(
        F.col(ts).alias("interval"),
        F.lit("NEM").alias("network_id"),
        F.col("regionid").alias("network_region"),
        F.lit(False).alias("is_forecast"),
        F.col("rrp").try_cast("double").alias(price_column),
    )


# Columns a curtailment figure needs, all or none.
CURTAILMENT_FIELDS = ("ss_solar_uigf", "ss_solar_clearedmw", "ss_wind_uigf", "ss_wind_clearedmw")


def region_summary(table: DataFrame, order: str, ts: str = "settlementdate") -> tuple[DataFrame, DataFrame | None]:
    """Demand at its time, and curtailment inputs five minutes later."""
    first = dedupe_first(table, [ts, "regionid"], order)
    keys = [F.lit("NEM").alias("network_id"), F.col("regionid").alias("network_region"), F.lit(False).alias("is_forecast")]
    demand = first.select(
        F.col(ts).alias("interval"),
        *keys,
        F.col("netinterchange").try_cast("double").alias("net_interchange"),
        F.col("totaldemand").try_cast("double").alias("demand"),
        F.col("demand_and_nonschedgen").try_cast("double").alias("demand_total"),
    )
    if not all(c in table.columns for c in CURTAILMENT_FIELDS):
        return demand, None
    shifted = first.select(
        (F.col(ts) + step_lit(timedelta(minutes=5))).alias("interval"),
        *keys,
        *[F.col(c).try_cast("double").alias(c) for c in CURTAILMENT_FIELDS],
    )
    return demand, shifted


def trading_region_summary(table: DataFrame, order: str, ts: str = "settlementdate") -> DataFrame:
    """Settled net interchange, first row per region and time."""
    first = dedupe_first(table, [ts, "regionid"], order)
    return first.select(
        F.col(ts).alias("interval"),
        F.lit("NEM").alias("network_id"),
        F.col("regionid").alias("network_region"),
        F.lit(False).alias("is_forecast"),
        F.col("netinterchange").try_cast("double").alias("net_interchange_trading"),
    )


def interconnector_feed(table: DataFrame, order: str, ts: str = "settlementdate") -> DataFrame:
    """Metered interconnector flow as telemetry."""
    named = table.filter(F.col("interconnectorid").isNotNull() & F.col(ts).isNotNull())
    first = dedupe_first(named, [ts, "interconnectorid"], order)
    return first.select(
        F.col(ts).alias("interval"),
        F.lit("NEM").alias("network_id"),
        F.col("interconnectorid").alias("unit_code"),
        F.col("meteredmwflow").try_cast("double").alias("generated"),
        F.lit(False).alias("is_forecast"),
    )


def _rooftop(table: DataFrame, order: str, ts: str, forecast: bool) -> DataFrame:
    """Regional rooftop output under synthetic unit codes."""
    net = NETWORKS["AEMO_ROOFTOP"]
    power = "powermean" if forecast else "power"
    remapped = remap_region_codes(table, "ROOFTOP_NEM_", net.regions, "regionid")
    return to_telemetry(remapped, ts, "regionid", power, net, is_forecast=forecast, order=order)


# The reports a feed may hold, and what each becomes.
TABLE_PROCESSORS: dict[str, Callable[[DataFrame, str], object]] = {
    "dispatch_interconnectorres": interconnector_feed,
    "dispatch_unit_scada": lambda d, o: to_telemetry(d, order=o),
    "dispatch_unit_solution": lambda d, o: to_telemetry(
        d, power="initialmw", energy_storage="energy_storage" if "energy_storage" in d.columns else None, order=o
    ),
    "meter_data_gen_duid": lambda d, o: to_telemetry(d, ts="interval_datetime", power="mwh_reading", order=o),
    "rooftop_actual": lambda d, o: _rooftop(d, o, "interval_datetime", False),
    "rooftop_forecast": lambda d, o: _rooftop(d, o, "interval_datetime", True),
    "dispatch_price": lambda d, o: price_feed(d, "price_dispatch", o),
    "trading_price": lambda d, o: price_feed(d, "price", o),
    "dispatch_regionsum": region_summary,
    "trading_regionsum": trading_region_summary,
}


def process_tables(tables: dict[str, DataFrame], order: str) -> dict[str, object]:
    """Every known report table through its processor; others are skipped."""
    return {name: TABLE_PROCESSORS[name](df, order) for name, df in tables.items() if name in TABLE_PROCESSORS}


# --- row rules ------------------------------------------------------------------------


def forecast_flag(generation: Column, non_scheduled: Column) -> Column:
    """A row without any actual is a forecast; a published zero is an actual."""
    return generation.isNull() & non_scheduled.isNull()


def relabel_region(df: DataFrame, region: str = "network_region") -> DataFrame:
    """The former Snowy region counts as New South Wales."""
    c = F.col(region)
    return df.withColumn(region, F.when(c == "SNOWY1", F.lit("NSW1")).otherwise(c))


def clamp_sum(value: Column, fueltech: Column) -> Column:
    """Sum of a bucket, floored at zero unless the technology works both ways.

    `greatest` skips NULL, so a one-way unit without readings gives 0.
    """
    total = F.round(F.sum(value), 4)
    return F.when(fueltech.isin(*TWO_WAY_FUELTECHS), total).otherwise(F.greatest(total, F.lit(0.0)))


def drop_before(df: DataFrame, ts: str, group: str, cutoffs: dict[str, str | datetime] = HISTORY_CUTOFFS) -> DataFrame:
    """Without the early history of technologies known to be unreliable."""
    keep = F.lit(True)
    for name, first in cutoffs.items():
        early = F.col(group).eqNullSafe(F.lit(name)) & (F.col(ts) < ts_lit(first))
        keep = keep & ~early
    return df.filter(keep)


def expand_network(df: DataFrame, code: str, networks: dict[str, Network] = NETWORKS, column: str = "network_id") -> DataFrame:
    """Rows of a logical network, that is of all its feeds."""
    return df.filter(F.col(column).isin(*networks[code].codes))


# --- interval files -------------------------------------------------------------------


def detect_cadence(df: DataFrame, ts: str, group: Sequence[str]) -> DataFrame:
    """Minutes between readings per group: the commonest gap, if a known one.

    Ties go to the gap that occurs first.
    """
    stamps = df.select(*group, ts).distinct()
    w = Window.partitionBy(*group, "_day").orderBy(ts)
    # Gaps are counted inside days plus across to the day before, so no task
    # holds a whole group.
    days = stamps.withColumn("_day", F.to_date(ts))
    edge = days.groupBy(*group, "_day").agg(F.max(ts).alias("_end"))
    over_days = Window.partitionBy(*group).orderBy("_day")
    edge = edge.select(*group, "_day", F.lag("_end").over(over_days).alias("_before"))
    joined = days.join(edge, [*group, "_day"])
    before = F.coalesce(F.lag(ts).over(w), F.col("_before"))
    gaps = joined.select(
        *group, F.col(ts).alias("_t"), F.floor((epoch_seconds(ts) - epoch_seconds(before)) / 60).alias("gap")
    ).filter(F.col("gap") > 0)
    counted = gaps.groupBy(*group, "gap").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("first"))
    rank = F.struct(F.col("n"), -epoch_seconds("first"))
    top = counted.groupBy(*group).agg(F.max_by("gap", rank).alias("gap"))
    known = F.when(F.col("gap").isin(*KNOWN_CADENCES), F.col("gap")).otherwise(F.lit(LEGACY_CADENCE))
    groups = stamps.select(*group).distinct()
    return groups.join(top, list(group), "left").select(
        *group, F.coalesce(known, F.lit(LEGACY_CADENCE)).cast("int").alias("interval_minutes")
    )


def derive_power_energy(df: DataFrame, minutes: str = "interval_minutes") -> DataFrame:
    """Power and energy from whichever of the published figures are present."""
    per_hour = 60 / F.col(minutes)
    sched, non, power, eoi = (F.col(c) for c in ("generated_scheduled", "generated_non_scheduled", "power", "eoi_quantity"))
    generated = F.coalesce(power, sched + non, non, sched, eoi * per_hour)
    energy = F.coalesce(eoi, power / per_hour)
    return df.withColumn("generated", generated).withColumn("energy", energy)


def unpivot_intervals(df: DataFrame, order: str, file: Sequence[str] = (), width: int = 48, chunk: Column | None = None) -> DataFrame:
    """Wide rows of the newest `width` five-minute values as long rows.

    The publication time stands only on some rows and is carried down the
    file. `order` is the row position in it; `chunk` cuts long files, by every
    thousand rows unless told otherwise.
    """
    names = [f"I{i:02d}" for i in range(1, width + 1)]
    keys = list(file)
    cut = F.floor(F.col(order) / 1000) if chunk is None else chunk
    stamped = last_known(df.withColumn("as_at", parse_ts("as_at")), keys, order, ["as_at"], cut)
    long = stamped.unpivot([*keys, "facility_code", "as_at"], names, "_name", "_value")
    number = F.substring("_name", 2, 2).cast("int")
    value = F.coalesce(F.trim("_value").try_cast("double"), F.lit(0.0))
    return long.select(
        *keys,
        "facility_code",
        (F.col("as_at") - F.make_dt_interval(F.lit(0), F.lit(0), (number - 1) * 5)).alias("interval"),
        value.alias("power"),
        (value / 12).alias("energy"),
    )
