"""Monitors over telemetry, units and the master list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.lookups import fueltech_group
from wattframe.functions.timebucket import epoch_seconds, step_lit, ts_lit
from wattframe.operators.versioning import dedupe_first

# Night hours and limits of the frozen-signal check.
NIGHT_FROM, NIGHT_TO = 22, 3
CAPACITY_FRACTION = 0.1
MIN_NIGHT_INTERVALS = 6
FLAT_RANGE = 0.01

# Codes and code parts expected to carry energy without a unit.
KNOWN_UNMAPPED = ("BBATTERY", "BBATRYL1", "DALNTH01")
INTERCONNECTOR_PARTS = ("MNSP", "FLOW", "-NSW1", "-QLD1", "-VIC1", "-SA1", "-TAS1", "V-S", "V-SA", "N-Q")
ENERGY_THRESHOLD = 1.0


def frozen_telemetry(telemetry: DataFrame, units: DataFrame, start, network: str = "NEM") -> DataFrame:
    """Solar units reporting material output at night, longest first.

    A night belongs to the date it began on.
    """
    hour = F.hour("interval")
    dims = units.filter((F.col("fueltech_id") == "solar_utility") & (F.col("capacity_registered") > 0)).select(
        "unit_code", "network_region", "capacity_registered"
    )
    dark = telemetry.filter(
        (F.col("network_id") == network)
        & ~F.col("is_forecast")
        & (F.col("interval") >= ts_lit(start))
        & ((hour >= NIGHT_FROM) | (hour < NIGHT_TO))
    )
    night = F.to_date(F.col("interval") - step_lit(timedelta(hours=3)))
    found = (
        dark.join(dims, "unit_code")
        .filter(F.col("generated") > CAPACITY_FRACTION * F.col("capacity_registered"))
        .groupBy("unit_code", "network_region", night.cast("timestamp_ntz").alias("night"), "capacity_registered")
        .agg(
            F.count(F.lit(1)).alias("intervals"),
            F.min("generated").alias("min_mw"),
            F.max("generated").alias("max_mw"),
        )
        .filter(F.col("intervals") >= MIN_NIGHT_INTERVALS)
    )
    flat = F.abs(F.col("max_mw") - F.col("min_mw")) < FLAT_RANGE
    return found.withColumn("is_constant", flat).orderBy(F.col("intervals").desc(), F.col("night").desc(), "unit_code")


def is_interconnector_code(code: Column) -> Column:
    hit = F.lit(False)
    for part in INTERCONNECTOR_PARTS:
        hit = hit | code.contains(part)
    return hit


def dropped_codes(telemetry: DataFrame, units: DataFrame, start, known: Sequence[str] = KNOWN_UNMAPPED, threshold: float = ENERGY_THRESHOLD) -> DataFrame:
    """Codes carrying energy that no unit, or no usable unit, stands for.

    Energy is summed per code first, so the join is between dimension-sized
    frames.
    """
    sums = (
        telemetry.filter(~F.col("is_forecast") & (F.col("interval") >= ts_lit(start)))
        .groupBy("network_id", F.col("unit_code").alias("code"))
        .agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy_mwh"), F.count(F.lit(1)).alias("intervals"))
        .filter(F.abs("energy_mwh") > threshold)
    )
    dims = units.select(F.col("unit_code").alias("code"), "fueltech_id", "facility_code", F.lit(True).alias("_unit"))
    reason = F.when(F.col("_unit").isNull(), "no units row").when(
        F.col("fueltech_id").isNull() | F.col("facility_code").isNull(), "unit has no fueltech or station"
    )
    joined = sums.join(dims, "code", "left").withColumn("reason", reason).filter(F.col("reason").isNotNull())
    expected = F.col("code").isin(*known) | is_interconnector_code(F.col("code"))
    return joined.filter(~expected).select("network_id", "code", "reason", "energy_mwh", "intervals").orderBy(
        F.abs("energy_mwh").desc(), "code"
    )


# Technologies without dates of their own.
UNDATED = ("solar_rooftop", "imports", "exports", "interconnector")


def unit_date_issues(units: DataFrame) -> DataFrame:
    """Missing and contradictory unit dates, one row per issue."""
    rows = units.filter(~F.col("fueltech_id").isin(*UNDATED) & ~is_interconnector_code(F.col("unit_code")))
    status, begin, end = F.col("status_id"), F.col("commencement_date"), F.col("closure_date")
    checks = {
        "operating_missing_commencement": (status == "operating") & begin.isNull(),
        "retired_missing_closure": (status == "retired") & end.isNull(),
        "closure_before_commencement": begin.isNotNull() & end.isNotNull() & (end < begin),
        "operating_with_closure": (status == "operating") & end.isNotNull(),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return rows.select(
        F.explode(issues).alias("issue"), "unit_code", "fueltech_id", "status_id", "commencement_date", "closure_date"
    )


def split_lag(telemetry: DataFrame, unit_map: DataFrame, start, tolerance: int = 2) -> DataFrame:
    """Two-way units whose charge or discharge copies fall behind.

    Several units mapped to the same pair count once.
    """
    recent = telemetry.filter(~F.col("is_forecast") & (F.col("interval") >= ts_lit(start)))
    counts = recent.groupBy("unit_code").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("generated") < 0).alias("neg_rows"),
        F.count_if(F.col("generated") >= 0).alias("pos_rows"),
    )
    pairs = dedupe_first(unit_map, ["charge_unit", "discharge_unit"], "unit")
    two_way = counts.select(F.col("unit_code").alias("unit"), "neg_rows", "pos_rows")
    charge = counts.select(F.col("unit_code").alias("charge_unit"), F.col("rows").alias("charge_rows"))
    discharge = counts.select(F.col("unit_code").alias("discharge_unit"), F.col("rows").alias("discharge_rows"))
    joined = (
        pairs.join(two_way, "unit").join(charge, "charge_unit", "left").join(discharge, "discharge_unit", "left")
    ).fillna(0, subset=["charge_rows", "discharge_rows"])
    neg, pos = F.col("neg_rows"), F.col("pos_rows")
    late = ((neg > 0) & (neg - F.col("charge_rows") > tolerance)) | ((pos > 0) & (pos - F.col("discharge_rows") > tolerance))
    return joined.filter(late).select("unit", "neg_rows", "charge_rows", "pos_rows", "discharge_rows")


def seen_range(telemetry: DataFrame) -> DataFrame:
    """First and last actual reading of each code; a zero is a reading."""
    rows = telemetry.filter(~F.col("is_forecast") & F.col("generated").isNotNull())
    return rows.groupBy("unit_code").agg(
        F.min("interval").alias("data_first_seen"), F.max("interval").alias("data_last_seen")
    )


def with_seen_range(units: DataFrame, telemetry: DataFrame, keep_first: bool = False) -> DataFrame:
    """Units with their seen dates brought up to date."""
    seen = seen_range(telemetry).withColumnsRenamed({"data_first_seen": "_f", "data_last_seen": "_l"})
    out = units.join(seen, "unit_code", "left")
    for c, new in (("data_first_seen", "_f"), ("data_last_seen", "_l")):
        old = F.col(c) if c in units.columns else F.lit(None).cast("timestamp_ntz")
        first = old if keep_first and c == "data_first_seen" else F.coalesce(F.col(new), old)
        out = out.withColumn(c, first)
    return out.drop("_f", "_l")


# Eastern-market codes that never become units.
IGNORED_CODES = ("VSSEL1V1", "VSSAEV1", "VSSSE1V1", "VSNSN1V1", "VSSSH1S1", "VSVEL2S1", "VSNEL2S1", "VSQHT1V1")
IGNORED_PATTERN = r"^(DG_|RT_|PTH0|DRX)|V1$"


def new_codes(telemetry: DataFrame, units: DataFrame, start, pattern: str = IGNORED_PATTERN, ignored: Sequence[str] = IGNORED_CODES) -> DataFrame:
    """Codes in recent telemetry that no unit has, without the ignored ones."""
    sums = (
        telemetry.filter(F.col("interval") > ts_lit(start))
        .groupBy("unit_code", "network_id")
        .agg(F.round(F.abs(F.sum("generated")), 2).alias("generated"))
    )
    fresh = sums.join(units.select("unit_code"), "unit_code", "left_anti")
    skip = (F.col("network_id") == "NEM") & (F.col("unit_code").rlike(pattern) | F.col("unit_code").isin(*ignored))
    return fresh.filter(~skip)


def feed_gap(units: DataFrame, now: datetime, limit_minutes: int = 30, network: str = "NEM") -> DataFrame:
    """One row: when operating generators were last seen, and whether that is too long ago."""
    rows = units.filter(
        (F.col("status_id") == "operating") & (F.col("network_id") == network) & (F.col("dispatch_type") == "GENERATOR")
    )
    last = rows.agg(F.max("data_last_seen").alias("last_seen"))
    minutes = (epoch_seconds(ts_lit(now)) - epoch_seconds("last_seen")) / 60
    return last.select(
        "last_seen", minutes.alias("gap_minutes"), F.coalesce(minutes > limit_minutes, F.lit(True)).alias("has_gap")
    )


def effective_status(status: Column, max_generation: Column, capacity_maximum: Column, capacity_registered: Column) -> Column:
    """Operating units that have not come near their capacity are commissioning."""
    capacity = F.when(capacity_maximum != 0, capacity_maximum).otherwise(capacity_registered)
    low = (max_generation != 0) & (capacity != 0) & (max_generation / F.nullif(capacity, F.lit(0.0)) <= 0.9)
    return F.when((status == "operating") & F.coalesce(low, F.lit(False)), F.lit("commissioning")).otherwise(status)


def list_facilities(facilities: DataFrame, units: DataFrame, status: Sequence[str] | None = None, fueltech: Sequence[str] | None = None, groups: Sequence[str] | None = None, networks: Sequence[str] | None = None, regions: Sequence[str] | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """Facilities with those of their units that pass the filters.

    A facility without a unit left is not listed.
    """
    ft = F.col("fueltech_id")
    rows = units.withColumn(
        "status_id",
        effective_status(*[F.col(c) for c in ("status_id", "max_generation", "capacity_maximum", "capacity_registered")]),
    ).filter(F.col("approved") & ~F.col("interconnector") & ~F.coalesce(ft, F.lit("")).isin("solar_rooftop", "imports", "exports"))
    if status:
        rows = rows.filter(F.col("status_id").isin(*status))
    if fueltech:
        rows = rows.filter(ft.isin(*fueltech))
    if groups:
        rows = rows.filter(fueltech_group(ft).isin(*groups))
    kept = facilities
    for column, wanted in (("network_id", networks), ("network_region", regions), ("facility_code", codes)):
        if wanted:
            kept = kept.filter(F.col(column).isin(*wanted))
    unit = F.struct("unit_code", "fueltech_id", "status_id", "dispatch_type", "capacity_registered", "capacity_maximum")
    # The units of one station: a short list.
    nested = rows.groupBy("facility_code").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    return kept.join(nested, "facility_code")


def _flag(column: str) -> Column:
    """Whether a field is filled; 0, blank and false count as empty."""
    c = F.col(column).cast("string")
    return F.coalesce(~c.isin("", "0", "0.0", "false"), F.lit(False)).cast("string")


# Fields of the completeness matrix.
FACILITY_FIELDS = {"description": "has_description", "location": "has_location", "photos": "has_photos"}
UNIT_FIELDS = {
    "capacity_registered": "has_capacity",
    "capacity_maximum": "has_capacity_max",
    "emissions_factor_co2": "has_emissions_intensity",
    "expected_closure_date": "has_expected_closure_date",
    "commencement_date": "has_commencement_date",
}


def completeness(facilities: DataFrame, units: DataFrame) -> DataFrame:
    """Which fields of each unit and its facility are filled; NA where they do not apply."""
    sites = facilities.select("facility_code", *[_flag(c).alias(n) for c, n in FACILITY_FIELDS.items() if c in facilities.columns])
    stores = F.col("fueltech_id").isin("battery", "battery_charging", "battery_discharging")
    storage = _flag("capacity_storage") if "capacity_storage" in units.columns else F.lit("false")
    flags = units.select(
        "facility_code",
        "unit_code",
        "fueltech_id",
        "status_id",
        *[_flag(c).alias(n) for c, n in UNIT_FIELDS.items() if c in units.columns],
        F.when(stores, storage).otherwise("NA").alias("has_storage_capacity"),
        F.when(F.col("status_id") == "retired", _flag("closure_date")).otherwise("NA").alias("has_closure_date"),
    )
    return sites.join(flags, "facility_code")


def duplicate_codes(df: DataFrame, key: str) -> DataFrame:
    """Codes that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("records")).filter(F.col("records") > 1)


def orphans(stored: DataFrame, master: DataFrame, code: str = "facility_code") -> DataFrame:
    """Stored facilities the master list does not know, whatever the case."""
    known = master.select(F.upper(code).alias("_code")).filter(F.col("_code").isNotNull()).distinct()
    return stored.join(known, F.upper(stored[code]) == known["_code"], "left_anti")


def export_sanity(facilities: DataFrame, units: DataFrame) -> DataFrame:
    """Issues of the facility export, one row each.

    Operating two-way batteries are not exported, as their halves are.
    """
    ft, dispatch = F.col("fueltech_id"), F.col("dispatch_type")
    exported = units.filter(~(F.coalesce(ft == "battery", F.lit(False)) & F.coalesce(F.col("status_id") == "operating", F.lit(False))))
    empty = facilities.join(exported.select("facility_code"), "facility_code", "left_anti").select(
        "facility_code", F.lit(None).cast("string").alias("unit_code"), F.lit("no units").alias("issue")
    )
    wrong = ((ft == "battery_discharging") & (dispatch != "GENERATOR")) | ((ft == "battery_charging") & (dispatch != "LOAD"))
    checks = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"missing {c}")) for c in ("unit_code", "fueltech_id", "dispatch_type", "status_id")]
    checks.append(F.when(wrong, F.lit("wrong dispatch type")))
    found = exported.select("facility_code", "unit_code", F.explode(F.array_compact(F.array(*checks))).alias("issue"))
    return empty.unionByName(found)


def changed_since(df: DataFrame, ts: str, now: datetime, hours: int = 24) -> DataFrame:
    """Rows updated in the last hours, newest first."""
    return df.filter(F.col(ts) >= ts_lit(now - timedelta(hours=hours))).orderBy(F.col(ts).desc())


def resolve_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """Operational codes: the leading 0 of synthetic ones goes, if that is free.

    When the stripped code belongs to another record the code stays whole.
    Decided against all codes at once, so row order does not matter.
    """
    c = F.col(code)
    synthetic = (F.length(c) > 1) & c.rlike(r"^0[A-Za-z]")
    stripped = F.when(synthetic, F.substr(c, F.lit(2))).otherwise(c)
    claimed = df.select(F.col(code).alias("_claimed")).distinct()
    marked = df.withColumn("_stripped", stripped)
    joined = marked.join(claimed, (F.col("_stripped") == F.col("_claimed")) & (F.col("_stripped") != F.col(code)), "left")
    operational = F.when(F.col("_claimed").isNotNull(), F.col(code)).otherwise(F.col("_stripped"))
    return joined.withColumn("operational_code", operational).withColumn("display_code", F.col(code)).drop(
        "_stripped", "_claimed"
    )


def unique_units(df: DataFrame, order: Sequence[str], code: str = "operational_code") -> DataFrame:
    """Units whose resolved code is taken by an earlier one are skipped."""
    return dedupe_first(df, [code], list(order))
