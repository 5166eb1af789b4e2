"""Feeds of other shapes: interval CSV, JSON, XML, statistics, notices.

Every `parse_...` takes a frame of raw text or JSON and does the work; the
`read_...` beside it only points Spark at files.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.functions.clean import parse_ts
from wattframe.functions.lookups import lookup
from wattframe.functions.timebucket import NTZ, ts_lit
from wattframe.operators.ingest import derive_power_energy, detect_cadence
from wattframe.operators.ordered import last_known
from wattframe.sources.reports import read_lines, split_csv

# Headers of the interval CSV and their column names.
FACILITY_COLUMNS = {
    "Trading Date": "trading_date",
    "Interval Number": "interval_number",
    "Trading Interval": "trading_interval",
    "Participant Code": "participant_code",
    "Facility Code": "facility_code",
    "Energy Generated (MWh)": "eoi_quantity",
    "EOI Quantity (MW)": "power",
    "Extracted At": "extracted_at",
}


def empty_to_null(c: Column | str) -> Column:
    """Number of a text cell; blank or unreadable is NULL, a published 0 stays 0."""
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string")).try_cast("double")


def parse_facility_csv(df: DataFrame, interval_minutes: int | None = None, group: Sequence[str] = ("file",)) -> DataFrame:
    """Interval rows with power and energy derived from what was published.

    The cadence is detected per file unless given.
    """
    named = df.withColumnsRenamed({k: v for k, v in FACILITY_COLUMNS.items() if k in df.columns})
    keep = list(group)

    def number(c: str) -> Column:
        return (empty_to_null(c) if c in named.columns else F.lit(None).cast("double")).alias(c)

    rows = named.select(
        *keep,
        parse_ts("trading_interval").alias("trading_interval"),
        "facility_code",
        *[number(c) for c in ("power", "generated_scheduled", "generated_non_scheduled", "eoi_quantity")],
    )
    if interval_minutes is None:
        cadence = detect_cadence(rows, "trading_interval", keep)
        rows = rows.join(cadence, keep, "left")
    else:
        rows = rows.withColumn("interval_minutes", F.lit(interval_minutes))
    return derive_power_energy(rows)


def read_facility_csv(spark: SparkSession, path: str, interval_minutes: int | None = None) -> DataFrame:
    """Interval CSV files with a header, all cells text."""
    raw = spark.read.csv(path, header=True, inferSchema=False).withColumn("file", F.col("_metadata.file_path"))
    return parse_facility_csv(raw, interval_minutes)


def _naive(c: Column) -> Column:
    """Local part of an ISO time with offset."""
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast(NTZ)


DISPATCH_SCHEMA = (
    "primaryDispatchInterval string, solutionData array<struct<dispatchInterval: string, "
    "prices: struct<energy: string>, schedule: array<struct<marketService: string, "
    "facilitySchedule: array<struct<facilityCode: string, quantity: double>>>>>>"
)


def parse_dispatch(df: DataFrame, json: str = "value") -> tuple[DataFrame, DataFrame]:
    """Telemetry and prices of the binding interval of each dispatch solution.

    The look-ahead intervals are projections and left out; an unreadable price
    costs only itself.
    """
    doc = F.from_json(F.col(json), DISPATCH_SCHEMA)
    runs = df.select(doc.alias("d")).select("d.primaryDispatchInterval", F.explode("d.solutionData").alias("s"))
    binding = runs.filter(F.col("s.dispatchInterval") == F.col("primaryDispatchInterval"))
    interval = _naive(F.col("s.dispatchInterval"))
    energy = F.get(F.filter("s.schedule", lambda x: x["marketService"] == "energy"), F.lit(0))
    quantity = F.coalesce("f.quantity", F.lit(0.0))
    telemetry = (
        binding.select(interval.alias("interval"), F.explode(energy["facilitySchedule"]).alias("f"))
        .select(
            "interval",
            F.lit("WEM").alias("network_id"),
            F.col("f.facilityCode").alias("unit_code"),
            quantity.alias("generated"),
            (quantity / 12).alias("energy"),
            F.lit(False).alias("is_forecast"),
            F.lit(2).cast("short").alias("energy_quality_flag"),
        )
    )
    prices = binding.select(
        interval.alias("interval"),
        F.lit("WEM").alias("network_id"),
        F.lit("WEM").alias("network_region"),
        F.col("s.prices.energy").try_cast("double").alias("price_dispatch"),
    ).filter(F.col("price_dispatch").isNotNull())
    return telemetry, prices


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def read_dispatch_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_dispatch(_documents(spark, path))


SCADA_SCHEMA = "facilityScadaDispatchIntervals array<struct<dispatchInterval: string, code: string, quantity: double>>"


def parse_scada(df: DataFrame, json: str = "value") -> DataFrame:
    """Telemetry from five-minute energy quantities."""
    doc = F.from_json(F.col(json), SCADA_SCHEMA)
    rows = df.select(F.explode(doc["facilityScadaDispatchIntervals"]).alias("e"))
    quantity = F.coalesce("e.quantity", F.lit(0.0))
    return rows.select(
        _naive(F.col("e.dispatchInterval")).alias("interval"),
        F.lit("WEM").alias("network_id"),
        F.col("e.code").alias("unit_code"),
        (quantity * 12).alias("generated"),
        quantity.alias("energy"),
        F.lit(False).alias("is_forecast"),
        F.lit(2).cast("short").alias("energy_quality_flag"),
    )


def read_scada_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_scada(_documents(spark, path))


PRICE_SCHEMA = "referenceTradingPrices array<struct<tradingInterval: string, referenceTradingPrice: double>>"


def parse_prices(df: DataFrame, json: str = "value", expected: int = 48) -> DataFrame:
    """Trading prices of complete days; an incomplete document yields nothing."""
    doc = df.select(F.from_json(F.col(json), PRICE_SCHEMA)["referenceTradingPrices"].alias("p"))
    rows = doc.filter(F.size("p") == expected).select(F.explode("p").alias("e"))
    price = F.col("e.referenceTradingPrice")
    return rows.filter(price != 0).select(
        _naive(F.col("e.tradingInterval")).alias("interval"),
        F.lit("WEM").alias("network_id"),
        F.lit("WEM").alias("network_region"),
        price.alias("price"),
    )


def read_price_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_prices(_documents(spark, path))


# First digit of a postcode and its state.
POSTCODE_STATES = {
    "1": "NSW",
    "2": "NSW",
    "3": "VIC",
    "4": "QLD",
    "5": "SA",
    "6": "WA",
    "7": "TAS",
    "0": "NT",
}
# Digit a state's capacity is summed by.
STATE_POSTCODES = {"NSW": "2", "VIC": "3", "QLD": "4", "SA": "5", "WA": "6", "TAS": "7", "NT": "0"}
POSTCODE_SCHEMA = (
    "performance map<string, map<string, double>>, capacity map<string, double>, installations map<string, bigint>"
)


def rooftop_from_postcode(df: DataFrame, json: str = "value") -> DataFrame:
    """Rooftop output per state and time from percentages by postcode area."""
    doc = df.select(F.from_json(F.col(json), POSTCODE_SCHEMA).alias("d"))
    areas = doc.select("d.capacity", F.explode("d.performance").alias("area", "points"))
    capacity = F.try_element_at("capacity", F.col("area"))
    points = areas.select(
        lookup(F.substring("area", 1, 1), POSTCODE_STATES).alias("state"),
        capacity.alias("capacity"),
        F.explode("points").alias("at", "share"),
    ).filter(F.col("state").isNotNull() & F.col("capacity").isNotNull())
    output = points.groupBy("state", "at").agg(F.sum(F.col("share") / 100 * F.col("capacity")).alias("generated"))
    return output.select("state", parse_ts("at").alias("interval"), "generated", (F.col("generated") / 4).alias("energy"))


def rooftop_state_capacity(df: DataFrame, json: str = "value") -> DataFrame:
    """Installed rooftop capacity and systems per state."""
    doc = df.select(F.from_json(F.col(json), POSTCODE_SCHEMA).alias("d"))
    areas = doc.select("d.installations", F.explode("d.capacity").alias("area", "capacity"))
    by_digit = {digit: state for state, digit in STATE_POSTCODES.items()}
    state = lookup(F.substring("area", 1, 1), by_digit)
    systems = F.max(F.try_element_at("installations", F.lower(state)))
    return (
        areas.filter(state.isNotNull())
        .groupBy(state.alias("state"))
        .agg(F.sum("capacity").alias("capacity_registered"), systems.alias("unit_number"))
    )


# Size bins of installed systems, in kW.
CAPACITY_BINS = ("2hf", "2hf_4hf", "4hf_6hf", "6hf_9hf", "9hf_14", "14_25", "25_50", "50_100", "100_5000")


def rooftop_capacity_monthly(df: DataFrame, state: str = "state", month: str = "month") -> DataFrame:
    """Cumulative installed capacity in MW per state and month."""
    added = sum((F.coalesce(F.col(f"`{b}`"), F.lit(0.0)) for b in CAPACITY_BINS), F.lit(0.0)) / 1000
    rows = df.select(
        F.concat(F.lit("ROOFTOP_APVI_"), F.upper(state)).alias("facility_code"),
        F.upper(state).alias("state"),
        F.try_to_timestamp(F.col(month), F.lit("yyyy-MM")).cast(NTZ).alias("month"),
        added.alias("_added"),
    )
    monthly = rows.groupBy("facility_code", "state", "month").agg(F.sum("_added").alias("_added"))
    # One row per state and month by now.
    w = Window.partitionBy("facility_code").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("facility_code", "state", "month", F.sum("_added").over(w).alias("capacity_registered"))


OBSERVATION_SCHEMA = (
    "observations struct<header: array<struct<state_time_zone: string>>, data: array<struct<"
    "aifstime_utc: string, air_temp: double, apparent_t: double, press_qnh: double, wind_dir: string, "
    "wind_spd_kmh: double, gust_kmh: double, rel_hum: double, cloud: string, cloud_type: string>>>"
)


def parse_observations(df: DataFrame, json: str = "value", station: str = "station_id") -> DataFrame:
    """Weather observations with a temperature, and the state they are from."""
    doc = F.from_json(F.col(json), OBSERVATION_SCHEMA)["observations"]
    rows = df.select(station, doc["header"][0]["state_time_zone"].alias("state"), F.explode(doc["data"]).alias("o"))
    stamp = F.try_to_timestamp(F.col("o.aifstime_utc"), F.lit("yyyyMMddHHmmss")).cast(NTZ)
    return rows.filter(F.col("o.air_temp").isNotNull()).select(
        F.col(station).alias("station_id"),
        "state",
        stamp.alias("observation_time"),
        F.col("o.air_temp").alias("temp_air"),
        F.col("o.apparent_t").alias("temp_apparent"),
        F.col("o.press_qnh").alias("pressure"),
        F.col("o.wind_dir").alias("wind_dir"),
        F.col("o.wind_spd_kmh").alias("wind_speed"),
        F.col("o.gust_kmh").alias("wind_gust"),
        F.col("o.rel_hum").alias("humidity"),
        F.nullif(F.col("o.cloud"), F.lit("-")).alias("cloud"),
        F.nullif(F.col("o.cloud_type"), F.lit("-")).alias("cloud_type"),
    )


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation files named after their station."""
    docs = _documents(spark, path)
    return parse_observations(docs.withColumn("station_id", F.regexp_extract("file", r"([^/]+)\.json$", 1)))


# Method fields of a reported emission.
METHODS = {
    "mass_balance": "mass_balance_estimation",
    "engineering_calc": "engineering_calculations_estimation",
    "direct_measurement": "direct_measurement_estimation",
    "emission_factors": "emission_factors_estimation",
    "approved_alternative": "approved_alternative_estimation",
}
REPORT_SCHEMA = (
    "facility_name string, jurisdiction_facility_id string, registered_business_name string, year string, "
    "site_address_state string, site_latitude string, site_longitude string, main_activities string, "
    "number_of_employees string, emissions struct<emission: array<struct<substance: string, destination: string, "
    "quantity_in_kg: string, " + ", ".join(f"{m}: string" for m in METHODS.values()) + ">>>"
)


def _truth(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "yes", "y", "1")


def parse_pollution(reports: DataFrame) -> DataFrame:
    """Emission rows of facility reports, those without the essentials left out."""
    named = reports.filter(F.col("facility_name").isNotNull() & F.col("jurisdiction_facility_id").isNotNull())
    rows = named.select(
        "facility_name",
        F.col("jurisdiction_facility_id").alias("npi_facility_id"),
        F.coalesce(F.col("year").try_cast("int"), F.lit(0)).alias("report_year"),
        F.col("site_address_state").alias("state"),
        F.col("site_latitude").try_cast("double").alias("latitude"),
        F.col("site_longitude").try_cast("double").alias("longitude"),
        F.explode("emissions.emission").alias("e"),
    )
    quantity = F.replace(F.col("e.quantity_in_kg"), F.lit(","), F.lit("")).try_cast("double")
    complete = F.col("e.substance").isNotNull() & F.col("e.destination").isNotNull() & quantity.isNotNull()
    return rows.filter(complete).select(
        "facility_name",
        "npi_facility_id",
        "report_year",
        "state",
        "latitude",
        "longitude",
        F.col("e.substance").alias("name"),
        F.col("e.destination").alias("destination"),
        quantity.alias("quantity_kg"),
        *[F.coalesce(_truth(F.col(f"e.{field}")), F.lit(False)).alias(n) for n, field in METHODS.items()],
    )


def split_reports(files: DataFrame, xml: str = "value") -> DataFrame:
    """The reports of whole XML files held in a column, a row each."""
    parsed = F.from_xml(F.col(xml), f"report array<struct<{REPORT_SCHEMA}>>")
    return files.select(F.explode(parsed["report"]).alias("r")).select("r.*")


def read_pollution_xml(spark: SparkSession, path: str) -> DataFrame:
    """Pollutant reports from XML files."""
    return parse_pollution(spark.read.format("xml").option("rowTag", "report").schema(REPORT_SCHEMA).load(path))


def parse_stat_csv(lines: DataFrame, series: str, country: str = "au", stat_type: str = "CPI", after: datetime | None = None) -> DataFrame:
    """One series of a statistics file whose header sits below a preamble.

    The row starting with "Series ID" names the columns; unreadable rows are
    skipped. `lines` has the layout of `read_lines`.
    """
    cells = F.col("_cells")
    rows = lines.select("file", "block", "row", split_csv(F.col("line")).alias("_cells"))
    position = F.array_position(cells, series)
    header = F.when((F.get(cells, F.lit(0)) == "Series ID") & (position > 0), position)
    placed = last_known(rows.withColumn("_at", header), ["file"], "row", ["_at"], chunk=F.col("block"))
    date = F.try_to_timestamp(F.get(cells, F.lit(0)), F.lit("dd/MM/yyyy")).cast(NTZ)
    value = F.trim(F.try_element_at(cells, F.col("_at").cast("int"))).try_cast("double")
    found = placed.filter(F.col("_at").isNotNull()).select(
        date.alias("stat_date"), F.lit(country).alias("country"), F.lit(stat_type).alias("stat_type"), F.round(value, 4).alias("value")
    )
    found = found.filter(F.col("stat_date").isNotNull() & F.col("value").isNotNull())
    return found.filter(F.col("stat_date") > ts_lit(after)) if after else found


def read_stat_csv(spark: SparkSession, path: str, series: str, **options) -> DataFrame:
    return parse_stat_csv(read_lines(spark, path), series, **options)


# Labels of a market notice and the fields they fill.
NOTICE_LABELS = {
    "notice_id": r"Notice ID",
    "notice_type": r"Notice Type ID",
    "description": r"Notice Type Description",
    "issue_date": r"Issue Date",
    "external_reference": r"External Reference",
    "created_at": r"Creation Date",
    "issued_by": r"From",
}


def parse_notices(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Fields of market notices from their labelled lines, and the reason."""
    c = F.col(text)

    def field(label: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^\s*{label}\s*:[ \t]*(.*)$", 1)), F.lit(""))

    reason = F.trim(F.regexp_extract(c, r"(?s)\nReason :\s*\n(.*?)\n-{20,}", 1))
    got = {n: field(label) for n, label in NOTICE_LABELS.items()}
    return df.filter(c.contains("MARKET NOTICE")).select(
        *keep,
        got["notice_id"].try_cast("long").alias("notice_id"),
        got["notice_type"].alias("notice_type"),
        got["description"].alias("description"),
        F.try_to_timestamp(got["issue_date"], F.lit("dd/MM/yyyy")).cast(NTZ).alias("issue_date"),
        F.try_to_timestamp(F.regexp_replace(got["created_at"], r"\s+", " "), F.lit("dd/MM/yyyy HH:mm:ss")).cast(NTZ).alias("created_at"),
        got["external_reference"].alias("external_reference"),
        got["issued_by"].alias("issued_by"),
        F.nullif(reason, F.lit("")).alias("reason"),
    )


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """One notice per text file."""
    return parse_notices(_documents(spark, path), "value", ["file"])
