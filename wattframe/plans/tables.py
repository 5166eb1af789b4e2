"""The given tables seen as an electricity market.

Every domain table is a deterministic projection of the given ones, written
once with the DataFrame API and once as SQL, so a query and its SQL twin start
from the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.lookups import FUELTECHS, fueltech_group, is_renewable
from wattframe.functions.timebucket import NTZ, floor_minutes
from wattframe.plans.sqltext import exact

# The span of the event table.
START = datetime(2024, 1, 1)
END = datetime(2024, 1, 31)

REGIONS = ("NSW1", "QLD1", "SA1", "TAS1", "VIC1")
UNIT_FUELTECHS = (
    "coal_black",
    "gas_ccgt",
    "wind",
    "solar_utility",
    "hydro",
    "solar_rooftop",
    "battery_charging",
    "battery_discharging",
    "pumps",
    "interconnector",
    "bioenergy_biomass",
    "distillate",
    "battery",
)


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Tables:
    """Given and domain tables of one scale directory, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- events as telemetry --------------------------------------------------

    def _unit_columns(self, uid: Column) -> dict[str, Column]:
        fueltech = pick(UNIT_FUELTECHS, uid % 13)
        rooftop = fueltech == "solar_rooftop"
        station = F.floor(uid / 3)
        west = ~rooftop & (fueltech != "interconnector") & (station % 8 == 7)
        region = F.when(west, F.lit("WEM")).when(rooftop, pick(REGIONS, uid % 5)).otherwise(pick(REGIONS, station % 5))
        return {
            "unit_code": F.concat(F.lit("U"), uid.cast("string")),
            "facility_code": F.when(rooftop, F.concat(F.lit("R"), uid.cast("string"))).otherwise(
                F.concat(F.lit("F"), station.cast("string"))
            ),
            "network_id": F.when(west, F.lit("WEM")).when(rooftop, F.lit("AEMO_ROOFTOP")).otherwise(F.lit("NEM")),
            "network_region": region,
            "fueltech_id": fueltech,
        }

    def units(self) -> DataFrame:
        """One row per unit: dimension attributes by arithmetic on its number."""
        uid = F.col("uid")
        c = self._unit_columns(uid)
        fueltech = c["fueltech_id"]
        base = self.read("events").select(F.col("user_id").alias("uid")).distinct()
        day = F.make_dt_interval((uid % 3000).cast("int"))
        return base.select(
            uid,
            *[e.alias(n) for n, e in c.items()],
            fueltech_group(fueltech).alias("fueltech_group_id"),
            is_renewable(fueltech).alias("renewable"),
            F.when(uid % 10 == 0, "retired").when(uid % 10 == 1, "committed").otherwise("operating").alias("status_id"),
            F.when(fueltech == "battery", "BIDIRECTIONAL")
            .when(fueltech.isin("battery_charging", "pumps"), "LOAD")
            .otherwise("GENERATOR")
            .alias("dispatch_type"),
            (50 + (uid % 11) * 40).cast("double").alias("capacity_registered"),
            F.when(uid % 4 != 0, (55 + (uid % 11) * 40).cast("double")).alias("capacity_maximum"),
            F.when(fueltech == "coal_black", 0.9 + (uid % 5) * 0.01)
            .when(fueltech == "gas_ccgt", 0.4)
            .when(fueltech == "distillate", 0.7)
            .when(fueltech == "bioenergy_biomass", 0.1)
            .alias("emissions_factor_co2"),
            (fueltech == "interconnector").alias("interconnector"),
            F.when(fueltech == "interconnector", pick(REGIONS, uid % 5)).alias("interconnector_region_from"),
            F.when(fueltech == "interconnector", pick(REGIONS, (uid + 1) % 5)).alias("interconnector_region_to"),
            F.when(uid % 7 != 0, F.lit("2010-01-01").cast(NTZ) + day).alias("commencement_date"),
            F.when(uid % 10 == 0, F.lit("2012-01-01").cast(NTZ) + day).alias("closure_date"),
        )

    def facilities(self) -> DataFrame:
        return self.units().groupBy("facility_code").agg(
            F.max("network_id").alias("network_id"), F.max("network_region").alias("network_region")
        )

    def telemetry(self) -> DataFrame:
        """Raw readings; several may share a unit and interval."""
        uid = F.col("user_id")
        c = self._unit_columns(uid)
        rooftop = c["fueltech_id"] == "solar_rooftop"
        ts = F.col("ts")
        return self.read("events").select(
            "event_id",
            F.when(rooftop, floor_minutes(ts, 30)).otherwise(floor_minutes(ts, 5)).alias("interval"),
            c["network_id"].alias("network_id"),
            c["unit_code"].alias("unit_code"),
            F.col("value").alias("generated"),
            (F.col("value") / F.when(rooftop, 2).otherwise(12)).alias("energy"),
            F.when(c["fueltech_id"] == "battery", F.col("value")).alias("energy_storage"),
            (F.col("event_type") == "error").alias("is_forecast"),
        )

    def signed(self) -> DataFrame:
        """Telemetry whose readings swing around zero."""
        return self.telemetry().withColumn("generated", F.round(F.col("generated") - 60, 2))

    def market(self) -> DataFrame:
        """Prices and demand per region and interval, with holes."""
        value, index = F.col("value"), F.col("user_id") % 6
        west = F.col("m") == 5
        half_hour = F.floor(F.unix_date(F.to_date("interval")) * 48 + F.hour("interval") * 2 + F.minute("interval") / 30)
        base = (
            self.read("events")
            .select(floor_minutes("ts", 5).alias("interval"), index.alias("m"), "value", "event_type")
            .groupBy("interval", "m")
            .agg(
                F.avg(value).alias("a"),
                F.sum(value).alias("s"),
                F.max(value).alias("hi"),
                F.min(value).alias("lo"),
                F.max(F.when(F.col("event_type") == "purchase", value)).alias("p"),
            )
        )
        return base.select(
            "interval",
            F.when(west, "WEM").otherwise("NEM").alias("network_id"),
            pick((*REGIONS, "WEM"), F.col("m")).alias("network_region"),
            F.when(half_hour % 3 != 0, F.round("a", 4)).alias("price"),
            F.col("p").alias("price_dispatch"),
            F.when(~(west & (F.hour("interval") % 4 == 0)), F.round(F.col("s") * 10, 4)).alias("demand"),
            F.when(~(west & (F.hour("interval") % 4 == 0)), F.round(F.col("s") * 10.5, 4)).alias("demand_total"),
            F.round(F.col("s") - 60, 4).alias("net_interchange"),
            F.col("hi").alias("ss_solar_uigf"),
            F.col("lo").alias("ss_solar_clearedmw"),
            F.round(F.col("hi") * 0.5, 4).alias("ss_wind_uigf"),
            F.round(F.col("lo") * 0.25, 4).alias("ss_wind_clearedmw"),
            F.lit(False).alias("is_forecast"),
        )

    def ui(self) -> DataFrame:
        """A unit fact straight from the events, one row per unit and interval."""
        c = self._unit_columns(F.col("user_id"))
        ft = F.col("fueltech_id")
        factor = F.when(ft == "coal_black", 0.9).when(ft == "gas_ccgt", 0.4).when(ft == "distillate", 0.7).otherwise(0.0)
        base = (
            self.read("events")
            .select(
                floor_minutes("ts", 5).alias("interval"),
                F.when(c["fueltech_id"] == "solar_rooftop", "AEMO_ROOFTOP")
                .otherwise(c["network_id"])
                .alias("network_id"),
                *[c[n].alias(n) for n in ("network_region", "facility_code", "unit_code", "fueltech_id")],
                "user_id",
                "event_id",
                "value",
            )
            .groupBy("interval", "network_id", "network_region", "facility_code", "unit_code", "fueltech_id", "user_id")
            .agg(F.round(F.sum("value"), 4).alias("g"), F.max("event_id").alias("version"))
        )
        return base.select(
            "interval",
            "network_id",
            "network_region",
            "facility_code",
            "unit_code",
            "fueltech_id",
            fueltech_group(ft).alias("fueltech_group_id"),
            is_renewable(ft).alias("renewable"),
            F.when(F.col("user_id") % 10 == 0, "retired").otherwise("operating").alias("status_id"),
            (F.col("g") - 40).alias("generated"),
            F.round((F.col("g") - 40) / 12, 4).alias("energy"),
            F.when(ft == "battery", F.col("g")).alias("energy_storage"),
            F.round(F.col("g") * factor / 12, 4).alias("emissions"),
            F.round(F.col("g") * 5, 4).alias("market_value"),
            "version",
        )

    def ms(self) -> DataFrame:
        """A market fact straight from the events."""
        index = F.col("user_id") % 6
        base = (
            self.read("events")
            .select(floor_minutes("ts", 5).alias("interval"), index.alias("m"), "value", "event_id")
            .groupBy("interval", "m")
            .agg(F.round(F.sum("value"), 4).alias("s"), F.max("event_id").alias("version"))
        )
        s, west = F.col("s"), F.col("m") == 5
        shares = {
            "demand": 10.0,
            "demand_total": 10.5,
            "demand_gross": 11.0,
            "generation_renewable": 4.0,
            "generation_renewable_with_storage": 5.0,
            "demand_energy": 0.8,
            "demand_total_energy": 0.9,
            "demand_gross_energy": 1.0,
            "generation_renewable_energy": 0.4,
            "generation_renewable_with_storage_energy": 0.5,
            "demand_market_value": 30.0,
            "demand_total_market_value": 32.0,
            "demand_gross_market_value": 34.0,
            "curtailment_solar_total": 0.2,
            "curtailment_wind_total": 0.1,
            "curtailment_total": 0.3,
            "curtailment_energy_solar_total": 0.02,
            "curtailment_energy_wind_total": 0.01,
            "curtailment_energy_total": 0.03,
            "energy_imports": 0.06,
            "energy_exports": 0.04,
            "emissions_imports": 0.05,
            "emissions_exports": 0.03,
        }
        return base.select(
            "interval",
            F.when(west, "WEM").otherwise("NEM").alias("network_id"),
            pick((*REGIONS, "WEM"), F.col("m")).alias("network_region"),
            F.when(F.floor(s) % 5 != 0, s).alias("price"),
            *[F.round(s * k, 4).alias(n) for n, k in shares.items()],
            F.lit(0.0).alias("market_value_imports"),
            F.lit(0.0).alias("market_value_exports"),
            "version",
        )

    # --- orders and line items as long histories --------------------------------

    def daily(self) -> DataFrame:
        """Years of daily energy by region and technology."""
        ft = F.when(F.col("l_returnflag") == "A", "coal_black").when(F.col("l_returnflag") == "N", "wind")
        return (
            self.read("lineitem")
            .select(
                F.col("l_shipdate").cast(NTZ).alias("interval"),
                pick(REGIONS, F.col("l_suppkey") % 5).alias("network_region"),
                ft.otherwise("solar_utility").alias("fueltech_id"),
                "l_quantity",
                "l_extendedprice",
            )
            .groupBy("interval", "network_region", "fueltech_id")
            .agg(
                F.sum("l_quantity").alias("energy"),
                F.round(F.sum("l_extendedprice"), 2).alias("market_value"),
                F.count(F.lit(1)).alias("interval_count"),
            )
        )

    def history(self) -> DataFrame:
        """Attribute changes of units over time."""
        return self.read("orders").select(
            F.col("o_custkey").alias("unit_id"),
            F.col("o_orderdate").cast(NTZ).alias("changed_at"),
            F.col("o_orderkey").alias("change_id"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("capacity_registered"),
            F.when(F.col("o_orderkey") % 4 == 0, F.round(F.col("o_totalprice") / 1000000, 4)).alias(
                "emissions_factor_co2"
            ),
        )


def _values(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _case(column: str, table: dict) -> str:
    """A constant table as a CASE expression."""

    def sql(v) -> str:
        return str(v).lower() if isinstance(v, bool) else f"'{v}'"

    whens = " ".join(f"WHEN '{k}' THEN {sql(v)}" for k, v in table.items() if v is not None)
    return f"CASE {column} {whens} END"


_R = _values(REGIONS)
_FT = f"({_values(UNIT_FUELTECHS)})[1 + user_id % 13]"
_GROUP = {k: g for k, (g, _) in FUELTECHS.items()}
_GREEN = {k: r for k, (_, r) in FUELTECHS.items()}

SQL_TABLES: dict[str, str] = {
    "x_coded": f"""
        SELECT *, {_FT} AS fueltech_id,
            ({_FT} = 'solar_rooftop') AS rooftop,
            ({_FT} NOT IN ('solar_rooftop', 'interconnector') AND (user_id // 3) % 8 = 7) AS west
        FROM events""",
    "x_rows": f"""
        SELECT event_id, ts, user_id, event_type, value, fueltech_id,
            'U' || user_id AS unit_code,
            CASE WHEN rooftop THEN 'R' || user_id ELSE 'F' || (user_id // 3) END AS facility_code,
            CASE WHEN west THEN 'WEM' WHEN rooftop THEN 'AEMO_ROOFTOP' ELSE 'NEM' END AS network_id,
            CASE WHEN west THEN 'WEM' WHEN rooftop THEN ({_R})[1 + user_id % 5]
                ELSE ({_R})[1 + (user_id // 3) % 5] END AS network_region
        FROM x_coded""",
    "x_units": f"""
        SELECT DISTINCT user_id AS uid, unit_code, facility_code, network_id, network_region, fueltech_id,
            {_case("fueltech_id", _GROUP)} AS fueltech_group_id,
            {_case("fueltech_id", _GREEN)} AS renewable,
            CASE user_id % 10 WHEN 0 THEN 'retired' WHEN 1 THEN 'committed' ELSE 'operating' END AS status_id,
            CASE WHEN fueltech_id = 'battery' THEN 'BIDIRECTIONAL'
                WHEN fueltech_id IN ('battery_charging', 'pumps') THEN 'LOAD' ELSE 'GENERATOR' END AS dispatch_type,
            CAST(50 + (user_id % 11) * 40 AS DOUBLE) AS capacity_registered,
            CASE WHEN user_id % 4 <> 0 THEN CAST(55 + (user_id % 11) * 40 AS DOUBLE) END AS capacity_maximum,
            CASE fueltech_id WHEN 'coal_black' THEN 0.9::DOUBLE + (user_id % 5) * 0.01::DOUBLE
                WHEN 'gas_ccgt' THEN 0.4::DOUBLE WHEN 'distillate' THEN 0.7::DOUBLE
                WHEN 'bioenergy_biomass' THEN 0.1::DOUBLE END AS emissions_factor_co2,
            fueltech_id = 'interconnector' AS interconnector,
            CASE WHEN fueltech_id = 'interconnector' THEN ({_R})[1 + user_id % 5] END AS interconnector_region_from,
            CASE WHEN fueltech_id = 'interconnector' THEN ({_R})[1 + (user_id + 1) % 5] END AS interconnector_region_to,
            CASE WHEN user_id % 7 <> 0 THEN TIMESTAMP '2010-01-01' + to_days((user_id % 3000)::INT) END AS commencement_date,
            CASE WHEN user_id % 10 = 0 THEN TIMESTAMP '2012-01-01' + to_days((user_id % 3000)::INT) END AS closure_date
        FROM x_rows""",
    "x_facilities": """
        SELECT facility_code, max(network_id) AS network_id, max(network_region) AS network_region
        FROM x_units GROUP BY 1""",
    "x_telemetry": """
        SELECT event_id,
            CASE WHEN fueltech_id = 'solar_rooftop' THEN time_bucket(INTERVAL '30 minutes', ts)
                ELSE time_bucket(INTERVAL '5 minutes', ts) END AS interval,
            network_id, unit_code, value AS generated,
            value / (CASE WHEN fueltech_id = 'solar_rooftop' THEN 2 ELSE 12 END) AS energy,
            CASE WHEN fueltech_id = 'battery' THEN value END AS energy_storage,
            event_type = 'error' AS is_forecast
        FROM x_rows""",
    "x_signed": "SELECT * REPLACE (round(generated - 60, 2) AS generated) FROM x_telemetry",
    "x_market": f"""
        SELECT interval, CASE WHEN m = 5 THEN 'WEM' ELSE 'NEM' END AS network_id,
            ({_values((*REGIONS, "WEM"))})[1 + m] AS network_region,
            CASE WHEN (epoch(interval)::BIGINT // 1800) % 3 <> 0 THEN round(a, 4) END AS price,
            p AS price_dispatch,
            CASE WHEN NOT (m = 5 AND hour(interval) % 4 = 0) THEN round(s * 10::DOUBLE, 4) END AS demand,
            CASE WHEN NOT (m = 5 AND hour(interval) % 4 = 0) THEN round(s * 10.5::DOUBLE, 4) END AS demand_total,
            round(s - 60, 4) AS net_interchange,
            hi AS ss_solar_uigf, lo AS ss_solar_clearedmw,
            round(hi * 0.5::DOUBLE, 4) AS ss_wind_uigf, round(lo * 0.25::DOUBLE, 4) AS ss_wind_clearedmw,
            false AS is_forecast
        FROM (
            SELECT time_bucket(INTERVAL '5 minutes', ts) AS interval, user_id % 6 AS m, avg(value) AS a,
                sum(value) AS s, max(value) AS hi, min(value) AS lo,
                max(CASE WHEN event_type = 'purchase' THEN value END) AS p
            FROM events GROUP BY 1, 2)""",
    "x_ui": f"""
        SELECT interval, network_id, network_region, facility_code, unit_code, fueltech_id,
            {_case("fueltech_id", _GROUP)} AS fueltech_group_id,
            {_case("fueltech_id", _GREEN)} AS renewable,
            CASE WHEN user_id % 10 = 0 THEN 'retired' ELSE 'operating' END AS status_id,
            g - 40 AS generated, round((g - 40) / 12, 4) AS energy,
            CASE WHEN fueltech_id = 'battery' THEN g END AS energy_storage,
            {exact("""g * (CASE fueltech_id WHEN 'coal_black' THEN 0.9::DOUBLE WHEN 'gas_ccgt' THEN 0.4::DOUBLE
                WHEN 'distillate' THEN 0.7::DOUBLE ELSE 0::DOUBLE END) / 12""", 4)} AS emissions,
            round(g * 5, 4) AS market_value, version
        FROM (
            SELECT time_bucket(INTERVAL '5 minutes', ts) AS interval, network_id, network_region, facility_code,
                unit_code, fueltech_id, user_id, round(sum(value), 4) AS g, max(event_id) AS version
            FROM x_rows GROUP BY ALL)""",
    "x_ms": f"""
        SELECT interval, CASE WHEN m = 5 THEN 'WEM' ELSE 'NEM' END AS network_id,
            ({_values((*REGIONS, "WEM"))})[1 + m] AS network_region,
            CASE WHEN floor(s) % 5 <> 0 THEN s END AS price,
            round(s * 10::DOUBLE, 4) AS demand, round(s * 10.5::DOUBLE, 4) AS demand_total,
            round(s * 11::DOUBLE, 4) AS demand_gross, round(s * 4::DOUBLE, 4) AS generation_renewable,
            round(s * 5::DOUBLE, 4) AS generation_renewable_with_storage,
            round(s * 0.8::DOUBLE, 4) AS demand_energy, round(s * 0.9::DOUBLE, 4) AS demand_total_energy,
            round(s * 1::DOUBLE, 4) AS demand_gross_energy, round(s * 0.4::DOUBLE, 4) AS generation_renewable_energy,
            round(s * 0.5::DOUBLE, 4) AS generation_renewable_with_storage_energy,
            round(s * 30::DOUBLE, 4) AS demand_market_value, round(s * 32::DOUBLE, 4) AS demand_total_market_value,
            round(s * 34::DOUBLE, 4) AS demand_gross_market_value,
            round(s * 0.2::DOUBLE, 4) AS curtailment_solar_total, round(s * 0.1::DOUBLE, 4) AS curtailment_wind_total,
            round(s * 0.3::DOUBLE, 4) AS curtailment_total,
            round(s * 0.02::DOUBLE, 4) AS curtailment_energy_solar_total,
            round(s * 0.01::DOUBLE, 4) AS curtailment_energy_wind_total,
            round(s * 0.03::DOUBLE, 4) AS curtailment_energy_total,
            round(s * 0.06::DOUBLE, 4) AS energy_imports, round(s * 0.04::DOUBLE, 4) AS energy_exports,
            round(s * 0.05::DOUBLE, 4) AS emissions_imports, round(s * 0.03::DOUBLE, 4) AS emissions_exports,
            0::DOUBLE AS market_value_imports, 0::DOUBLE AS market_value_exports, version
        FROM (
            SELECT time_bucket(INTERVAL '5 minutes', ts) AS interval, user_id % 6 AS m,
                round(sum(value), 4) AS s, max(event_id) AS version
            FROM events GROUP BY 1, 2)""",
    "x_daily": f"""
        SELECT l_shipdate::TIMESTAMP AS interval, ({_R})[1 + l_suppkey % 5] AS network_region,
            CASE l_returnflag WHEN 'A' THEN 'coal_black' WHEN 'N' THEN 'wind' ELSE 'solar_utility' END AS fueltech_id,
            sum(l_quantity) AS energy, round(sum(l_extendedprice), 2) AS market_value, count(*) AS interval_count
        FROM lineitem GROUP BY 1, 2, 3""",
    "x_history": """
        SELECT o_custkey AS unit_id, o_orderdate::TIMESTAMP AS changed_at, o_orderkey AS change_id,
            CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS capacity_registered,
            CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice / 1000000, 4) END AS emissions_factor_co2
        FROM orders""",
}
