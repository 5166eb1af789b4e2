"""Fixed values of the electricity market: technologies, networks, regions.

Small constant tables are turned into literal map expressions, so using them
costs neither a join nor a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Technology -> (group, renewable).
FUELTECHS: dict[str, tuple[str | None, bool]] = {
    "battery": ("battery", False),
    "battery_charging": ("battery_charging", False),
    "battery_discharging": ("battery_discharging", False),
    "bioenergy_biogas": ("bioenergy", True),
    "bioenergy_biomass": ("bioenergy", True),
    "coal_black": ("coal", False),
    "coal_brown": ("coal", False),
    "distillate": ("distillate", False),
    "gas_ccgt": ("gas", False),
    "gas_ocgt": ("gas", False),
    "gas_recip": ("gas", False),
    "gas_steam": ("gas", False),
    "gas_wcmg": ("gas", False),
    "hydro": ("hydro", True),
    "hydro_and_storage": ("hydro", True),
    "pumps": ("pumps", False),
    "solar_utility": ("solar", True),
    "solar_thermal": ("solar", True),
    "solar_rooftop": ("solar", True),
    "wind": ("wind", True),
    "wind_offshore": ("wind", True),
    "aggregator_vpp": (None, True),
    "aggregator_dr": (None, True),
    "nuclear": (None, False),
    "imports": (None, False),
    "exports": (None, False),
    "interconnector": (None, False),
}

# Technologies whose meter may read below zero.
TWO_WAY_FUELTECHS = ("battery", "battery_charging", "battery_discharging", "pumps")
# Technologies left out of the unit fact.
NON_UNIT_FUELTECHS = ("solar_rooftop", "imports", "exports", "interconnector")
# Technologies counted as renewable in the market fact.
MARKET_RENEWABLE_FUELTECHS = (
    "bioenergy_biogas",
    "bioenergy_biomass",
    "hydro",
    "solar_utility",
    "wind",
    "battery_discharging",
    "pumps",
)
# Hydro units that are storage rather than renewable generation.
HYBRID_STORAGE_UNITS = ("TUMUT3", "SNOWYP")
# Storage and load, neither renewable nor fossil.
STORAGE_FUELTECHS = ("pumps", "battery", "battery_charging", "battery_discharging")


@dataclass(frozen=True)
class Network:
    """A market; several physical feeds may roll up into one."""

    code: str
    country: str
    offset_minutes: int
    interval_minutes: int
    regions: tuple[str, ...] = ()
    parent: str | None = None
    feeds: tuple[str, ...] = ()

    @property
    def codes(self) -> tuple[str, ...]:
        """The network itself and the feeds that belong to it."""
        return (self.code, *self.feeds)

    @property
    def intervals_per_hour(self) -> float:
        return 60 / self.interval_minutes


# The networks. Further rooftop feeds are passed by the caller.
NETWORKS: dict[str, Network] = {
    n.code: n
    for n in (
        Network("NEM", "au", 600, 5, ("NSW1", "QLD1", "SA1", "TAS1", "VIC1"), None, ("AEMO_ROOFTOP",)),
        Network("WEM", "au", 480, 5, ("WEM",), None, ("APVI",)),
        Network("WEMDE", "au", 480, 5, ("WEMDE",), "WEM", ("APVI",)),
        Network("APVI", "au", 600, 15, (), "WEM"),
        Network("AEMO_ROOFTOP", "au", 600, 30, ("NSW1", "QLD1", "SA1", "TAS1", "VIC1"), "NEM"),
        Network("AEMO_ROOFTOP_BACKFILL", "au", 600, 30, ("NSW1", "QLD1", "SA1", "TAS1", "VIC1"), "NEM"),
    )
}

# Region -> spoken name.
REGION_NAMES = {
    "NSW1": "New South Wales",
    "QLD1": "Queensland",
    "SA1": "South Australia",
    "TAS1": "Tasmania",
    "VIC1": "Victoria",
    "WEM": "Western Australia",
}


def literal_map(values: dict) -> Column:
    """A constant map expression."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(column: Column, values: dict, default: Column | None = None) -> Column:
    """Value of a constant table for `column`; NULL (or `default`) when absent."""
    # try_element_at returns NULL for absent keys even in ANSI mode.
    found = F.try_element_at(literal_map(values), column)
    return found if default is None else F.coalesce(found, default)


def fueltech_group(fueltech: Column) -> Column:
    return lookup(fueltech, {k: g for k, (g, _) in FUELTECHS.items() if g})


def is_renewable(fueltech: Column) -> Column:
    return lookup(fueltech, {k: r for k, (_, r) in FUELTECHS.items()})


def interval_minutes(network: Column, networks: dict[str, Network] = NETWORKS) -> Column:
    """Length of one reading of a network, five minutes when unknown."""
    return lookup(network, {n.code: n.interval_minutes for n in networks.values()}, F.lit(5))


def networks_frame(spark: SparkSession) -> DataFrame:
    """The network table as a frame of a handful of constant rows."""
    rows = ",".join(
        f"('{n.code}','{n.country}',{n.offset_minutes},{n.interval_minutes},"
        f"{'NULL' if n.parent is None else repr(n.parent)})"
        for n in NETWORKS.values()
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(network_id, country, offset_minutes, interval_minutes, parent_network)"
    )
