"""Rollups of the two facts, and rebuilding whole buckets of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.lookups import STORAGE_FUELTECHS
from wattframe.functions.timebucket import bucket, ts_lit, trunc
from wattframe.operators.versioning import completeness_version



def _date(grain: str = "1d", name: str = "date") -> Column:
    return bucket("interval", grain).alias(name)


def _sums(columns: Sequence[str], clamp: bool = False) -> list[Column]:
    return [F.sum(F.greatest(F.col(c), F.lit(0.0)) if clamp else F.col(c)).alias(c) for c in columns]


def _storage_pair() -> list[Column]:
    """Sum and count, so that averages recombine."""
    c = F.col("energy_storage")
    return [
        F.sum(F.coalesce(c, F.lit(0.0))).alias("energy_storage_sum"),
        F.count_if(c.isNotNull()).alias("energy_storage_count"),
    ]


def _full_version() -> Column:
    return completeness_version("interval", "version").alias("version")


def unit_daily(fact: DataFrame) -> DataFrame:
    """Unit fact by day."""
    keys = ("network_id", "network_region", "facility_code", "unit_code", "fueltech_id", "fueltech_group_id")
    return fact.groupBy(_date(), *keys).agg(
        F.max("renewable").alias("renewable"),
        F.max("status_id").alias("status_id"),
        *_sums(["generated", "energy"]),
        *_storage_pair(),
        *_sums(["emissions", "market_value"]),
        F.count(F.lit(1)).alias("interval_count"),
        _full_version(),
    )


_FUELTECH = ("network_id", "network_region", "fueltech_id", "fueltech_group_id")


def fueltech_interval(fact: DataFrame) -> DataFrame:
    """Unit fact by technology, at its own grain."""
    return fact.groupBy("interval", *_FUELTECH).agg(
        *_sums(["generated", "energy"]),
        F.avg("energy_storage").alias("energy_storage"),
        *_sums(["emissions", "market_value"]),
        F.count(F.lit(1)).alias("unit_count"),
        F.max("version").alias("version"),
    )


def fueltech_daily(fact: DataFrame) -> DataFrame:
    """Unit fact by technology and day."""
    return fact.groupBy(_date(), *_FUELTECH).agg(
        *_sums(["generated", "energy"]),
        *_storage_pair(),
        *_sums(["emissions", "market_value"]),
        F.count(F.lit(1)).alias("unit_count"),
        F.count_distinct("interval").alias("interval_count"),
        _full_version(),
    )


_RENEWABLE = ("network_id", "network_region", "renewable")


def _without_storage(fact: DataFrame) -> DataFrame:
    return fact.filter(~F.col("fueltech_id").isin(*STORAGE_FUELTECHS))


def renewable_interval(fact: DataFrame) -> DataFrame:
    """Renewable against fossil, without storage, at the fact's grain."""
    return (
        _without_storage(fact)
        .groupBy("interval", *_RENEWABLE)
        .agg(
            *_sums(["generated", "energy"], clamp=True),
            F.avg("energy_storage").alias("energy_storage"),
            *_sums(["emissions", "market_value"]),
            F.count(F.lit(1)).alias("unit_count"),
            F.max("version").alias("version"),
        )
    )


def renewable_daily(fact: DataFrame) -> DataFrame:
    """Renewable against fossil by day."""
    return (
        _without_storage(fact)
        .groupBy(_date(), *_RENEWABLE)
        .agg(
            *_sums(["generated", "energy"], clamp=True),
            *_storage_pair(),
            *_sums(["emissions", "market_value"]),
            F.count(F.lit(1)).alias("unit_count"),
            F.count_distinct("interval").alias("interval_count"),
            _full_version(),
        )
    )


# Market measures kept as plain sums, and those named by period.
MARKET_SUMS = ("demand", "demand_total", "demand_gross", "generation_renewable", "generation_renewable_with_storage")
MARKET_PERIOD = (
    "demand_energy",
    "demand_total_energy",
    "demand_gross_energy",
    "generation_renewable_energy",
    "generation_renewable_with_storage_energy",
    "demand_market_value",
    "demand_total_market_value",
    "demand_gross_market_value",
    "curtailment_solar_total",
    "curtailment_wind_total",
    "curtailment_total",
    "curtailment_energy_solar_total",
    "curtailment_energy_wind_total",
    "curtailment_energy_total",
    "energy_imports",
    "energy_exports",
    "emissions_imports",
    "emissions_exports",
    "market_value_imports",
    "market_value_exports",
)


def _market(summary: DataFrame, grain: str, name: str, suffix: str) -> DataFrame:
    return summary.groupBy(_date(grain, name), "network_id", "network_region").agg(
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_count"),
        *[F.sum(c).alias(f"{c}_sum") for c in MARKET_SUMS],
        *[F.sum(c).alias(f"{c}_{suffix}") for c in MARKET_PERIOD],
        F.count(F.lit(1)).alias("interval_count"),
        _full_version(),
    )


def market_daily(summary: DataFrame) -> DataFrame:
    """Market fact by day."""
    return _market(summary, "1d", "date", "daily")


def market_monthly(summary: DataFrame) -> DataFrame:
    """Market fact by month."""
    return _market(summary, "1M", "month", "monthly")


def monthly_from_daily(daily: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("network_id", "network_region")) -> DataFrame:
    """Months out of complete days."""
    return daily.groupBy(trunc("month", F.col("date")).alias("month"), *keys).agg(*[F.sum(c).alias(c) for c in columns])


def whole_buckets(start: datetime, end: datetime, grain: str) -> tuple[datetime, datetime]:
    """The window widened to whole days, or months, it touches."""
    first = start.replace(hour=0, minute=0, second=0, microsecond=0)
    last = end.replace(hour=0, minute=0, second=0, microsecond=0)
    if last < end:
        last += timedelta(days=1)
    if grain == "1M":
        first = first.replace(day=1)
        if last.day != 1:
            last = (last.replace(day=1) + timedelta(days=32)).replace(day=1)
    return first, last


def rebuild(
    rollup: Callable[[DataFrame], DataFrame],
    source: DataFrame,
    target: DataFrame,
    start: datetime,
    end: datetime,
    grain: str = "1d",
    column: str = "date",
) -> DataFrame:
    """`target` with every bucket the window touches recomputed from `source`.

    Only whole buckets are replaced, so no rollup is ever half of one. Written
    with dynamic partition overwrite this touches the affected days only.
    """
    lo, hi = (ts_lit(d) for d in whole_buckets(start, end, grain))
    fresh = rollup(source.filter((F.col("interval") >= lo) & (F.col("interval") < hi)))
    kept = target.filter((F.col(column) < lo) | (F.col(column) >= hi))
    return kept.unionByName(fresh)


def verify_rollup(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Row count and time span per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")
    )
